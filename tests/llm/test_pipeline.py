import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

from kgloom.llm import common, mixing, packing, simhash, toxicity
from kgloom.llm.registry import WORD_BPE, vocabulary

pipeline = pytest.importorskip("corpus_pipeline")


def brute_survivors(docs, toxic):
    """The first three stages by plain Python."""
    rows = [r for r in docs if r.doc_id not in toxic]
    best = {}
    for r in rows:
        best[r.text or ""] = max(best.get(r.text or "", r), r, key=lambda x: x.doc_id)
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    fps = [simhash.fingerprint(r.text) for r in rows]
    label = list(range(len(rows)))
    changed = True
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    while changed:
        changed = False
        for i, j in near:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return [r for i, r in enumerate(rows) if label[i] == i]


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.is_toxic}
    survivors = brute_survivors(docs.collect(), toxic)
    stages = dict(pipeline.STAGES)
    assert len(stages) == 5
    d = docs
    for name in list(stages)[:3]:
        d = common.written(stages[name](spark, d, sf_dir), "t")
        assert d.columns == docs.columns
    assert sorted(map(str, d.collect())) == sorted(map(str, survivors))
    mix = common.written(pipeline.mixed(spark, d, sf_dir), "t")
    assert mix.columns == docs.columns
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    size, taken = Counter(), Counter()
    for r in survivors:
        size[r.source] += words(r.text)
    text = {r.doc_id: r.text for r in survivors}
    times = Counter()
    for r in mix.collect():
        taken[r.source] += words(r.text)
        times[r.doc_id] += words(r.text)
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
    names = sorted(size)
    aim = mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    assert all(abs(taken[s] - a) <= 2 * mixing.BLOCK for s, a in zip(names, aim))
    assert all(n <= 2 * words(text[i]) for i, n in times.items())
    enc = Tokenizer.from_file(vocabulary(WORD_BPE))
    total = sum(len(enc.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix.collect())
    got = pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in got) == total
    assert max(r.offset + r.length for r in got) <= packing.WINDOW


def test_materialize_repeats_and_cuts(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", "s", 6), (1, "a  b\nc", "s", 6), (2, None, "s", None), (None, "x y", "s", 3)], "doc_id bigint, text string, source string, n_chars bigint")
    m = docs.select("doc_id", mixing.tie_of().alias("tie")).dropDuplicates()
    spans = "array<struct<from:bigint,to:bigint>>"
    rows = [(1, 2, []), (1, 0, [(1, 3)]), (None, 1, [])]
    tie = {r.doc_id: r.tie for r in m.collect()}
    mixed = spark.createDataFrame([(d, tie[d], 1, p, s) for d, p, s in rows], f"doc_id bigint, tie bigint, taken bigint, passes bigint, spans {spans}")
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in mixing.materialize(docs, mixed).collect())
    assert got == [("1", "a  b\nc", 6), ("1", "a  b\nc", 6), ("1", "b\nc", 3), ("None", "x y", 3)]
