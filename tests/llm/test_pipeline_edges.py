"""Every stage on nulls, empty and very long texts, ties, repeated rows, extra columns with clashing
names, and on an empty table, against plain Python."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

from kgloom.llm import common, mixing, simhash, toxicity
from kgloom.llm.registry import WORD_BPE, vocabulary
from tests.llm import corpus

pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(pipeline.STAGES)
NAMES = list(STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.written(corpus.frame(spark, sf_dir), "edges")


def key(r):
    return str(r.doc_id), r.text or ""


def test_columns_and_empty_tables(spark, sf_dir, docs):
    for name in NAMES[:-1]:
        assert STAGES[name](spark, docs, sf_dir).columns == docs.columns
    for name in NAMES:
        assert STAGES[name](spark, corpus.empty(spark), sf_dir).count() == 0


def test_toxicity(spark, sf_dir, docs):
    left = Counter(key(r) for r in STAGES["toxicity"](spark, docs, sf_dir).collect())
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.collect()
    keep = chain.predict([r.text for r in rows])[:, -1] < chain.threshold
    assert left == Counter(key(r) for r, k in zip(rows, keep) if k)
    assert left["9001", ""] == 1 and left["9002", ""] == 1 and left["None", ""] == 1


def test_exact_dedup(spark, sf_dir, docs):
    best = {}
    for r in docs.collect():
        t = r.text or ""
        if t not in best or (r.doc_id is not None and (best[t] is None or r.doc_id > best[t])):
            best[t] = r.doc_id
    left = STAGES["exact dedup"](spark, docs, sf_dir).collect()
    assert Counter(key(r) for r in left) == Counter((str(i), t) for t, i in best.items())


def test_near_dedup(spark, sf_dir, docs):
    rows = docs.collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    first = {}
    for r, c in zip(rows, label):
        k = (r.doc_id is None, r.doc_id or 0)
        first[c] = min(first.get(c, k), k)
    left = STAGES["SimHash near-dedup"](spark, docs, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted(first.values())


def test_mixing(spark, sf_dir, docs):
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    rows, got = docs.collect(), STAGES["mixing sources to target weights"](spark, docs, sf_dir).collect()
    size, taken, of, copies = Counter(), Counter(), Counter(), Counter(key(r) for r in rows)
    for r in rows:
        size[r.source] += words(r.text)
    for r in got:
        taken[r.source] += words(r.text)
        assert r.text and r.n_chars is not None and (r["size"], r.shard, r.digest, r.row, r.part) == ("x", None, "y", "z", None)
    names = sorted(size, key=lambda x: (x is None, x))
    aim = mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    assert all(abs(taken[s] - a) <= 1 for s, a in zip(names, aim))
    texts = {}
    for r in rows:
        texts.setdefault(str(r.doc_id), set()).add(r.text or "")
    for r in got:
        whole = [t for t in texts[str(r.doc_id)] if r.text in t]
        assert whole
        of[str(r.doc_id)] += words(r.text)
    for i, n in of.items():
        assert n <= 2 * sum(words(t) * copies[i, t] for t in texts[i])


def test_repeated_rows_are_laid_on_their_own_columns(spark):
    """Rows that share id, text and source, some with other columns."""
    rows = [(1, "one two three", "s", 13, x) for x in ("p", "p", "q", None)] + [(2, "four five", "t", 9, "r")] * 3
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, last string")
    mixed = common.written(mixing.mix(d), "mixed")
    got = Counter((r.doc_id, r.last) for r in mixing.materialize(d, mixed).where("n_chars = 13 OR n_chars = 9").collect())
    passes = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg({"passes": "sum"}).toDF("doc_id", "n").collect()}
    assert sum(n for (i, _), n in got.items() if i == 1) == passes[1] and sum(n for (i, _), n in got.items() if i == 2) == passes[2]
    assert all(n <= 2 * Counter((i, x) for i, _, _, _, x in rows)[k] for k, n in got.items())


def test_packing(spark, sf_dir, docs):
    enc = Tokenizer.from_file(vocabulary(WORD_BPE))
    want = Counter((str(r.doc_id), len(enc.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = STAGES["packing"](spark, docs, sf_dir).collect()
    assert Counter((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in want.items())
