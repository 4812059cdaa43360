import random

import numpy as np
from pyspark.sql import functions as F

from kgloom.llm import common, linear, quality, toxicity
from tests.llm import corpus

LABELS = "doc_id bigint, quality int, toxic int"


def toy(spark, n=500):
    """Clean, toxic (an invented stem among the words) and junk texts, with labels for four in five."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic, junk = i % 7 == 0, i % 5 == 0 and i % 7 != 0
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(["idiot", "Scum,", "zzyqq" + rng.choice(words), "zzyqq" + rng.choice(words)])
        text = " ".join(f"{w.upper()}!!" for w in body) if junk else " ".join(body) + "."
        rows.append((i, text, "en", f"src{i % 3}", len(text), *[None] * 8))
        if i % 5 != 4:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, corpus.SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toy(spark)
    chain = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = [i for i in range(500) if i % 5 == 4]
    assert all(not got[i].is_toxic for i in held if i % 7) and sum(got[i].is_toxic for i in held if i % 7 == 0) >= 13
    assert got[0].is_toxic == (got[0].p_toxic >= chain.threshold) and set(got[0].asDict()) == {"doc_id", "p_kind_1", "p_kind_2", "p_kind_3", "p_toxic", "is_toxic"}
    left = toxicity.clean(docs, chain)
    assert left.columns == docs.columns and left.count() == sum(not r.is_toxic for r in got.values())
    again = {r.doc_id: r.p_toxic for r in toxicity.score(docs.repartition(2), toxicity.fit(docs.repartition(2), labels)).collect()}
    assert again == {k: r.p_toxic for k, r in got.items()}


def test_later_links_see_earlier_ones():
    sets = [{"a", f"a{i % 8 // 4}"} if i % 4 == 0 else {"b"} if i % 4 == 1 else {"c"} for i in range(400)]
    toxic = np.array([i % 4 == 0 for i in range(400)])
    names = sorted({"a", "a0", "a1", "b", "c"})
    chain = toxicity.train(np.arange(400), sets, toxic, names)
    assert [len(w[1]) for w in chain.weights] == [0, 1, 2, 3]
    p = chain.predict(["a a0", "b", None])
    assert p[0, -1] > 0.5 > p[1, -1] and p.shape == (3, 4)
    kind = toxicity.kinds_of(linear.Rows([{names.index(w): 1.0 for w in s} for s in sets], 5), toxic.astype(float), 2)
    assert set(kind[~toxic]) == {-1} and len(set(kind[0::8])) == len(set(kind[4::8])) == 1 and kind[0] != kind[4]


def brute_chain(chain, text):
    """The probabilities of a text, link by link in plain Python."""
    edges = toxicity._EDGES
    words = {w.strip(edges) for w in (text or "").lower().split()}
    words |= {w[:n] + "*" for w in words for n in range(3, 7) if len(w) > n}
    out = []
    for own, earlier, b in chain.weights:
        z = b + sum(own[i] for w, i in chain.words.items() if w in words) + sum(a * p for a, p in zip(earlier, out))
        out.append(1 / (1 + np.exp(-z)))
    return out


def test_toxicity_scores_equal_brute_force(spark, sf_dir):
    docs, labels = toy(spark)
    chain = toxicity.fit(docs, labels)
    df = corpus.frame(spark, sf_dir).unionByName(docs)
    got = sorted((str(r.doc_id), *[round(r[f"p_{c}"], 9) for c in toxicity.CHAIN], r.is_toxic) for r in toxicity.score(df, chain).collect())
    want = [(str(r.doc_id), brute_chain(chain, r.text)) for r in df.collect()]
    assert got == sorted((i, *[round(float(x), 9) for x in p], bool(p[-1] >= chain.threshold)) for i, p in want)


def test_features_are_those_beyond_chance(spark):
    rows = [(i, int(i % 4 == 0), w) for i in range(200) for w in ({"x"} if i % 4 == 0 else {"y"}) | {"z", f"w{i % 5}"}]
    names = toxicity.select_features(spark.createDataFrame(rows, "id bigint, toxic int, word string"))
    assert names == ["x", "y"]


def test_toxicity_edges(spark, sf_dir):
    df = corpus.frame(spark, sf_dir)
    none = toxicity.fit(df, spark.createDataFrame([], LABELS))
    assert not any(r.is_toxic for r in toxicity.score(df, none).collect())
    one = toxicity.fit(df, spark.createDataFrame([(0, 1, 0), (0, 1, 1), (None, 1, 1), (1, None, None)], LABELS))
    assert toxicity.score(df, one).count() == df.count()
    assert toxicity.score(corpus.empty(spark), one).count() == 0


def fitted(docs, labels):
    pages = common.written(quality.features(docs), "features")
    return pages, quality.fit(pages, labels)


def test_quality_on_held_out_rows(spark):
    docs, labels = toy(spark)
    pages, model = fitted(docs, labels)
    got = {r.doc_id: r for r in quality.score(pages, model).collect()}
    held = [i for i in range(500) if i % 5 == 4]
    assert all(got[i].keep for i in held)
    junk = [i for i in range(500) if i % 5 == 0 and i % 7]
    assert sum(not got[i].keep for i in junk) >= 0.95 * len(junk)


def brute_quality(model, row):
    """Scores of a page in plain Python: bin by bin, tag by tag."""
    odds = []
    dense = (quality.content(row.text or ""), [-1.0 if row.n_chars is None else float(row.n_chars)])
    tags = ([], [quality.tag_of("lang", row.lang), quality.tag_of("source", row.source)])
    for v, xs, ts in zip(model.views, dense, tags):
        z = v.b + sum(v.w[v.start[j] + sum(1 for e in v.edges[j] if e <= x)] for j, x in enumerate(xs)) + sum(v.w[v.tag[t]] for t in ts if t in v.tag)
        odds.append(z * v.scale[0] + v.scale[1])
    return [1 / (1 + np.exp(-z)) for z in (*odds, sum(odds) - model.prior)]


def test_quality_scores_equal_brute_force(spark, sf_dir):
    docs, labels = toy(spark)
    _, model = fitted(docs, labels)
    df = corpus.frame(spark, sf_dir).unionByName(docs)
    got = sorted((str(r[0]), *[round(x, 7) for x in r[1:4]], r[4]) for r in quality.score(quality.features(df), model).collect())
    want = [(str(r.doc_id), brute_quality(model, r)) for r in df.collect()]
    assert got == sorted((i, *[round(float(x), 7) for x in p], bool(p[2] >= 0.5)) for i, p in want)


def test_metadata_view_reads_no_text(spark):
    docs, labels = toy(spark)
    pages, model = fitted(docs, labels)
    other = quality.score(quality.features(docs.withColumn("text", F.lit("!!"))), model)
    key = lambda df: {r.doc_id: r.metadata_quality for r in df.collect()}
    assert key(other) == key(quality.score(pages, model))


def test_views_teach_each_other():
    """A view whose labelled rows are few learns from the other's pseudo-labels."""
    rng = np.random.default_rng(3)
    y = np.tile([1.0, 0.0], 300)
    a, b = y[:, None] + rng.normal(0, 0.1, (600, 1)), y[:, None] * 2 + rng.normal(0, 0.2, (600, 1))
    few, used = np.arange(40), set()

    def surest(views, most):
        out = []
        for k, v in enumerate(views):
            p = linear.sigmoid(v.margins((a, b)[k][40:], [[]] * 560))
            for label, sure in ((1, p), (0, 1 - p)):
                at = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= quality.SURE and i not in used][: 10 * most[label]]
                used.update(at)
                if at:
                    out.append((k, label, [(x[40:][at], [[]] * len(at)) for x in (a, b)]))
        return out

    m = quality.cotrain(few, [(x[few], [[]] * 40) for x in (a, b)], y[few], surest)
    p = m.score([(x, [[]] * 600) for x in (a, b)])[2]
    assert ((p >= 0.5) == (y == 1)).mean() > 0.98 and used


def test_quality_edges(spark, sf_dir):
    df = corpus.frame(spark, sf_dir)
    pages, model = fitted(df, spark.createDataFrame([], LABELS))
    assert quality.score(pages, model).count() == df.count()
    assert quality.score(quality.features(corpus.empty(spark)), model).count() == 0
    _, nothing = fitted(corpus.empty(spark), spark.createDataFrame([], LABELS))
    assert quality.score(pages, nothing).count() == df.count()
    bare = quality.features(df.select("doc_id", "text"))  # a table without the record's columns
    assert quality.score(bare, model).count() == df.count()
    same = [r for r in quality.score(pages, model).collect() if r.doc_id is not None and r.doc_id >= 9100]
    assert len(same) == 50 and len({tuple(r)[1:] for r in same}) == 1


def test_linear_model_finds_the_feature():
    rows = linear.Rows([{0: 1.0, 1 + i % 5: 1.0} if i % 3 == 0 else {1 + i % 5: 1.0} for i in range(300)], 6)
    y = np.array([float(i % 3 == 0) for i in range(300)])
    w, b = linear.fit(rows, y)
    assert w[0] > 3 and abs(w[1:]).max() < 0.5 and linear.auc(rows.dot(w) + b, y.astype(int)) == 1.0
    assert rows.take(np.array([3, 0])).dot(np.arange(6.0)).tolist() == [4.0, 1.0]
