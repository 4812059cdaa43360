import zlib

import numpy as np
from pyspark.sql import functions as F

from kgloom.llm import common, language
from tests.llm import corpus

ODD = ["", " ", "12 34!", "Aa b--B", "ÄÖ straße İı", "日本語 テスト", "x", "a" * 50, "é naïve", "tab\tand\nline", "\U0001d400 \U0001f642 ok", "İstanbul"]


def naive(text):
    """The distinct n-grams of a text, in plain Python."""
    plain = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    while "  " in plain:
        plain = plain.replace("  ", " ")
    out = {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)} - {" "}
    return out


def code(gram):
    k = 0
    for c in gram:
        k = k << language.BITS | ord(c)
    return k


def test_features_against_plain_python(monkeypatch):
    for size in (5, 1 << 20):
        monkeypatch.setattr(language, "SLICE", size)
        for s in ODD:
            assert set(language.grams(s).tolist()) == {code(g) for g in naive(s)}, s
        codes = np.unique(np.concatenate([language.grams(s) for s in ODD[3:7]]))
        for direct in (1 << 22, 0):
            monkeypatch.setattr(language, "DIRECT", direct)
            known = language.Dictionary(codes)
            assert (known.table is None) == (not direct)
            for s in ODD:
                row, real = known.present(s)
                assert set(known.codes[row].tolist()) == {code(g) for g in naive(s)} & set(codes.tolist()), s
                assert real == any(c.isalpha() for c in s)


def test_kernel_is_the_share_of_common_ngrams():
    texts = ["the cat", "a cat sat", "le chat"]
    codes = np.unique(np.concatenate([language.grams(t) for t in texts]))
    known = language.Dictionary(codes)
    x = np.array([known.present(t)[0] for t in texts], np.float32)
    k = language._kernel(x, x)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            a_, b_ = naive(a), naive(b)
            assert abs(k[i, j] - len(a_ & b_) / (len(a_) * len(b_)) ** 0.5) < 1e-5


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.digest(docs)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert out and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_awkward_rows(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir)
    got = {(str(r.doc_id), r.lang_pred, r.score) for r in language.digest(corpus.frame(spark, sf_dir)).collect()}
    none = {i for i, p, s in got if p == "und"}
    assert {"9001", "9002", "9003"} <= none and all(s == 0 for _, p, s in got if p == "und")
    assert language.digest(corpus.frame(spark, sf_dir)).count() == len(rows)
    assert len({(p, s) for i, p, s in got if i.startswith("91")}) == 1  # equal texts
    assert language.digest(corpus.empty(spark)).count() == 0
    blank = corpus.frame(spark, sf_dir).withColumn("lang", F.lit(None).cast("string"))
    assert {tuple(r) for r in language.digest(blank).select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}
    one = corpus.frame(spark, sf_dir).withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in language.digest(one).collect()} == {"xx", "und"}


def test_the_sample_is_bounded_and_held_out_rows_teach_nothing(spark):
    rows = [(i % 700 if i % 3 else 5, "hot copy" if i % 3 == 0 else f"text {i}", "en" if i % 9 else f"l{i % 4}", *[None] * 10) for i in range(4000)]
    docs = common.columns(spark.createDataFrame(rows, corpus.SCHEMA), doc_id="bigint", text="string", lang="string").withColumn("held_out", F.col("doc_id") % 4 == 2)
    got = language.sample(docs, 200).collect()
    assert 100 < len(got) <= 200 and len({r.key for r in got}) == len(got)
    assert {r.lang for r in got} >= {"en", "l0", "l1", "l2", "l3"}
    lied = docs.withColumn("lang", F.when(F.col("held_out"), F.lit("lie")).otherwise(F.col("lang")))
    assert "lie" not in language.fit(lied).langs
