"""One row of each component stays, also where ids are null, tied or repeated."""

import corpus_pipeline as pipeline
from kgloom.llm import simhash
from tests.llm import corpus


def test_one_row_of_each_component(spark):
    rows = [
        (None, "", "a"), (None, " ", "b"), (None, None, "c"),  # near copies without ids
        (None, "one two three four", "d"), (None, "ONE two three four", "e"), (9, "one two  three four", "f"),  # a null id loses to any
        (5, "five six seven", "g"), (5, "Five six seven", "h"), (6, "five six seven", "i"),  # tied ids, different texts
        (7, "eight nine ten eleven", "j"), (7, "eight nine ten eleven", "k"),  # repeated
        (5, "another text with the same id as before", "l"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    left = pipeline.near_copies_out(spark, docs.repartition(3), "")
    assert left.columns == docs.columns
    got = sorted(r.source for r in left.collect())
    assert len(got) == 5 and sum(x in "abc" for x in got) == 1 and "f" in got and sum(x in "gh" for x in got) == 1 and sum(x in "jk" for x in got) == 1 and "l" in got
    assert got == sorted(r.source for r in simhash.keep_first(docs.repartition(2)).collect())


def test_as_many_rows_as_components(spark, sf_dir):
    df = corpus.frame(spark, sf_dir)
    parts = simhash._grouped(df, simhash.RADIUS, "doc_id", "text", simhash.SHINGLE, simhash.SEED).select("component").distinct().count()
    assert simhash.keep_first(df).count() == parts < simhash.keep_one(df).count()
    assert simhash.keep_first(corpus.empty(spark)).count() == 0
