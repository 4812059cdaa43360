"""Extra columns of any type beside repeated rows, and many rows without an id."""

import os
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm import common, exact_dedup, mixing, simhash, simple8b, spotsigs
from kgloom.llm.registry import BYTE_BPE, vocabulary
from tests.llm import test_spotsigs  # noqa: F401  (the brute-force version)

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField("a map", T.MapType(T.StringType(), T.IntegerType())), T.StructField("odd", T.StructType([T.StructField("a b:c", T.IntegerType()), T.StructField("x,`y", T.StringType())]))]
)


def frame(spark):
    row = lambda i, t, m, o: (i, t, "en", "s", len(t or ""), m, o)
    rows = [row(1, "one two three four", {"k": 1}, (1, "p")), row(1, "one two three four", {"k": 1}, (1, "p")), row(1, "one two three four", {"k": None}, (2, None))]
    rows += [row(2, "a quite different text of seven words", None, None), row(None, None, {}, (None, "q")), row(3, "yet another row with its own words here", {"z": 3}, (5, "r"))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_map_and_struct_columns(spark):
    docs = frame(spark)
    for left in (exact_dedup.deduplicate(docs), simhash.keep_first(docs)):
        got = left.collect()
        assert left.schema == docs.schema and Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 1, None: 1}
        assert all(r in docs.collect() for r in got)
    mixed = mixing.mix(docs)
    made = mixing.materialize(docs, mixed)
    assert [f.name for f in made.schema] == docs.columns
    want = sum(r.passes + len(r.spans) for r in mixed.collect())
    got = made.collect()
    assert len(got) == want and {str(r["a map"]) for r in got} <= {str(r["a map"]) for r in docs.collect()}
    words = sum(len(r.text.split()) for r in got)
    assert words == sum(r.taken for r in mixed.collect())


def no_ids(spark, n):
    return spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("the text is a number of its own "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("bigint").alias("n_chars")).repartition(8)


def test_rows_without_ids_spread(spark, monkeypatch):
    """Twelve tasks share rows that have no id among them."""
    n = 3000
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = common.written(no_ids(spark, n), "docs")
        got = spotsigs.compare_with_next(docs)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < n / 6
        # the order goes round once: every document is the next of one other
        sums = got.agg(F.sum("n_chars"), F.count("near_next")).first()
        assert sums[1] == n
        files = simple8b.write_files(docs, vocabulary(BYTE_BPE))
        sizes = [r["n"] for r in files.groupBy("file_no").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) < n / 6
        seen, write = {}, common.written
        monkeypatch.setattr(common, "written", lambda df, name, *a: seen.setdefault(name, write(df, name, *a)))
        mixing.mix(docs).count()
        assert seen["cells"].agg(F.max("n") / F.sum("n")).first()[0] < 0.2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_within_an_id_keep_the_order(spark):
    """One id for most rows: the same result as in a single range."""
    docs = spark.range(400).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).cast("bigint").alias("doc_id"), F.concat(F.lit("it is the case that there was a story "), F.col("id") % 90, F.lit(" and so on")).alias("text")).repartition(4)
    docs = common.written(docs, "docs")
    cols = ["doc_id", "edited_sha256", "near_next"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(spotsigs.compare_with_next(docs, 9)) == key(spotsigs.compare_with_next(docs, 1))


def test_scratch_goes_after_the_session(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from kgloom.llm import common
from kgloom.operators import settle
common.written(s.range(3), "a")
settle.settled(s.range(3))
import os
assert sum(x.startswith("kgloom-") for x in os.listdir("{tmp_path}")) == 2
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert not any(x.startswith("kgloom-") for x in os.listdir(tmp_path))
