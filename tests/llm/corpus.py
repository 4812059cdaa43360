"""A small corpus with the awkward cases, used by the operators' tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("size", "shard", "digest", "row", "part", "h", "fp", "first")]
)


def rows(spark, sf_dir, n=60):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n).collect()
    out = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    out += [
        (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, " \t\n ", "en", "src1", 4), (None, "no id here", "en", "src2", 10), (None, None, None, "src2", None),
        (9004, "tie text", "en", "src3", 8), (9004, "tie text", "en", "src3", 8), (9004, "tie other text", "en", "src3", 14), (9005, "tie text", None, None, 8),
        (9006, "word " * 30_000, "en", "src0", 150_000), (9007, "straße ÄÖ x\x1cy 日本 🙂", "de", "Ä", 20), (-5, "negative id", "en", "src0", 11),
    ]
    out += [(9100 + i, "the hot copy of many", "en", "src0", 20) for i in range(50)]
    return [(*r, "x", None, "y", "z", None, "h", "f", "1") for r in out]


def frame(spark, sf_dir, n=60):
    return spark.createDataFrame(rows(spark, sf_dir, n), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
