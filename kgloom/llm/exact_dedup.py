"""Exact deduplication with a split at the heavy hitters, in DataFrame operations alone.

Texts are equal when their UTF-8 bytes are; their SHA-256 stands for them. Frequent digests are
found by Misra-Gries summaries, which Spark offers as its top-k sketch: a summary tracks at most
``TRACKED`` keys and loses no key with more than 3.5 / TRACKED of all rows. Each task fills one of
bounded size and summaries merge in two levels. The candidates are then counted exactly. Their
verified winners, at most ``CANDIDATES`` rows, are broadcast, and their other copies leave on the
map side. No digest that remains has a large share of the rows; an ordinary shuffle by digest
settles them: an aggregate, which combines on the map side, joined back, so no task holds a group.

Of equal texts the row with the largest doc_id stays.

Defined results: a null text equals the empty one; a null doc_id loses to any other; of repeated
rows that share text and doc_id exactly one is kept, in ``deduplicate`` the one whose row has the
least hash; a very long text is hashed whole and never leaves its row for a key; an empty table gives
no rows. ``annotate`` reads only id and text; ``deduplicate`` returns all columns of its input
unchanged, whatever their names, null texts as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common

#: Keys a summary tracks, candidates taken from it, and groups in which summaries first merge.
TRACKED, CANDIDATES, MERGES = 1024, 256, 64


def digest_of(text_col: str) -> F.Column:
    """SHA-256 of the text's UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def _best() -> list[F.Column]:
    """Of a digest: the place (id and row number) of the row that stays, and the number of rows."""
    return [F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")]


def heavy_winners(keys: DataFrame) -> DataFrame:
    """(digest, best, group_size) of every digest with a large share of the rows.

    ``keys`` is (doc_id, digest, rid). Summaries hold 64-bit hashes of the digests; the exact count
    is by the whole digest. At most CANDIDATES hashes come out of the sketch."""
    hashed = keys.select("doc_id", "digest", "rid", F.xxhash64("digest").alias("h"))
    sketches = hashed.groupBy((F.spark_partition_id() % MERGES).alias("m")).agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("s"))
    # grouped, as a global aggregate would have to combine no sketches where there are no rows
    top = sketches.groupBy((F.col("m") * 0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {TRACKED}), {CANDIDATES})").alias("t"))
    found = top.select(F.explode("t").alias("x")).select(F.col("x.item").alias("h"), F.col("x.count").alias("about"))
    found = common.written(found.where(F.col("about") > 1).select("h"), "heavy")
    counted = hashed.join(F.broadcast(found), "h").groupBy("digest").agg(*_best())
    return common.written(counted.where(F.col("group_size") > 1), "winners")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    keys = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), digest_of(f"`{text_col}`").alias("digest"))
    # row numbers tell repeated rows apart; written, they are the same for every reader
    keys = common.written(keys.withColumn("rid", F.monotonically_increasing_id()), "digests")
    heavy = F.broadcast(heavy_winners(keys))
    hot = keys.join(heavy, "digest")
    rest = keys.join(heavy, "digest", "left_anti")
    groups = common.written(rest.groupBy("digest").agg(*_best()).where("group_size > 1"), "groups")
    cold = rest.join(groups, "digest", "left")
    named = lambda df: df.select(
        "doc_id", "digest", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"),
    )
    return named(cold).unionByName(named(hot))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    What leaves is decided on ids and digests alone. Heavy digests' copies go on the map side, by the
    broadcast winners; the others' by an anti-join with the list of those that leave."""
    key = ["digest", "none", "k"]
    named = lambda i: [i.isNull().alias("none"), F.coalesce(i, F.lit(0).cast("bigint")).alias("k")]
    keys = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), digest_of(f"`{text_col}`").alias("digest"))
    keys = common.written(keys.withColumn("rid", F.monotonically_increasing_id()), "digests")
    winners = heavy_winners(keys)
    heavy = F.broadcast(winners)
    rest = keys.join(heavy, "digest", "left_anti")
    groups = common.written(rest.groupBy("digest").agg(*_best()).where("group_size > 1"), "groups")
    differs = ~F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    gone = rest.join(groups, "digest").where(differs).select("digest", *named(F.col("doc_id"))).distinct()
    # rows that repeat the one that stays, id and all: told by their number and settled on their own
    both = groups.unionByName(winners)
    again = keys.join(F.broadcast(winners), "digest").unionByName(rest.join(groups, "digest")).where(~differs).groupBy("digest").count().where("count > 1")
    again = common.written(again.join(both, "digest").select("digest", *named(F.col("best.doc_id"))), "again")
    gone = common.written(gone.unionByName(again), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), digest_of(f"`{text_col}`").alias("digest"))
    rows = rows.join(heavy, "digest", "left").where(F.col("best").isNull() | ~differs).select("row", "digest", *named(F.col("doc_id")))
    # the list grows with the rows, so it is never broadcast, at no size
    left = rows.join(gone.hint("merge"), key, "left_anti").select("row")
    if not again.isEmpty():
        one = rows.join(again, key, "left_semi").groupBy(key).agg(F.min_by("row", common.row_hash()).alias("row"))
        left = left.unionByName(one.select("row"))
    return left.select("row.*")


def digest(annotated: DataFrame) -> DataFrame:
    return annotated.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
