"""Algebra of alignments: keyed sets of (source, target, relation) with a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.model import KEY, alignment
from kgloom.operators.order import placed
from kgloom.operators.settle import settled


def upsert(*alignments: DataFrame) -> DataFrame:
    """Union by key; the highest confidence stays and the first row's other fields.

    "First" follows ``seq`` inside an alignment and the order of the arguments between them.
    One aggregate with map-side combining."""
    parts = [alignment(a).withColumn("_turn", F.lit(i)) for i, a in enumerate(alignments)]
    rows = reduce(DataFrame.unionByName, parts)
    order = F.struct("_turn", F.coalesce("seq", F.lit(0).cast("bigint")))
    first = lambda c: F.min_by(c, order).alias(c)
    return rows.groupBy(*KEY).agg(F.max("confidence").alias("confidence"), first("extensions"), F.min(F.struct("_turn", "seq"))["seq"].alias("seq"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(*KEY).distinct(), KEY, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_semi")


contains = intersection  # the rows of a that b contains


def remove_trivial(a: DataFrame) -> DataFrame:
    """Without rows that map an entity to itself."""
    return a.where(F.col("source") != F.col("target"))


def at_least(a: DataFrame, threshold: float) -> DataFrame:
    return a.where(F.col("confidence") >= threshold)


def distinct_confidences(a: DataFrame) -> DataFrame:
    return a.select("confidence").distinct()


def size(a: DataFrame) -> DataFrame:
    """One row with the number of distinct keys."""
    return a.agg(F.count_distinct(F.struct(*KEY)).alias("size"))


def of_source(a: DataFrame, uri: str) -> DataFrame:
    return a.where(F.col("source") == uri)


def of_target(a: DataFrame, uri: str) -> DataFrame:
    return a.where(F.col("target") == uri)


def by_confidence(a: DataFrame) -> DataFrame:
    """Sorted by falling confidence, then source, target, relation."""
    return a.orderBy(F.desc("confidence"), "source", "target", "relation")


def with_place(a: DataFrame) -> DataFrame:
    """Every row with its place, from 1, in the order of ``by_confidence``: no row has to meet another in a
    single task, and none is left out."""
    return placed(settled(a), [F.desc("confidence"), F.asc("source"), F.asc("target"), F.asc("relation")])


def rank_cap(a: DataFrame, n: int) -> DataFrame:
    """Keeps a row if neither of its two entities has occurred more than n times up to it.

    The walk is by falling confidence, source, target, relation. An entity has one counter for
    both roles and every row counts, kept or not; a row that maps an entity to itself counts
    twice. So this is no greedy assignment: a row dropped for one end still uses up the other.

    Both ends are laid out as one column of entities with the row's place in the walk: the sort key
    itself, compared as a struct. They are dealt by ranges of (entity, place), so an entity of very
    many rows spreads over several ranges; running counts inside a range, and the entity's totals of
    its ranges before, which are few, add up to the count after each row.
    """
    place = F.struct((-F.col("confidence")).alias("c"), F.col("source").alias("s"), F.col("target").alias("t"), F.col("relation").alias("r"))
    ends = a.select(place.alias("_at"), F.explode(F.array("source", "target")).alias("_uri"))
    # written: the ranges are sampled, and every use must see the same
    ends = settled(ends.repartitionByRange("_uri", "_at").withColumn("_range", F.spark_partition_id()))
    # the default frame with an order is by range: rows of equal place count together
    inside = ends.withColumn("_n", F.count("*").over(Window.partitionBy("_range", "_uri").orderBy("_at")))
    totals = ends.groupBy("_uri", "_range").agg(F.count("*").alias("_all"))
    earlier = Window.partitionBy("_uri").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.sum("_all").over(earlier)).where("_base > 0").select("_uri", "_range", "_base")
    counted = inside.join(base, ["_uri", "_range"], "left").withColumn("_n", F.col("_n") + F.coalesce("_base", F.lit(0).cast("bigint")))
    kept = counted.groupBy("_at").agg(F.max("_n").alias("_n")).where(F.col("_n") <= n).select(F.col("_at.s").alias("source"), F.col("_at.t").alias("target"), F.col("_at.r").alias("relation"))
    return a.join(kept, KEY, "left_semi")


def double_annotated(a: DataFrame) -> DataFrame:
    """Pairs with more than one relation."""
    n = F.count_distinct("relation")
    return a.groupBy("source", "target").agg(n.alias("n_relations")).where(F.col("n_relations") > 1)


def relation_histogram(a: DataFrame, *by: str) -> DataFrame:
    return a.groupBy(*by, "relation").agg(F.count("*").alias("n"))


def relation_pivot(a: DataFrame, by: str, relations: list[str]) -> DataFrame:
    """A row per ``by`` with a column per relation and the total."""
    counts = [F.count_if(F.col("relation") == r).alias(r) for r in relations]
    return a.groupBy(by).agg(F.count("*").alias("total"), *counts)
