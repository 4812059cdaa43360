"""Places in a global order and order statistics, without a window or a group that grows with the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.settle import scratch

#: Probes of a group in a round; rows of a table that is broadcast.
PROBES, SMALL = 64, 100_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column], at: str = "place") -> DataFrame:
    """Adds the place of every row in the order, gapless from 1.

    Rows are cut by ranges of the whole order, so no key has to lie in one task; every range is sorted
    and written, and starts at the total of the ranges before it. One number a range comes to the driver."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rid", F.monotonically_increasing_id())
    laid = _written(laid, "places").withColumn("_part", F.shiftright("_rid", 33))
    totals, before, rows = {r[0]: r[1] for r in laid.groupBy("_part").count().collect()}, 0, []
    for part in sorted(totals):
        rows.append((part, before))
        before += totals[part]
    base = df.sparkSession.createDataFrame(rows, "_part bigint, _base bigint")
    placed_ = laid.join(F.broadcast(base) if len(rows) <= SMALL else base, "_part")
    return placed_.select(*df.columns, (F.col("_base") + F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(at))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def selected(df: DataFrame, by: list[str], value: str, ranks: Column) -> DataFrame:
    """(by, n, rank, value): the values at some ranks, from 0, of each group's sorted values. ``ranks`` is an
    array made of the group's size ``n``. Nulls are no values; a group of nulls alone has no row.

    Selection by counted probes: each round takes PROBES values of what is left of a group from a mergeable
    sketch, counts exactly between them, and goes on with the one gap that holds the rank, until all values
    in it are equal. Counts combine before they move, so a group never meets in a task. A round leaves about
    1 / PROBES of the rows, and always less than all, as the greatest value is a probe of its own. Once no more
    than SMALL rows are left of all groups together, which is known from the counts, they are sorted."""
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    groups = values.groupBy(*by).agg(F.count("*").alias("n")).withColumn("rank", F.explode(ranks)).distinct()
    groups = _written(groups.where("rank >= 0 and rank < n").withColumn("sid", F.monotonically_increasing_id()), "ranks")
    left, rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = _small(groups.select("sid", *[F.col(c).alias(f"_{c}") for c in by]), left)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    inside = _written(values.join(named, same).select("sid", "v"), "values")
    state = groups.select("sid", "rank", F.lit(0).cast("bigint").alias("below"))
    found = []
    while left:
        if rows <= SMALL:
            last = inside.groupBy("sid").agg(F.sort_array(F.collect_list("v")).alias("vs")).join(state, "sid")
            found.append(last.select("sid", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("value")))
            break
        steps = [i / PROBES for i in range(PROBES + 1)]
        probes = inside.groupBy("sid").agg(F.array_distinct(F.concat(F.percentile_approx("v", steps, 4 * PROBES), F.array(F.max("v")))).alias("probes"))
        probes = _small(_written(probes, "probes"), left)
        gap = F.size(F.filter("probes", lambda p: p <= F.col("v"))).alias("gap")
        gaps = inside.join(probes, "sid").groupBy("sid", gap).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        # a rank has at most PROBES + 2 gaps
        gaps = gaps.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("gap", "n", "least", "most"))).alias("g")).join(state, "sid")
        upto = F.transform("g", lambda x, i: F.struct(x["n"].alias("n"), x["least"].alias("least"), x["most"].alias("most"), F.aggregate(F.slice("g", 1, i + 1), F.col("below"), lambda t, y: t + y["n"]).alias("end")))
        hit = F.filter(upto, lambda x: x["end"] > F.col("rank"))[0]
        state = gaps.select("sid", "rank", hit.alias("x")).select("sid", "rank", (F.col("x.end") - F.col("x.n")).alias("below"), "x.n", "x.least", "x.most")
        state = _written(state, "gaps")
        found.append(state.where("least <=> most").select("sid", F.col("least").alias("value")))
        state = state.where("not least <=> most")
        left, rows = state.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if left:
            inside = inside.join(_small(state.select("sid", "least", "most"), left), "sid").where("v >= least and v <= most").select("sid", "v")
            inside, state = _written(inside, "gap"), state.select("sid", "rank", "below")
    if not found:
        return groups.drop("sid").withColumn("value", F.lit(None).cast(df.schema[value].dataType))
    return groups.join(reduce(DataFrame.unionByName, found), "sid").drop("sid")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the exact middle value of each group, of an even number the mean of the middle two."""
    middle = F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))
    return selected(df, by, value, middle).groupBy(*by).agg(F.avg("value").alias("median"))
