"""Shared helpers: scratch tables in the shared checkpoint folder, and prefix sums over partitions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Scratch folders that are still in place, in the order they were made, and what deletes them: the JVM and
#: the Hadoop configuration, which outlive the session.
_live: list[str] = []
_hadoop: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of this machine only where it is unset and
    the session has no other machine (tests). On a cluster without it there is no shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage ends
    there, so a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kgloom-{name}-{uuid.uuid4().hex}"
    _hadoop[:] = [spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()]
    _live.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_live)


def release(since: int = 0, until: int | None = None) -> None:
    """Deletes scratch tables made between two marks. Only for tables that no lazy frame reads any more."""
    until = len(_live) if until is None else until
    if not _live[since:until]:
        return
    jvm, conf = _hadoop
    for path in _live[since:until]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _live[since:until]


def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM is gone before
        pass


atexit.register(_release_at_exit)


def bases(totals: dict[int, int]) -> dict[int, int]:
    """Exclusive prefix sums in key order."""
    out, at = {}, 0
    for k in sorted(totals):
        out[k] = at
        at += totals[k]
    return out


#: Rows up to which a driver-made table may be broadcast (some 20 MB at two or three numbers a row).
BROADCAST_ROWS = 1_000_000


def driver_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table made on the driver, broadcast in joins only where its row count is within the bound."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def with_base(df: DataFrame, part: str, amount: str, out: str) -> DataFrame:
    """Adds the sum of ``amount`` over all lower partitions. ``df`` must be a written table.

    One row per partition comes to the driver; the number of partitions is the number of tasks
    of the writing stage, which Spark's driver tracks anyway. The small table goes back as a
    broadcast, or through an ordinary join where it is too long for that.
    """
    spark = df.sparkSession
    sums = {r[0]: r[1] for r in df.groupBy(part).agg(F.sum(amount)).collect()}
    kind = dict(df.dtypes)[part]
    base = driver_table(spark, list(bases(sums).items()), f"`{part}` {kind}, `{out}` bigint")
    return df.join(base, part)


def placed(df: DataFrame, order: list[str], name: str, at: str) -> DataFrame:
    """Adds each row's place in the order of the named columns (ascending, nulls first), gapless from 0.

    Rows are cut by ranges of the whole order, so a key with many rows spreads over many tasks; each
    partition is sorted and written, and its first place is the sum of the totals before it. ``df``
    should be a written table, as the ranges are sampled from it first."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id())
    laid = written(laid, name).withColumn("part", F.shiftright("rid", 33)).withColumn("one", F.lit(1).cast("bigint"))
    based = with_base(laid, "part", "one", "base")
    return based.withColumn(at, F.col("base") + F.col("rid").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, at)


#: Rows of one group of a running sum.
SPAN = 1 << 10


def running(df: DataFrame, at: str, amounts: list[str], n: int) -> DataFrame:
    """Adds to each of the n rows, whose places ``at`` are gapless from 0, the sums ``<amount>_to`` of the
    amounts up to and with its own. Groups of SPAN consecutive places are summed each for itself, and their
    totals are summed in the same way, so no group grows with n and nothing comes to the driver."""
    block = F.floor(F.col(at) / SPAN)
    within = Window.partitionBy("block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("block", block).select("*", *[F.sum(a).over(within).alias(f"{a}_to") for a in amounts])
    if n <= SPAN:
        return out.drop("block")
    totals = df.groupBy(block.alias("up")).agg(*[F.sum(a).alias(a) for a in amounts])
    totals = running(totals, "up", amounts, -(-n // SPAN)).select(F.col("up").alias("block"), *[(F.col(f"{a}_to") - F.col(a)).alias(f"{a}_before") for a in amounts])
    sums = {f"{a}_to": F.col(f"{a}_to") + F.col(f"{a}_before") for a in amounts}
    return out.join(totals, "block").withColumns(sums).drop("block", *[f"{a}_before" for a in amounts])


def crc32_of(ids: str, start, length) -> F.Column:
    """crc32 of ``length`` little-endian 32-bit ids from position ``start`` of a binary column."""
    return F.crc32(F.substring(F.col(ids), (start * 4 + 1).cast("int"), (length * 4).cast("int")))


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text."""
    byte = "list_reduce(list_prepend(xor(a, b), [0::BIGINT for z in range(8)]), lambda c, d: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"[ascii(s)::BIGINT for s in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {byte}), 4294967295)"


def row_hash(row: str = "row") -> F.Column:
    """A hash of a whole row, of whatever types: by its JSON, as maps have no hash."""
    return F.xxhash64(F.to_json(F.col(row), {"ignoreNullFields": "false"}))


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; any other column of the input, whatever its name, is left out."""
    return df.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()])
