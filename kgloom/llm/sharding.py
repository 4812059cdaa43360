"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so copies of one text lie side by side. The
splitters between shards are found without sorting: candidate keys (probes) are laid into the
interval in which each splitter must lie, one pass counts the exact bytes and rows below every
probe over all partitions, and the interval shrinks, until the bytes below a probe meet the
splitter's target. Only then the rows are exchanged, once, by the interval they fall into.

A shard is cut into several intervals, as many as keep the exchange even; each is found in the
same way. Counts below the splitters give each interval its first slot, so slots are gapless
without a task ever holding a whole shard.

The law is ``bytes``: shards have near equal sizes. A splitter stops inside ``tolerance`` of its
target (a share of one shard) or where no key lies any closer. Equal texts share a shard unless
the cut has to pass through their group to meet the law.

Defined results: a null text has no bytes and size 1; a null doc_id orders first; rows equal in
text and doc_id stay together in any order and are never cut apart; a very long text is one row, by
whose size a shard may miss its target; an empty table gives no rows; other columns travel along
unchanged in ``shard``, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm import common

SHARDS = 16
#: Shares of a shard by which the bytes below a splitter may miss their target.
TOLERANCE, INNER_TOLERANCE = 0.001, 0.1
#: Share of a shard that may be given up to keep a group of equal texts in one shard.
GROUP_TOLERANCE = 0.01
#: Candidate keys laid into each open interval, a pass.
PROBES = 15
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_SPAN = 1 << 64


def _key(h: int, d: int) -> int:
    """One ordered integer for (hash, doc_id), both signed 64-bit."""
    return ((h - LOW) << 64) | (d - LOW)


def _unkey(k: int) -> tuple[int, int]:
    return (k >> 64) + LOW, (k & (_SPAN - 1)) + LOW


def below(h: np.ndarray, d: np.ndarray, probe_h: np.ndarray, probe_d: np.ndarray) -> np.ndarray:
    """For each row the number of probes at or below its key; probes ascend."""
    out = np.searchsorted(probe_h, h, "left")
    last = np.searchsorted(probe_h, h, "right")
    for i in np.unique(out[last > out]):  # hashes that a probe names: few
        rows = np.flatnonzero((out == i) & (last > out))
        out[rows] = i + np.searchsorted(probe_d[i : last[rows[0]]], d[rows], "right")
    return out


def counts_below(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Exact bytes and rows strictly below each probe, over all partitions, and for each gap
    between probes that holds rows the keys between which they lie. keys: (h, d, size)."""
    ph = np.array([_unkey(k)[0] for k in probes], np.int64)
    pd_ = np.array([_unkey(k)[1] for k in probes], np.int64)

    def run(batches):
        n = len(ph) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full((2, n), HIGH), np.full((2, n), LOW)
        for b in batches:
            h, d, s = (b.column(i).to_numpy() for i in range(3))
            at = below(h, d, ph, pd_)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=n)
            for k, x in enumerate((h, d)):
                np.minimum.at(least[k], at, x)
                np.maximum.at(most[k], at, x)
        hit = np.flatnonzero(rows)
        cols = [hit, size[hit], rows[hit], least[0][hit], most[0][hit], least[1][hit], most[1][hit]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    names = ["bin", "size", "rows", "h0", "h1", "d0", "d1"]
    got = keys.select("h", "d", "size").mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
    got = got.groupBy("bin").agg(F.sum("size"), F.sum("rows"), F.min("h0"), F.max("h1"), F.min("d0"), F.max("d1")).collect()
    size, rows, spans = [0] * (len(probes) + 1), [0] * (len(probes) + 1), {}
    for b, s, r, h0, h1, d0, d1 in got:
        size[b], rows[b] = s, r
        spans[b] = (_key(h0, d0), _key(h1, d1)) if h0 == h1 else (_key(h0, LOW), _key(h1, HIGH))
    return np.cumsum(size[:-1]).tolist(), np.cumsum(rows[:-1]).tolist(), spans


def splitters(keys: DataFrame, cuts: int, inner: int, total: int, rows: int) -> list[tuple[int, int]]:
    """(key, rows below it) of cuts * inner - 1 splitters; every inner-th parts two shards."""
    n, one = cuts * inner, total / cuts
    want = [total * j / n for j in range(1, n)]
    tol = [(TOLERANCE if j % inner == 0 else INNER_TOLERANCE / inner) * one for j in range(1, n)]
    #: key interval with the exact (bytes, rows) below its ends
    low, high = [(0, 0, 0)] * len(want), [(1 << 128, total, rows)] * len(want)
    done: list[tuple[int, int] | None] = [None] * len(want)
    while open_ := [i for i, x in enumerate(done) if x is None]:
        probes = set()
        for i in open_:
            (a, below_a, _), (b, below_b, _) = low[i], high[i]
            # the first probe follows the share of bytes, in case keys are even; the rest cut the interval evenly
            near = a + int((b - a) * ((want[i] - below_a) / max(below_b - below_a, 1)))
            step = max((b - a) // (PROBES + 1), 1)
            probes |= {p for p in (*range(a + step, b, step), near) if a < p < b}
        probes = sorted(probes)
        size, count, spans = counts_below(keys, probes)
        for i in open_:
            # bytes below the probes ascend with them
            j, k = bisect_right(size, want[i]) - 1, bisect_left(size, want[i])
            if j >= 0 and probes[j] > low[i][0]:
                low[i] = probes[j], size[j], count[j]
            if k < len(probes) and probes[k] < high[i][0]:
                high[i] = probes[k], size[k], count[k]
            # no row lies outside the span, so the counts hold at its ends too
            if span := spans.get(bisect_right(probes, low[i][0])):
                low[i] = (max(low[i][0], span[0]), *low[i][1:])
                high[i] = (min(high[i][0], span[1] + 1), *high[i][1:])
            best = min(low[i], high[i], key=lambda x: abs(x[1] - want[i]))
            miss, one_text = abs(best[1] - want[i]), low[i][0] >> 64 == (high[i][0] - 1) >> 64
            if miss <= tol[i] or one_text and miss <= GROUP_TOLERANCE * one or high[i][2] - low[i][2] <= 1 or high[i][0] - low[i][0] <= 1:
                done[i] = best[0], best[2]
    return done


def shard(docs: DataFrame, shards: int = SHARDS, inner: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``shard`` (int) and ``slot`` (bigint, gapless from 0 in each shard) in front."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h, d = F.xxhash64(text), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LOW))
    keys = common.written(docs.select(h.alias("h"), d.alias("d"), (F.octet_length(text).cast("bigint") + 1).alias("size")), "sharding")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).collect()[0]
    inner = inner or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    cut = sorted(splitters(keys, shards, inner, total, rows)) if rows else []
    ph = np.array([_unkey(k)[0] for k, _ in cut], np.int64)
    pd_ = np.array([_unkey(k)[1] for k, _ in cut], np.int64)

    @F.pandas_udf("int")
    def interval(hs: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series(below(hs.to_numpy(np.int64), ds.to_numpy(np.int64), ph, pd_).astype(np.int32))

    first = [0, *(r for _, r in cut)]  # rows below each interval
    starts = common.driver_table(spark, [(i, n - first[i // inner * inner]) for i, n in enumerate(first)], "i int, start bigint")
    inside = docs.select(F.struct("*").alias("row"), h.alias("h"), d.alias("d")).withColumn("i", interval("h", "d"))
    dealt = inside.repartitionById(shards * inner, "i")  # the one exchange
    order = Window.partitionBy("i").orderBy("h", "d")
    placed = dealt.withColumn("place", F.row_number().over(order) - 1).join(starts, "i")
    return placed.withColumn("slot", (F.col("place") + F.col("start")).cast("bigint")).select(F.floor(F.col("i") / inner).cast("int").alias("shard"), "slot", "row")


def digest(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    return sharded.select(
        F.col(f"row.{id_col}").alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
