"""Similarity joins over vectors: the top k targets of every source, and of every target too.

A target side of checked size is sent to every task once, and sources stream past it. Beyond that size
both sides are clustered around shared centers and cut into blocks, written once. A task holds a group of blocks
of sources and lets target blocks stream past it, the most promising first, with a running top k; a target
block whose bound can't reach the k-th score of any source is skipped. A first pass over the nearest
blocks gives the k-th scores by which whole pairs of blocks are left out before any vector moves. What is
skipped can't be in a result: results are those of the full join.

Scores are rounded before ranking, so that the order of float sums can't decide a rank; ties go to the
lesser id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kgloom.functions.text import l2_normalized, sublist_positions
from kgloom.operators.settle import scratch

#: Decimal places of a score, rows of a block, bytes of a side that is sent to every task, cells of a product.
DIGITS, BLOCK, SIDE, CELLS = 6, 2048, 64 << 20, 1 << 20
#: Centers, vectors from which they are made, rounds to make them.
CENTERS, SAMPLE, LLOYD = 256, 8192, 5
#: Sources that a task holds while targets stream past it: at least where there are many, and at most.
HELD, MOST = 4096, 1 << 16


def unit(vectors: DataFrame, id_col: str = "id", v_col: str = "v") -> DataFrame:
    return vectors.select(F.col(id_col).cast("string").alias("id"), l2_normalized(F.col(v_col)).alias("v"))


def _best(scored: DataFrame, k: int, of: str = "source", by: str = "target") -> DataFrame:
    w = Window.partitionBy(of).orderBy(F.desc("confidence"), by)
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _leaders(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best k columns of every row, best first; ties go to the first column."""
    if score.shape[1] > 4 * k:  # candidates by a partial sort: all that reach the k-th value, ties with it
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(score >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(score.shape))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


class _Best:
    """The running top k of rows that other ids stream past: scores and ids, best first."""

    def __init__(self, rows: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.score, self.ids = np.full((rows, k), -np.inf), np.full((rows, k), None, object)
        self.least = np.full(rows, -np.inf) if least is None else least  # what a row has elsewhere already

    def bar(self) -> np.ndarray:
        """A score below a row's bar is not among its best."""
        return np.maximum(self.score[:, -1], self.least)

    def meet(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Products, not yet rounded, of some rows with ids that are in order."""
        bar = self.bar()[rows]
        hit = score >= (bar - 10.0**-DIGITS)[:, None]
        n = np.count_nonzero(hit)
        if n > 4 * self.k * len(rows):
            score = np.round(score, DIGITS) + 0.0
            i, j = _leaders(score, self.k)
            value = score[i, j]
        else:
            i, j = np.nonzero(hit)
            value = np.round(score[i, j], DIGITS) + 0.0
        keep = value >= bar[i]
        i, j, value = i[keep], j[keep], value[keep]
        if not len(i):
            return
        touched, at = np.unique(rows[i], return_inverse=True)
        have = np.concatenate([self.score[touched].ravel(), value])
        name = np.concatenate([self.ids[touched].ravel(), ids[j]])
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        real = np.flatnonzero(have > -np.inf)
        order = real[np.lexsort((-have[real], row[real]))]
        if ((row[order][1:] == row[order][:-1]) & (have[order][1:] == have[order][:-1])).any():  # ids decide ties
            order = real[np.lexsort((np.unique(name[real], return_inverse=True)[1], -have[real], row[real]))]
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, place = order[place < self.k], place[place < self.k]
        self.score[touched], self.ids[touched] = -np.inf, None
        self.score[touched[row[order]], place], self.ids[touched[row[order]], place] = have[order], name[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of all that is held."""
        i, j = np.nonzero(self.score > -np.inf)
        return i, self.ids[i, j], self.score[i, j]


def _matrix(v, n: int) -> np.ndarray:
    if not n:
        return np.zeros((0, 0))
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


SCORED = "source string, target string, confidence double"


def _beside(source: DataFrame, target: DataFrame, k: int, both: bool) -> DataFrame:
    """(back, source, target, confidence): sources stream past the whole target side, which every task has."""
    held = target.select("id", "v").toArrow().combine_chunks()
    ids = np.array(held.column("id").to_pylist(), object)
    order = np.argsort(ids, kind="stable")
    sent = source.sparkSession.sparkContext.broadcast((ids[order], _matrix(held.column("v"), len(ids))[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y = sent.value
        back = _Best(len(names), k) if both else None

        def rows(back: bool, source, target, score) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(score), back)), pa.array(source, pa.string()), pa.array(target, pa.string()), pa.array(score, pa.float64())], ["back", "source", "target", "confidence"])

        high, wide = 1024, CELLS >> 10
        for b in batches:
            mine, x = np.array(b.column("id").to_pylist(), object), _matrix(b.column("v"), b.num_rows)
            order = np.argsort(mine, kind="stable")
            mine, x = mine[order], x[order] if len(order) else x
            for a in range(0, len(mine) if len(names) else 0, high):
                own, some = mine[a : a + high], x[a : a + high]
                best, every = _Best(len(own), k), np.arange(len(own))
                for c in range(0, len(names), wide):
                    score = some @ y[c : c + wide].T
                    best.meet(every, score, names[c : c + wide])
                    if back is not None:
                        back.meet(np.arange(c, c + score.shape[1]), score.T, own)
                i, who, score = best.found()
                yield rows(False, own[i], who, score)
        if back is not None:
            i, who, score = back.found()
            yield rows(True, who, names[i], score)

    return source.select("id", "v").mapInArrow(run, "back boolean, " + SCORED)


def _centers(vectors: DataFrame) -> np.ndarray:
    """At most CENTERS points, by a few rounds of k-means over at most SAMPLE vectors that a hash of their id picks.
    They shape blocks alone; no result depends on them."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().combine_chunks().column("v")
    x = _matrix(some, len(some))
    if not len(x):
        return x
    c, far = x[:1], np.full(len(x), np.inf)
    while len(c) < min(CENTERS, len(x) // 16):  # each new one is the point farthest from the others
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
        c = np.concatenate([c, x[far.argmax()][None]])
    for _ in range(LLOYD):
        near = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _blocks(vectors: DataFrame, centers, block: int) -> DataFrame:
    """(block, cluster, radius, norm, n, ids, v): the vectors near a center in blocks of some ``block`` rows, ids in order,
    with the greatest distance from the center and the greatest norm. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        for b in batches:
            x = _matrix(b.column("v"), b.num_rows)
            near = (2 * x @ c.T - (c * c).sum(1)).argmax(1).astype(np.int32)
            far = np.linalg.norm(x - c[near], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near), pa.array(far), pa.array(np.linalg.norm(x, axis=1))], ["id", "v", "cluster", "far", "norm"])

    near = _kept(vectors.select("id", "v").mapInArrow(run, "id string, v array<double>, cluster int, far double, norm double"))
    counts = near.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("cuts"))  # a row a center
    cut = near.join(F.broadcast(counts), "cluster").withColumn("cut", F.pmod(F.xxhash64("id"), "cuts"))
    rows = F.array_sort(F.collect_list(F.struct("id", "v")))
    made = cut.groupBy("cluster", "cut").agg(F.max("far").alias("radius"), F.max("norm").alias("norm"), rows.alias("rows"))
    made = made.select(F.monotonically_increasing_id().alias("block"), "cluster", "radius", "norm", F.size("rows").alias("n"), F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("v"))
    return _kept(made)


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "vectors")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Search:
    """found: (source, target, confidence); of ``pairs`` pairs of blocks the products of ``taken`` were sent to be taken."""

    found: DataFrame
    pairs: int
    taken: int


def search(source: DataFrame, target: DataFrame, k: int, block: int = BLOCK) -> Search:
    """The exact top k targets of every source by pruned products of blocks, whatever the sides' sizes."""
    sc, points = source.sparkSession.sparkContext, _centers(target)
    if not len(points):
        return Search(source.sparkSession.createDataFrame([], SCORED), 0, 0)
    centers = sc.broadcast(points)
    a, b = _blocks(source, centers, block), _blocks(target, centers, block)
    # a row a target block, of three numbers: 24 bytes for every BLOCK vectors
    heads = b.select("block", "cluster", "radius", "n").toArrow().combine_chunks()
    heads = sc.broadcast(tuple(heads.column(c).to_numpy() for c in ("block", "cluster", "radius", "n")))

    def pairs_of(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, (name, cluster, radius, n) = centers.value, heads.value
            for batch in batches:
                for x, own, r, norm, bar in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    # x.y <= a.c + |x - a| |c| + |x| |y - c| for the centers a and c
                    bound = c[cluster] @ c[own] + r * np.linalg.norm(c[cluster], axis=1) + norm * radius
                    order = np.lexsort((name, -bound))
                    near = max(2, int(np.searchsorted(np.cumsum(n[order]), k)) + 1)
                    chosen = order[:near] if first else order[near:][bound[order[near:]] >= bar - 10.0**-DIGITS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), x)), pa.array(name[chosen]), pa.array(np.arange(len(chosen)))], ["a", "b", "seq"])

        return run

    def taken(pairs: DataFrame, bars: DataFrame, but: DataFrame | None = None) -> DataFrame:
        """(a, bars, source, target, confidence arrays): one row a source block. Target blocks are sent to a group of
        source blocks once, however many of them they serve, and not where they were sent for the pairs ``but``."""
        sent = pairs.join(group, "a").groupBy("g", "b").agg(F.min("seq").alias("seq"))
        if but is not None:
            sent = sent.join(but.join(group, "a").select("g", "b").distinct(), ["g", "b"], "left_anti")
        mine = group.join(sent.select("g").distinct(), "g", "left_semi").join(a.withColumnRenamed("block", "a"), "a").join(bars, "a", "left")
        mine = mine.select("g", F.lit(-1).cast("bigint").alias("seq"), "a", "ids", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("radius"), "bars")
        theirs = sent.join(b.withColumnRenamed("block", "b"), "b").select("g", "seq", F.col("b").alias("a"), "ids", "v", "cluster", "radius", F.lit(None).cast("array<double>").alias("bars"))
        stream = mine.unionByName(theirs).repartitionById(groups, "g").sortWithinPartitions("g", "seq", "a")
        return stream.mapInArrow(run, "a bigint, bars array<double>, source array<string>, target array<string>, confidence array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, mine, held, of = centers.value, [], None, None  # blocks of a group; what they hold together; the group

        def gathered() -> tuple[np.ndarray, np.ndarray, _Best, np.ndarray]:
            ids, x = np.concatenate([m[1] for m in mine]), np.concatenate([m[2] for m in mine])
            least = None if mine[0][3] is None else np.concatenate([m[3] for m in mine])
            return ids, x, _Best(len(ids), k, least), np.linalg.norm(x, axis=1)

        def done() -> Iterator[pa.RecordBatch]:
            ids, _, best, _ = held
            i, who, score = best.found()
            at = 0
            for name, own, _, _ in mine:
                lo, hi = np.searchsorted(i, (at, at + len(own)))
                cols = [pa.array([name]), pa.array([best.score[at : at + len(own), -1]], pa.list_(pa.float64()))]
                cols += [pa.array([ids[i[lo:hi]]], pa.list_(pa.string())), pa.array([who[lo:hi]], pa.list_(pa.string())), pa.array([score[lo:hi]], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["a", "bars", "source", "target", "confidence"])
                at += len(own)

        for batch in batches:
            for n in range(batch.num_rows):
                at = {name: batch.column(name)[n] for name in batch.schema.names}
                ids = np.array(at["ids"].as_py(), object)
                v = np.asarray(at["v"].values, float).reshape(len(ids), -1)
                if at["g"].as_py() != of:
                    if held is not None:
                        yield from done()
                    mine, held, of = [], None, at["g"].as_py()
                if at["seq"].as_py() < 0:
                    bars = at["bars"].as_py()
                    mine.append((at["a"].as_py(), ids, v, None if bars is None else np.array(bars)))
                    continue
                held = held or gathered()
                _, x, best, norm = held
                reach = x @ c[at["cluster"].as_py()] + norm * at["radius"].as_py() + 10.0**-DIGITS
                rows, step = np.flatnonzero(reach >= best.bar()), max(1, CELLS // len(ids))
                for r in range(0, len(rows), step):
                    some = rows[r : r + step]
                    best.meet(some, x[some] @ v.T, ids)
        if held is not None:
            yield from done()

    # a row a source block: blocks of like clusters in groups of about as many rows as a task is to hold
    of = sorted(((r["cluster"], r["block"], r["n"]) for r in a.select("cluster", "block", "n").collect()))
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    room, ends = min(MOST, max(HELD, block, -(-sum(n for *_, n in of) // tasks))), np.cumsum([n for *_, n in of])
    named = [(x, int((end - n) // room)) for (_, x, n), end in zip(of, ends)]
    groups = 1 + max((g for _, g in named), default=0)
    group = F.broadcast(source.sparkSession.createDataFrame(named, "a bigint, g int"))
    head = a.select("block", "cluster", "radius", "norm")
    pairs = "a bigint, b bigint, seq bigint"
    none = source.sparkSession.createDataFrame([], "a bigint, bars array<double>")
    near = _kept(head.withColumn("bar", F.lit(0.0)).mapInArrow(pairs_of(True), pairs))
    first = _kept(taken(near, none))
    bars = first.select("a", "bars")
    rest = head.join(bars.withColumnRenamed("a", "block"), "block").withColumn("bar", F.array_min("bars")).drop("bars")
    rest = _kept(rest.mapInArrow(pairs_of(False), pairs))
    second = taken(rest, bars, near)
    flat = lambda df: df.select(F.explode(F.arrays_zip("source", "target", "confidence")).alias("x")).select("x.*")
    return Search(_best(flat(first).unionByName(flat(second)), k), a.count() * b.count(), near.count() + rest.count())


def _fits(side: DataFrame, most: int) -> bool:
    n, dim = side.agg(F.count("*"), F.max(F.size("v"))).first()
    return n * (8 * (dim or 0) + 64) <= most


def _distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, v): the least id of every vector, and (rep, id) of all that have it; None where no two are equal. Written."""
    known = _kept(vectors.select("id", "v"))
    classes = _kept(known.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n"))
    rows, n = classes.agg(F.sum("n"), F.count("*")).first()
    one = classes.select("id", "v").repartition(max(1, min(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // HELD))))
    return one, None if n == (rows or 0) else _kept(known.join(classes.select(F.col("id").alias("rep"), "v"), "v").select("rep", "id"))


def _every(found: DataFrame, k: int, of: str, by: str, of_all: DataFrame | None, by_all: DataFrame | None) -> DataFrame:
    """The top k of all rows from those of the least id of every vector: no row beyond the k least ids of a vector is
    among the best, and none of a vector whose least id is not."""
    if by_all is not None:
        least = by_all.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("_r") <= k)
        found = found.join(least.select(F.col("rep").alias(by), F.col("id").alias("_id")), by).select(of, F.col("_id").alias(by), "confidence")
        found = _best(found, k, of, by)
    if of_all is not None:
        found = found.join(of_all.select(F.col("rep").alias(of), F.col("id").alias("_id")), of).select(F.col("_id").alias(of), by, "confidence")
    return found.select("source", "target", "confidence")


def _top(source: DataFrame, target: DataFrame, k: int, block: int, side: int) -> DataFrame:
    if _fits(target, side):
        return _best(_beside(source, target, k, False).drop("back"), k)
    return search(source, target, k, block).found


def top_k(source: DataFrame, target: DataFrame, k: int, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """(source, target, confidence). ``source`` and ``target`` are (id, v), ids distinct; a target side of up to
    ``side`` bytes is sent to every task. Equal vectors are compared once."""
    (s, sources), (t, targets) = _distinct(source), _distinct(target)
    return _every(_top(s, t, k, block, side), k, "source", "target", sources, targets)


def top_k_both(source: DataFrame, target: DataFrame, k: int, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """(source, target, confidence): the union of every source's best targets and every target's best
    sources. A pair that is both comes once. Where a side is sent to every task, a product serves both ways."""
    (s, sources), (t, targets) = _distinct(source), _distinct(target)
    if _fits(t, side):
        found = _kept(_beside(s, t, k, True))
        there, back = _best(found.where("not back").drop("back"), k), _best(found.where("back").drop("back"), k, "target", "source")
    else:
        there = _top(s, t, k, block, side)
        back = _top(t, s, k, block, side).select(F.col("target").alias("source"), F.col("source").alias("target"), "confidence")
    found = _every(there, k, "source", "target", sources, targets).unionByName(_every(back, k, "target", "source", targets, sources))
    return found.groupBy("source", "target").agg(F.max("confidence").alias("confidence"))


# --- encoders -----------------------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """A deterministic stand-in for a sentence encoder: signed hashes of words. No model quality."""

    def load() -> Encoder:
        import xxhash

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    out[i, h % dim] += 1 if h >> 63 else -1
            return out

        return encode

    return load


def encode(texts: DataFrame, load: Callable[[], Encoder], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, v): unit vectors. ``load`` runs once per task and returns texts -> matrix, so a model is
    loaded once and batches are as large as Arrow's. Persist the result before using it twice."""

    def run(batches):
        encoder = load()
        for b in batches:
            v = np.asarray(encoder([t or "" for t in b.column(1).to_pylist()]), float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, n, out=v, where=n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])

    return texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id string, v array<double>")


POOLING = (
    "sentence", "cls", "firstmean", "allmean", "firstmax", "allmax",
    "firstmeanspecial", "allmeanspecial", "firstmeancls", "allmeancls", "firstmeanclssep", "allmeanclssep",
)


def pool(tokens: DataFrame, method: str = "mean") -> DataFrame:
    """Unit vectors from token vectors: (id, position, masked, v) -> (id, v).

    mean and max over the masked tokens, cls takes the token at position 0. Vectors of an id are added up,
    or their maxima taken, a batch at a time before they move; what is left of an id is a vector a batch."""
    if method not in ("mean", "max", "cls"):
        raise ValueError(f"unknown pooling {method!r}, not one of mean, max, cls")
    rows = tokens.where(F.col("position") == 0) if method == "cls" else tokens.where("masked")
    put = np.maximum if method == "max" else np.add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = b.column("id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))
                x = put.reduceat(_matrix(b.column("v"), b.num_rows)[order], starts, axis=0)
                n = np.diff(np.append(starts, len(order)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(order[starts])), pa.array(list(x), pa.list_(pa.float64())), pa.array(n)], ["id", "x", "n"])

    some = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    some = some.mapInArrow(run, some.select("id").schema.add("x", T.ArrayType(T.DoubleType())).add("n", T.LongType()))
    met = some.groupBy("id").agg(F.collect_list("x").alias("xs"), F.sum("n").alias("n"))
    both = (lambda p, q: F.greatest(p, q)) if method == "max" else (lambda p, q: p + q)
    v = F.aggregate(F.slice("xs", 2, F.size("xs")), F.col("xs")[0], lambda a, x: F.zip_with(a, x, both))
    return met.select("id", l2_normalized(v if method == "max" else F.transform(v, lambda x: x / F.col("n"))).alias("v"))


def pooling_parts(name: str) -> tuple[str, bool, str]:
    """(operation, all occurrences, extra tokens) of a pooling name; an unknown one is refused."""
    if name not in POOLING:
        raise ValueError(f"unknown pooling {name!r}, not one of {POOLING}")
    if name in ("sentence", "cls"):
        return name, True, ""
    every, rest = name.startswith("all"), name.removeprefix("all").removeprefix("first")
    op = "max" if rest.startswith("max") else "mean"
    return op, every, rest.removeprefix(op)


def pooled(texts: DataFrame, name: str, special: dict[str, list[int]] | None = None) -> DataFrame:
    """(id, v): unit vectors by a pooling's name.

    ``texts`` is (id, tokens array<int>, focus array<int>, vectors array<array<double>>): a text's token
    ids, those of the entity to look for in it, and a vector a token. The mask is the first or every
    occurrence of the focus, with the special tokens that the name asks for; ``special`` gives their
    ids under "special" (all), "cls" and "sep". Where the focus does not occur and the mask is empty,
    all tokens count. "sentence" is the mean of all tokens, "cls" the vector of the first."""
    op, every, extra = pooling_parts(name)
    special = special or {}
    keep = {"special": special.get("special", []), "cls": special.get("cls", []), "clssep": [*special.get("cls", []), *special.get("sep", [])]}.get(extra, [])
    n = F.size("tokens")
    whole = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    if op in ("sentence", "cls"):
        mask = whole
    else:
        found = sublist_positions(F.col("tokens"), F.col("focus"), not every, F.array(*[F.lit(x) for x in keep]) if keep else None)
        mask = F.when(F.size(found) > 0, found).otherwise(whole)
    rows = texts.select("id", mask.alias("mask"), F.posexplode("vectors").alias("position", "v"))
    return pool(rows.select("id", "position", F.array_contains("mask", F.col("position")).alias("masked"), "v"), "mean" if op == "sentence" else op)
