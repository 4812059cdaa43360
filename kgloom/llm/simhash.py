"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 majority bits over the XXH64 of a text's word shingles. Equal fingerprints
collapse first, so copies are never compared. Distinct fingerprints are grouped by the population
counts of their parts (16 bits each, or 8 from ``FINE`` fingerprints on): two fingerprints within
the radius differ in these counts by no more than the radius, summed over the parts. A group is
cut into tiles; a pair of tiles is compared, by exclusive-or and bit counts in numpy, only if its
counts are that close. All other pairs are skipped unseen, and no link is lost.

Inside a pair of tiles the links are thinned to a spanning forest of stars, and those of a task are
contracted once more, so a crowd of near copies yields fewer links than it has members. Components
come from alternating large and small stars over written tables. Where a key is hot - a fingerprint
of very many copies, a hub, a component's name - one side of the join has a single row of it: minima
are combined on the map side, and Spark's skew join cuts the other side.

Defined results: a null text is empty; a text without words has the zero fingerprint, linked like
any other; a null doc_id loses its component's name to any other; ties of doc_id and repeated rows
share a row of the fingerprint table where their texts do; a very long text is read whole, its bits
summed piece by piece; an empty table gives no rows; other columns are not read, and travel along
unchanged in ``keep_one`` and ``keep_first``, whatever their names.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Fingerprints a tile holds at most, and from how many on the parts are bytes.
TILE, FINE = 2048, 20_000_000
#: New links after which a task contracts those it holds.
LINKS = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: White space at which str.split cuts besides that of WORD.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """Words of a text with A-Z in lower case."""
    text = text.lower() if text.isascii() else text.translate(_LOWER)
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # sums of bytes stay bytes
        counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest as h

    words = words_of(text or "")
    if not words:
        return 0
    if len(words) < shingle:
        return h(" ".join(words), seed)
    columns = [words[i : len(words) - shingle + 1 + i] for i in range(shingle)]
    return majority(np.fromiter((h(" ".join(x), seed) for x in zip(*columns)), np.uint64, len(words) - shingle + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, tie, fp): fp is the 64-bit fingerprint as a signed integer, tie a hash of the text."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "tie", "fp"])

    text = F.col(f"`{text_col}`").cast("string")
    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return read.mapInArrow(run, "doc_id bigint, tie bigint, fp bigint")


def near(shape: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, the half that is not negative first."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(shape):
        out = [(*x, d) for x in out for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in out if x >= (0,) * shape]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; labels name the least position of a component."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, or within one (right is None), thinned to one per member of a
    component: to the component's first member."""
    other, shift = (left, 0) if right is None else (right, len(left))
    labels = None
    rows = max(1, (1 << 19) // max(len(other), 1))
    for i in range(0, len(left), rows):
        hit = np.bitwise_count(left[i : i + rows, None] ^ other[None, :]) <= radius
        if right is None:
            hit &= np.arange(len(left))[None, :] > np.arange(i, min(i + rows, len(left)))[:, None]
        if hit.any():
            labels = np.arange(shift + len(other)) if labels is None else labels
            a, b = np.nonzero(hit)
            merge(labels, i + a, shift + b)
    if labels is None:
        return left[:0], left[:0]
    both = left if right is None else np.concatenate([left, right])
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return both[moved], both[labels[moved]]


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link for each node but the first of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = np.arange(len(nodes))
    merge(labels, at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[moved], nodes[labels[moved]]


def links(fps: DataFrame, count: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) links that connect every two fingerprints within the radius. ``fps`` has distinct ``fp``."""
    width = 8 if count >= FINE else 16
    parts = 64 // width
    # counts of the parts as one integer, a byte each, which keeps differences apart
    sig = None
    for i in range(parts):
        c = F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1)).cast("bigint")
        sig = c if sig is None else sig + c * (1 << (7 * i))
    signed = fps.select("fp", sig.alias("sig"))
    room = F.ceil(F.count("*") / tile)
    piece = signed.groupBy("sig").agg(room.alias("pieces"))
    tiles = signed.join(piece.where("pieces > 1"), "sig", "left")
    tiles = tiles.select("sig", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("pieces")), F.lit(0).cast("bigint")).alias("piece"), "fp")
    tiles = tiles.groupBy("sig", "piece").agg(F.collect_list("fp").alias("fps"))
    tiles = common.written(tiles, "tiles", "uncompressed")
    steps = [sum(d << (7 * i) for i, d in enumerate(x)) for x in near(parts, radius)]
    # the difference of integers determines the difference of counts: counts are at most 16, steps at most 3
    asked = tiles.select(F.col("sig").alias("sig_a"), F.col("piece").alias("piece_a"), F.col("fps").alias("fps_a"), F.explode(F.array(*[F.lit(s).cast("bigint") for s in steps])).alias("step"))
    asked = asked.withColumn("sig", F.col("sig_a") + F.col("step"))
    pairs = asked.join(tiles, "sig").where((F.col("step") != 0) | (F.col("piece_a") <= F.col("piece")))

    def run(batches):
        # a task's links are contracted as they come, so it sends no more of them than it has seen nodes
        a = b = np.zeros(0, np.uint64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def joined():
            return contracted(*(np.concatenate(x) for x in zip((a, b), *fresh)))

        for batch in batches:
            for same, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                p, q = forest(x, None if same else y, radius)
                if len(p):
                    fresh.append((p, q))
                    if sum(len(v) for v, _ in fresh) > LINKS:
                        (a, b), fresh = joined(), []
        a, b = joined()
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (a, b)], ["a", "b"])

    same = (F.col("step") == 0) & (F.col("piece_a") == F.col("piece"))
    return pairs.select(same.alias("same"), "fps_a", "fps").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its least node.

    Alternating stars: a large star links every larger neighbour of a node to its least neighbour,
    a small star every smaller one. Each round is written, so lineage stays short; the rounds grow
    with the logarithm of the nodes. Groups are never gathered: minima are aggregates, joined back.
    It goes on until a round changes nothing; where ``rounds`` run out before, it raises.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now = common.written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"the components have not settled in {rounds} rounds")
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = common.written(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")), "least")
        large = common.written(both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct(), "large")
        least = common.written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        now = common.written(small.where(a != b).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """One row per document: doc_id, tie, fp, component (its least fingerprint), component_id."""
    prints = common.written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    fps = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = common.written(components(common.written(links(fps.select("fp"), fps.count(), radius), "links")), "components")
    named = fps.join(found, fps.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    named = common.written(named, "named")
    names = common.written(named.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    table = common.written(named.join(names, "component").select("fp", "component", "component_id"), "table")
    return prints.join(table, "fp").select("doc_id", "tie", "fp", "component", "component_id")


def groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id of its component)."""
    return _grouped(docs, radius, id_col, text_col, shingle, seed).select("doc_id", "tie", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component, the one with the least doc_id, with all their columns.

    Rows that leave are told by id and text, so repeated rows of the kept document stay: telling
    them apart is for exact deduplication. A row without an id stays."""
    found = groups(docs, radius, id_col, text_col)
    gone = common.written(found.where(F.col("doc_id") > F.col("component_id")).select("doc_id", "tie").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"row.`{text_col}`").cast("string")).alias("tie"))
    return rows.join(gone, ["doc_id", "tie"], "left_anti").select("row.*")


def keep_first(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component, with all its columns: the first by doc_id, nulls last, then
    by a hash of the text; of rows that repeat both, the one whose row has the least hash."""
    key = ["none", "k", "tie"]
    named = lambda i: [i.isNull().alias("none"), F.coalesce(i, F.lit(0).cast("bigint")).alias("k")]
    found = _grouped(docs, radius, id_col, text_col, SHINGLE, SEED)
    counted = common.written(found.select("component", *named(F.col("doc_id")), "tie").groupBy("component", *key).count(), "counted")
    first = counted.groupBy("component").agg(F.min(F.struct(*key)).alias("first"), F.sum("count").alias("rows")).where("rows > 1")
    several = counted.join(first, "component").select(*key, (F.struct(*key) == F.col("first")).alias("stays"), "count")
    several = common.written(several.where("not stays or count > 1"), "several")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", *named(F.col(f"row.`{id_col}`").cast("bigint")), F.xxhash64(F.col(f"row.`{text_col}`").cast("string")).alias("tie"))
    once = rows.join(several.select(key), key, "left_anti").select("row")
    repeated = several.where("stays").select(key)
    if not repeated.isEmpty():
        once = once.unionByName(rows.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by("row", common.row_hash()).alias("row")).select("row"))
    return once.select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
