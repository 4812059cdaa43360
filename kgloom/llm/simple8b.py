"""Token-id output as Simple-8b files.

Layout of the codec. Ids are cut into lanes of 128. Every lane is coded on its own into 64-bit
words; the offsets of the lanes, in words, stand beside them, so that a decoder can start at any
lane and decode all lanes at once. The top four bits of a word are its selector:

    selector  0     a run of up to 120 zero ids, no payload
    selectors 1-14  60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1 ids of 1 ... 60 bits each
    selector  15    escape: the next word is one id of up to 64 bits, raw

A word that reaches past its lane's end is cut there by the decoder. The encoder takes the
selector that covers the most ids, for all lanes at once.

Layout of the files. A file is one partition of the range of ids, a row of it one block of whole
documents: the documents' ids and lengths, the position of the block in its file, lane offsets
(little-endian 32 bits) and words (little-endian 64 bits). Files are ordered by their number and
hold ascending doc_id; Spark writes them, so they can lie in any store it knows.

Defined results: a null text is empty and yields its end id alone; null ids come first; repeated
rows are written as often as they occur, ties of doc_id in the order of their texts' hash; a very
long text is one document of one block; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common
from kgloom.llm.tokens import encoder

LANE = 128
#: Fixed values of the code: ids a word and bits an id, by selector 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ZEROS, ESCAPE = 120, 15
#: Ids after which a block is closed.
BLOCK = 1 << 18
END_ID = 2

#: Ids a word of each selector covers.
_TAKES = np.array([ZEROS, *COUNTS, 1])


#: Selectors too narrow for an id, for ids of up to 17 bits.
_NARROW = np.searchsorted(np.array([1 << b for b in BITS]), np.arange(1 << 17), "right").astype(np.uint8)


def _shift(a: np.ndarray, n: int) -> np.ndarray:
    """Each row moved n places to the left, zeros behind."""
    out = np.zeros_like(a)
    out[:, :-n] = a[:, n:]
    return out


def _selectors(grid: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The selector that covers most ids, for a word begun at any place of any lane."""
    top = int(grid.max())  # need: selectors too narrow for the id
    if top < len(_NARROW):
        need = _NARROW[grid.astype(np.int32)]
    else:
        need = np.zeros(grid.shape, np.uint8)
        for bits in BITS:
            if top >> bits:
                need += grid >= np.uint64(1 << bits)
    most = {1: need}
    for n in range(2, 9):
        most[n] = np.maximum(most[n - 1], _shift(need, n - 1))
    best = np.where(need == len(BITS), ESCAPE, len(COUNTS)).astype(np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):  # from few ids a word to many
        n = COUNTS[s]
        if n > 8:
            if not (most[8] <= s).any():
                break
            half = {10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (15, 5), 30: (15, 15), 60: (30, 30)}[n]
            most[n] = np.maximum(most[half[0]], _shift(most[half[1]], half[0]))
        best[most[n] <= s] = s + 1
    if (best == 1).any():
        # places to the next id that isn't zero, or to the lane's end
        place = np.arange(grid.shape[1])
        end = np.where((grid > 0) | (place >= length[:, None]), place, grid.shape[1])
        run = np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1] - place
        lasts = run + place >= length[:, None]
        best[(run >= ZEROS) | lasts & (run > COUNTS[0])] = 0
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, lane offsets): offsets has one entry more than there are lanes."""
    ids = np.asarray(ids, np.uint64)
    lanes = -(-len(ids) // LANE)
    if not lanes:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    grid = np.zeros((lanes, LANE + COUNTS[0]), np.uint64)
    flat = np.zeros(lanes * LANE, np.uint64)
    flat[: len(ids)] = ids
    grid[:, :LANE] = flat.reshape(lanes, LANE)
    length = np.full(lanes, LANE)
    length[-1] = len(ids) - (lanes - 1) * LANE
    best = _selectors(grid, length)
    # all lanes step from word to word together
    at, live, steps = np.zeros(lanes, np.int64), np.arange(lanes), []
    while len(live):
        sel = best[live, at[live]]
        steps.append((live, at[live], sel))
        at[live] += _TAKES[sel]
        live = live[at[live] < length[live]]
    lane, place, sel = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(lane, kind="stable")
    lane, place, sel = lane[order], place[order], sel[order]
    first = np.concatenate([[0], np.cumsum(1 + (sel == ESCAPE))])  # an escape takes two words
    words = np.zeros(first[-1], np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        head = np.uint64(int(s) << 60)
        if s == ESCAPE:
            words[first[rows]] = head
            words[first[rows] + 1] = grid[lane[rows], place[rows]]
        elif s:
            slot = np.arange(COUNTS[s - 1])
            values = grid[lane[rows, None], place[rows, None] + slot] << (slot.astype(np.uint64) * np.uint64(BITS[s - 1]))
            words[first[rows]] = np.bitwise_or.reduce(values, axis=1) | head
    offsets = np.zeros(lanes + 1, np.uint32)
    offsets[1:] = first[np.cumsum(np.bincount(lane, minlength=lanes))]
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids, every word of one selector at a time."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    words = np.asarray(words, np.uint64)
    offsets = np.asarray(offsets, np.int64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):  # in order: a raw word may look like an escape
        if not raw[i]:
            raw[i + 1] = True
    counts = _TAKES[sel]
    counts[raw] = 0
    before = np.concatenate([[0], np.cumsum(counts)])
    lane = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = lane * LANE + before[:-1] - before[offsets[:-1]][lane]
    end = np.minimum((lane + 1) * LANE, n)
    for s in range(1, 15):
        rows = np.flatnonzero((sel == s) & ~raw)
        if not len(rows):
            continue
        slot = np.arange(COUNTS[s - 1])
        values = (words[rows, None] >> (slot.astype(np.uint64) * np.uint64(BITS[s - 1]))) & np.uint64((1 << BITS[s - 1]) - 1)
        where = start[rows, None] + slot
        keep = where < end[rows, None]
        out[where[keep]] = values[keep]
    rows = np.flatnonzero((sel == ESCAPE) & ~raw)
    out[start[rows]] = words[rows + 1]
    return out


FILE_SCHEMA = (
    "file_no int, block_no int, local_start bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, lane_offsets binary, words binary"
)


def write_files(docs: DataFrame, path: str, files: int | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the token ids of every document in ascending order of id; returns the files as read back."""
    names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        block_no, start, held, n = 0, 0, [], 0  # held: (doc_ids, lengths, ids) of the block in hand

        def block():
            words, offsets = encode(np.concatenate([x[2] for x in held]))
            lists = [pa.concat_arrays([x[0] for x in held]), pa.array(np.concatenate([x[1] for x in held]), pa.int64())]
            cols = [pa.array([part], pa.int32()), pa.array([block_no], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64())]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            cols += [pa.array([x.tobytes()], pa.binary()) for x in (offsets.astype("<u4"), words.astype("<u8"))]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for i, ids, counts in enc.batches(batch.column(1), end_id):
                docs, ends, a = batch.column(0).slice(i, len(counts)), np.cumsum(counts), 0
                while a < len(counts):
                    before = int(ends[a] - counts[a])
                    b = min(int(np.searchsorted(ends, before + BLOCK - n)) + 1, len(counts))  # the document that fills the block is its last
                    held.append((docs.slice(a, b - a), counts[a:b], ids[before : ends[b - 1]]))
                    n, a = n + int(ends[b - 1]) - before, b
                    if n >= BLOCK:
                        yield block()
                        block_no, start, held, n = block_no + 1, start + n, [], 0
        if held:
            yield block()

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = read.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return common.written(ordered.mapInArrow(run, FILE_SCHEMA), "simple8b", "uncompressed")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids): one row per document, ids as little-endian 32-bit bytes, start over all files."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["lane_offsets"], "<u4"), r["n_ids"]).astype("<u4")
                ends = np.cumsum(r["doc_lengths"])
                starts = ends - r["doc_lengths"]
                parts = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["at"], pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "start", "ids"])

    located = common.with_base(files, "file_no", "n_ids", "base")
    read = located.select("file_no", (F.col("base") + F.col("local_start")).alias("at"), "n_ids", "doc_ids", "doc_lengths", "lane_offsets", "words")
    return read.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def digest(docs: DataFrame) -> DataFrame:
    n = F.floor(F.octet_length("ids") / 4)
    return docs.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
