"""Packing: concatenate and cut.

Pass 1 tokenizes every document once, in the partition that reads it, and writes the ids with
their position inside the partition. The partition totals give, by a prefix sum, the global
offset of every partition. Pass 2 cuts the one long sequence of ids into fixed windows; a
document that crosses a window edge gets a boundary record on either side. No row is shuffled.

Defined results: a null text is empty and contributes its end id alone; repeated rows are packed
as often as they occur, ties in any order; a null doc_id stays null; a very long text is encoded
whole and cut into as many pieces as windows it touches; an empty table gives no rows; columns other
than the id and the text are not read, whatever their names. Only the last sequence can be short. It
is padded to the window unless its length is a power of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common
from kgloom.llm.tokens import binary, encoder

WINDOW = 4096
END_ID = 2
#: Distinct words a worker remembers, and bytes of text encoded at once: less than the encoder's own,
#: as packing is the pipeline's last stage, where workers of the stages before still hold memory.
MEMORY, SLICE = 400_000, 3 << 20


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, local_start, doc_id, n_tokens, ids): ids are little-endian 32-bit, the end id last."""
    names = ["part", "local_start", "doc_id", "n_tokens", "ids"]

    def run(batches):
        from pyspark import TaskContext

        enc, part, at = encoder(path, MEMORY), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, ids, n in enc.batches(batch.column(1), end_id, SLICE):
                doc = batch.column(0).slice(i, len(n))
                start = at + np.cumsum(n) - n
                cols = [pa.array(np.full(len(n), part, np.int32)), pa.array(start, pa.int64()), doc, pa.array(n, pa.int64()), binary(ids, n)]
                yield pa.RecordBatch.from_arrays(cols, names)
                at += len(ids)

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return read.mapInArrow(run, "part int, local_start bigint, doc_id bigint, n_tokens bigint, ids binary")


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, piece (ids as bytes), doc_tokens, sequence_id, offset."""
    ids = common.with_base(common.written(tokenized(docs, path, id_col, text_col, end_id), "packing"), "part", "n_tokens", "base")
    at = F.col("base") + F.col("local_start")
    cut = ids.select(
        "doc_id", "n_tokens", "ids", at.alias("at"),
        F.explode(F.sequence(F.floor(at / window), F.floor((at + F.col("n_tokens") - 1) / window))).alias("sequence_id"),
    )
    first = F.col("sequence_id") * window
    cut = cut.withColumn("start", F.greatest(first - F.col("at"), F.lit(0).cast("bigint")))
    cut = cut.withColumn("length", F.least(first + window - F.col("at"), F.col("n_tokens")) - F.col("start"))
    return cut.select(
        "doc_id", "start", "length",
        F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("piece"),
        F.col("n_tokens").alias("doc_tokens"), "sequence_id", (F.col("at") + F.col("start") - first).alias("offset"),
    )


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Packed sequences: (sequence_id, n_tokens, padded_tokens, ids). A group holds one window at most."""
    got = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"),
    )
    n = F.col("n_tokens")
    power = F.bit_count(n) == 1
    body = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["piece"]))
    return got.select("sequence_id", "n_tokens", F.when(power, n).otherwise(F.lit(window).cast("bigint")).alias("padded_tokens"), body.alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
