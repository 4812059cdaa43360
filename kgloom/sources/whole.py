"""Files that one task reads whole."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kgloom.model import TRIPLES

#: Bytes of a file up to which one task reads it whole.
WHOLE = 16 << 20
#: Triples that leave a task at once.
ROWS = 1 << 13


def triple_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of TRIPLES as batches, while they are made."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*some)], TRIPLES.fieldNames())


def read_whole(spark: SparkSession, path: str | list[str], parse: Callable[[bytes, str], Iterable[tuple]], graph: str | None) -> DataFrame:
    """Triples of files by ``parse(content, path)``; no more than a batch of them is held."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                yield from triple_batches((graph or p, *t) for t in parse(c.as_py(), p))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, TRIPLES)
