"""An alignment kept up to date from a stream of correspondences.

An extension: each micro-batch is merged into a versioned Parquet table by the same upsert as in
batch. A version is complete before the pointer to it moves, and a batch that is delivered again
after a failure changes nothing, as the upsert is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.model import ALIGNMENT, alignment
from kgloom.operators.alignments import upsert


class AlignmentTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions: those with Spark's success mark."""
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self) -> DataFrame:
        v = self.versions()
        return self.spark.read.schema(ALIGNMENT).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], ALIGNMENT)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Merges a micro-batch. The two latest versions are kept, for readers of the one before."""
        v = self.versions()
        upsert(self.read(), batch).write.mode("overwrite").parquet(f"{self.path}/v{(v[-1] if v else -1) + 1}")
        jvm, fs = self._fs()
        for old in self.versions()[:-2]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)


def maintain(stream: DataFrame, table: AlignmentTable, checkpoint: str, **trigger):
    """Starts the query that keeps ``table`` up to date with ``stream`` (the alignment's columns)."""
    return stream.writeStream.foreachBatch(lambda df, epoch: table.merge(alignment(df), epoch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
