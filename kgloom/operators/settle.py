"""Results that several readers share: written once, read from there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders that are still in place, and what deletes them: the JVM and the Hadoop configuration, which
#: outlive the session.
_made: list[str] = []
_hadoop: list = []


def shared_folder(spark: SparkSession, make: bool = False) -> str | None:
    """The folder that spark.checkpoint.dir names. Where it is unset, a cluster is refused, as its
    machines share nothing else; a session of this machine alone has None, or a new folder if asked."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base and make:
        base = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") if base else None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    _hadoop[:] = [spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()]
    _made.append(f"{shared_folder(spark, make=True)}/kgloom-{uuid.uuid4().hex}.{name}")
    return _made[-1]


def release() -> None:
    """Deletes all scratch folders. Only when no frame reads them any more."""
    while _made:
        jvm, conf = _hadoop
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM is gone before
        pass


atexit.register(_release_at_exit)


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a written table in the shared folder; where there is none, the cache of a
    session of this machine alone. Never a local checkpoint."""
    if not shared_folder(df.sparkSession):
        return df.persist()
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
