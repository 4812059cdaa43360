"""One file from many tasks, with a commit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_single(lines: DataFrame, path: str, head: str = "", tail: str = "") -> str:
    """One file of the lines (one string column) in the frame's order, between head and tail.

    The executors write the parts. They are joined beside the target by the file system's own streams, a buffer
    at a time: no row comes to the driver. Then the file takes its name, so a reader sees the old file or the
    whole new one, and a run that dies leaves the old one."""
    jvm, conf = lines.sparkSession.sparkContext._jvm, lines.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    parts = f"{path}.{uuid.uuid4().hex}"
    lines.write.text(parts)
    fs = at(path).getFileSystem(conf)
    made = at(f"{parts}/joined")
    fs.setWriteChecksum(False)  # no further files beside the target
    try:
        out = fs.create(made, True)
        try:
            out.write(bytearray(head.encode()))
            names = sorted(x.getPath().getName() for x in fs.listStatus(at(parts)))
            for name in names:
                if name.startswith("part-"):
                    part = fs.open(at(f"{parts}/{name}"))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                    finally:
                        part.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
        fs.delete(at(path), False)
        if not fs.rename(made, at(path)):
            raise OSError(f"{path} could not be put in its place")
    finally:
        fs.setWriteChecksum(True)
        fs.delete(at(parts), True)
    return path
