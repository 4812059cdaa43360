"""TSV, CSV and JSON artefacts."""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import normalized_relation
from kgloom.sinks.single import write_single

RESULT_COLUMNS = ["Track", "TestCase", "Matcher", "Precision", "Recall", "F1", "TP", "FP", "FN", "Time (ns)", "Time HH:MM:SS"]
PREDICTION_COLUMNS = ["source_uri", "source_label", "target_uri", "target_label", "predicted_relation", "score"]
REFERENCE_COLUMNS = ["source_uri", "target_uri", "relation_raw", "relation_normalized"]


def cell(c: Column, kind: str) -> Column:
    """A TSV cell: null as '', booleans as True or False, floats with six places, tabs and line feeds as spaces."""
    if kind == "boolean":
        out = F.when(c, "True").otherwise("False")
    elif kind in ("double", "float"):
        out = F.format_string("%.6f", c)
    else:
        out = F.translate(c.cast("string"), "\t\n", "  ")
    return F.when(c.isNull(), "").otherwise(out)


def write_tsv(df: DataFrame, path: str) -> str:
    """One TSV file with a head. Lines are made and written by the executors, in the frame's order."""
    line = F.concat_ws("\t", *[cell(F.col(f"`{c}`"), k) for c, k in df.dtypes])
    return write_single(df.select(line.alias("value")), path, "\t".join(df.columns) + "\n")


def write_tsv_files(df: DataFrame, path: str) -> None:
    """The same as a folder of part files, for tables too long for one."""
    df.select([cell(F.col(f"`{c}`"), k).alias(c) for c, k in df.dtypes]).write.csv(
        path, sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def predictions_table(predictions: DataFrame, source_labels: DataFrame | None = None, target_labels: DataFrame | None = None) -> DataFrame:
    """Ordered by source, falling score, target, relation."""
    rows = predictions
    for side, labels in (("source", source_labels), ("target", target_labels)):
        if labels is None:
            rows = rows.withColumn(f"{side}_label", F.lit(""))
        else:
            rows = rows.join(labels.select(F.col("uri").alias(side), F.col("label").alias(f"{side}_label")), side, "left").fillna("", [f"{side}_label"])
    out = rows.orderBy("source", F.desc("confidence"), "target", "relation")
    return out.select(F.col("source").alias("source_uri"), "source_label", F.col("target").alias("target_uri"), "target_label", F.col("relation").alias("predicted_relation"), F.col("confidence").alias("score"))


def reference_table(gold: DataFrame) -> DataFrame:
    out = gold.orderBy("source", "target", "relation")
    return out.select(F.col("source").alias("source_uri"), F.col("target").alias("target_uri"), F.col("relation").alias("relation_raw"), normalized_relation(F.col("relation")).alias("relation_normalized"))


def hhmmss(ns: int) -> str:
    s = ns // 1_000_000_000
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def append_result(path: str, track: str, case: str, matcher: str, scores: dict, ns: int) -> None:
    """A row of the results CSV, with a head if the file is new or empty."""
    new = not os.path.exists(path) or os.path.getsize(path) == 0
    with open(path, "a", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        if new:
            w.writerow(RESULT_COLUMNS)
        w.writerow([track, case, matcher, *[scores[k] for k in ("precision", "recall", "f1", "tp", "fp", "fn")], ns, hhmmss(ns)])


def write_json(path: str, value: object) -> str:
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return path


def write_performance(path: str, ns: int) -> str:
    Path(path).write_text(f"Time\n{ns}\n", encoding="utf-8")
    return path
