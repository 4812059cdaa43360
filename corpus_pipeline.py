"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents.

Defined results, for every stage: an empty table gives no rows; columns besides those of documents
travel along unchanged, whatever their names (packing returns its own columns alone); very long texts
are read whole. What a stage does with nulls, empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import common, exact_dedup, mixing, packing, simhash, toxicity
from kgloom.llm.registry import WORD_BPE, table, vocabulary


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; all others stay, rows with a null or empty text,
    which hold no word, and a null id among them. Repeated rows share their fate."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null text equals the empty one, a null id
    loses to any other, and of rows that share text and id one stays."""
    return exact_dedup.deduplicate(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: the least doc_id, nulls last, ties by text; of repeated
    rows one. Texts without words, null and empty ones too, have the zero fingerprint and so are one
    component."""
    return simhash.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a whole document is taken, and one for each part taken besides, with
    its own n_chars. Null and empty texts have no words and are never taken; a null source is a source;
    repeated rows are documents of their own."""
    return mixing.materialize(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens. A null or empty text is its end id alone; rows with
    equal or null ids are packed each for itself."""
    return packing.digest(packing.pack(docs, vocabulary(WORD_BPE)))


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", copies_out),
    ("SimHash near-dedup", near_copies_out),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: No stage but the second can be said in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = common.mark()
        out = stage(spark, docs, sf_dir)
        if stage is STAGES[-1][1]:
            return out
        made = common.mark()
        docs = common.written(out, name.replace(" ", "-"))
        common.release(since, made)  # what the stage itself wrote is read no more
    return docs
