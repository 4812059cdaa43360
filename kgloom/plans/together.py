"""All testcases of a track in one plan: a ``case`` column goes through matching and scoring, so a track is one
job in place of one a testcase, and a small testcase does not hold a cluster for itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.text import STOPWORDS
from kgloom.operators import graph as G
from kgloom.operators import matchers as MA
from kgloom.operators import ranking as R
from kgloom.sources.alignment_xml import read_alignment
from kgloom.sources.rdf import read_graph

BY = ("case",)


def load_cases(spark: SparkSession, cases: dict[str, tuple[str, str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source triples, target triples and gold rows of testcases (source, target, reference paths by name), each with
    its ``case``. Nothing is read before an action is."""
    named = lambda df, name: df.withColumn("case", F.lit(name))
    parts = [
        (named(read_graph(spark, s, "source"), name), named(read_graph(spark, t, "target"), name), named(read_alignment(spark, gold), name))
        for name, (s, t, gold) in sorted(cases.items())
    ]
    return tuple(reduce(DataFrame.unionByName, column) for column in zip(*parts))


def labels(graph: DataFrame) -> DataFrame:
    """(case, uri, label) of the classes of every case."""
    return G.labels(graph, G.classes(graph, BY), BY)


def matched(source_labels: DataFrame, target_labels: DataFrame, stopwords: tuple | list = STOPWORDS) -> DataFrame:
    """(case, source, target, relation, confidence): the lexical matches of every case, from labels."""
    return MA.lexical_by(source_labels, target_labels, BY, stopwords=stopwords).withColumns({"relation": F.lit("="), "confidence": F.lit(1.0)})


def lexical(source: DataFrame, target: DataFrame, stopwords: tuple | list = STOPWORDS) -> DataFrame:
    """(case, source, target, relation, confidence): the lexical matches of every case."""
    return matched(labels(source), labels(target), stopwords)


def scores(system: DataFrame, gold: DataFrame, cases: DataFrame, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(case, size, precision, recall, f1, tp, fp, fn): a row a case of ``cases`` (case), also where nothing was found
    and nothing was to be found. The number of matches is that of the distinct ones; ``sizes`` as in
    ``precision_recall``."""
    got = R.precision_recall(system, gold, ["case"], sizes).withColumn("size", F.col("tp") + F.col("fp"))
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("size", "tp", "fp", "fn")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("precision", "recall", "f1")}
    return cases.select("case").distinct().join(got, "case", "left").withColumns(zero).select("case", "precision", "recall", "f1", "tp", "fp", "fn", "size")


def run_lexical(spark: SparkSession, cases: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Lexical matching of all cases, scored: a row a case."""
    source, target, gold = load_cases(spark, cases)
    return scores(lexical(source, target), gold, spark.createDataFrame([(c,) for c in cases], "case string"))
