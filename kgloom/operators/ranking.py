"""Evaluation: set precision and recall, ranked recall and reciprocal rank, score statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions.text import normalized_relation, relation_label
from kgloom.model import KEY
from kgloom.operators.order import medians
from kgloom.operators.settle import settled

K_VALUES = (1, 5, 10, 20)
MODES = ("strict", "lax", "per_relation_strict")
LABELS = ("equivalence", "subclass", "superclass")


def k_values(top_k_max: int, ks: tuple = K_VALUES) -> tuple[int, ...]:
    """The ks up to the largest rank asked for, or that rank alone."""
    return tuple(k for k in ks if k <= top_k_max) or (top_k_max,)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall(system: DataFrame, gold: DataFrame, by: list[str] | None = None, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """precision, recall, f1, tp, fp, fn of sets of (source, target, relation), relations as written.

    One full outer join and one aggregate, per group of ``by`` columns if any (both sides have them). ``sizes``, if
    given, are (by, uri, n) of the sources and of the targets: entities that stand for n each, so that a pair of
    them counts for all pairs of what they stand for."""
    by = by or []
    cols = [*by, *KEY]
    s = system.select(*cols).distinct().withColumn("_s", F.lit(1))
    g = gold.select(*cols).distinct().withColumn("_g", F.lit(1))
    both = s.join(g, cols, "full")
    has_s, has_g = F.col("_s").isNotNull(), F.col("_g").isNotNull()
    if sizes is None:
        count = F.count_if
    else:
        for side, of in zip(("source", "target"), sizes):
            both = both.join(of.select(*by, F.col("uri").alias(side), F.col("n").alias(f"_{side}")), [*by, side])
        count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("_source") * F.col("_target"))), F.lit(0).cast("bigint"))
    counts = both.groupBy(*by).agg(count(has_s & has_g).alias("tp"), count(has_s & ~has_g).alias("fp"), count(~has_s & has_g).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.select(*by, "precision", "recall", _ratio(2 * p * r, p + r).alias("f1"), "tp", "fp", "fn")


def ranked(predictions: DataFrame) -> DataFrame:
    """Predictions with ``rank`` per source and ``relation_rank`` per source and relation, from 1."""
    order = [F.desc("confidence"), F.col("target"), F.col("relation")]
    return predictions.select(*KEY, "confidence").withColumns(
        {
            "rank": F.row_number().over(Window.partitionBy("source").orderBy(*order)),
            "relation_rank": F.row_number().over(Window.partitionBy("source", "relation").orderBy(*order)),
        }
    )


def normalized_gold(gold: DataFrame) -> DataFrame:
    """Gold rows with ``norm`` (=, < or >) and its label; rows of other relations are left out.

    Two spellings of one relation are two rows, and both count."""
    norm = normalized_relation(F.col("relation"))
    return gold.select(*KEY, norm.alias("norm")).where(F.col("norm").isNotNull()).withColumn("label", relation_label(F.col("norm")))


def gold_ranks(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Each gold row with the rank at which each mode finds it, null for a miss.

    strict: source, target and relation among all predictions of the source; lax: source and
    target; per_relation_strict: among predictions of that relation alone, for < and > only."""
    # one row a pair of entities, with its few relations, so that predictions are ranked once
    found = F.collect_list(F.struct("relation", "rank", "relation_rank")).alias("found")
    pair = ranked(predictions).groupBy("source", "target").agg(F.min("rank").alias("lax"), found)
    out = normalized_gold(gold).join(pair, ["source", "target"], "left")
    same = F.filter("found", lambda x: x["relation"] == F.col("norm"))
    out = out.withColumns({"strict": F.array_min(F.transform(same, lambda x: x["rank"])), "per_relation_strict": F.array_min(F.transform(same, lambda x: x["relation_rank"]))})
    directed = F.when(F.col("norm") != "=", F.col("per_relation_strict"))
    return out.select(*KEY, "norm", "label", "strict", "lax", directed.alias("per_relation_strict"))


def _by_mode(ranks: DataFrame) -> DataFrame:
    """(mode, label, rank): a row per gold row, mode and label it counts under. 'all' stands for
    every label in the strict and lax modes."""
    rows = ranks.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("rank")) for m in MODES])).alias("x"))
    rows = rows.select("x.mode", "x.rank", "label")
    directed = F.col("label").isin("subclass", "superclass")
    rows = rows.where((F.col("mode") != "per_relation_strict") | directed)
    both = F.when(F.col("mode") == "per_relation_strict", F.array("label")).otherwise(F.array("label", F.lit("all")))
    return rows.select("mode", "rank", F.explode(both).alias("label"))


def _frame(df: DataFrame) -> DataFrame:
    """Every (mode, label) there is, so that labels without gold rows show as zero."""
    cells = [(m, x) for m in MODES for x in (*LABELS, "all") if m != "per_relation_strict" or x in ("subclass", "superclass")]
    return df.sparkSession.createDataFrame(cells, "mode string, label string")


def metrics(predictions: DataFrame, gold: DataFrame, ks: tuple = K_VALUES) -> DataFrame:
    """(mode, label, n, recall (map of k to recall), mrr): one ranking, one join, one aggregate."""
    rows = _by_mode(gold_ranks(predictions, gold))
    hits = [F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks]
    mean = F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("rank")), F.lit(0.0))).alias("mrr")
    counts = rows.groupBy("mode", "label").agg(F.count("*").alias("n"), mean, *hits)
    full = _frame(predictions).join(counts, ["mode", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    recall = F.create_map(*[x for k in ks for x in (F.lit(k), _ratio(F.col(f"_{k}"), F.col("n")))])
    return full.select("mode", "label", "n", recall.alias("recall"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))


def recall_at_k(predictions: DataFrame, gold: DataFrame, ks: tuple = K_VALUES) -> DataFrame:
    """(mode, label, k, n, recall)"""
    return metrics(predictions, gold, ks).select("mode", "label", "n", F.explode("recall").alias("k", "recall")).select("mode", "label", "k", "n", "recall")


def mrr(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(mode, label, mrr): mean of 1 / rank, a miss counting 0."""
    return metrics(predictions, gold).select("mode", "label", "mrr")


def flat_metrics(of: DataFrame) -> DataFrame:
    """(metric, value) of ``metrics``, with names like recall_at_k_strict/all/k=5 and mrr_lax/subclass."""
    name = lambda head, *more: F.concat(F.lit(head), "mode", F.lit("/"), "label", *more)
    recall = F.transform(F.map_entries("recall"), lambda x: F.struct(name("recall_at_k_", F.lit("/k="), x["key"].cast("string")).alias("metric"), x["value"].alias("value")))
    reciprocal = F.array(F.struct(name("mrr_").alias("metric"), F.col("mrr").alias("value")))
    return of.select(F.explode(F.concat(recall, reciprocal)).alias("x")).select("x.metric", "x.value")


def dropped_relations(gold: DataFrame) -> DataFrame:
    """(relation, n) of gold rows whose relation is none of =, <, >; null and blank as ''."""
    bare = F.coalesce(F.regexp_replace("relation", r"(?U)^\s+|\s+$", ""), F.lit(""))
    return gold.where(normalized_relation(F.col("relation")).isNull()).groupBy(bare.alias("relation")).agg(F.count("*").alias("n"))


def reference_totals(gold: DataFrame) -> DataFrame:
    kept = normalized_relation(F.col("relation")).isNotNull()
    return gold.agg(F.count("*").alias("n_total"), F.count_if(kept).alias("n_after_filter"))


def labels_present(gold: DataFrame) -> DataFrame:
    """One row with the sorted labels that have gold rows."""
    return normalized_gold(gold).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def first_hits(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(source, first_hit_at_k_strict, first_hit_at_k_lax) of every source with predictions."""
    hits = gold_ranks(predictions, gold).groupBy("source").agg(F.min("strict").alias("first_hit_at_k_strict"), F.min("lax").alias("first_hit_at_k_lax"))
    return predictions.select("source").distinct().join(hits, "source", "left")


def per_source(predictions: DataFrame, gold: DataFrame, source_labels: DataFrame | None = None, target_labels: DataFrame | None = None) -> DataFrame:
    """A row per prediction: rank, gold relations, correctness, its source's first hits.

    Labels are (uri, label); an entity without one gets ''."""
    g = normalized_gold(gold).groupBy("source", "target").agg(F.array_sort(F.collect_set("norm")).alias("rels"))
    rows = ranked(predictions).join(g, ["source", "target"], "left")
    # a source's first hits lie among its own rows, which the ranking has brought together
    own = Window.partitionBy("source")
    rows = rows.withColumns({
        "first_hit_at_k_strict": F.min(F.when(F.array_contains("rels", F.col("relation")), F.col("rank"))).over(own),
        "first_hit_at_k_lax": F.min(F.when(F.col("rels").isNotNull(), F.col("rank"))).over(own),
    })
    for side, labels in (("source", source_labels), ("target", target_labels)):
        if labels is None:
            rows = rows.withColumn(f"{side}_label", F.lit(""))
        else:
            rows = rows.join(labels.select(F.col("uri").alias(side), F.col("label").alias(f"{side}_label")), side, "left").fillna("", [f"{side}_label"])
    rels = F.coalesce("rels", F.array().cast("array<string>"))
    return rows.select(
        F.col("source").alias("source_uri"), "source_label", "rank", F.col("target").alias("target_uri"), "target_label", F.col("confidence").alias("score"),
        F.col("relation").alias("predicted_relation"), F.array_join(rels, "/").alias("gold_relation"), F.array_contains(rels, F.col("relation")).alias("is_correct_strict"),
        (F.size(rels) > 0).alias("is_correct_lax"), "first_hit_at_k_strict", "first_hit_at_k_lax",
    )


def probe(predictions: DataFrame, gold: DataFrame, top: int = 5) -> DataFrame:
    """(source, outcome): 'HIT@r' for the first of the top predictions whose pair is gold, else MISS."""
    pairs = normalized_gold(gold).select("source", "target").distinct().withColumn("_g", F.lit(1))
    rows = ranked(predictions).where(F.col("rank") <= top).join(pairs, ["source", "target"], "left")
    best = rows.groupBy("source").agg(F.min(F.when(F.col("_g") == 1, F.col("rank"))).alias("r"))
    return best.select("source", F.when(F.col("r").isNull(), "MISS").otherwise(F.concat(F.lit("HIT@"), F.col("r").cast("string"))).alias("outcome"))


def score_stats(df: DataFrame, *by: str) -> DataFrame:
    """count, mean, median, population stddev, min and max of confidence; zeros where there is none. The
    median is exact, by counted probes: a group's values never meet in a task."""
    c = F.col("confidence")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    df = settled(df)
    stats = df.groupBy(*by).agg(F.count(c).alias("count"), zero(F.avg(c)).alias("mean"), zero(F.stddev_pop(c)).alias("stddev"), zero(F.min(c)).alias("min"), zero(F.max(c)).alias("max"))
    middle = medians(df, list(by), "confidence").select(*[F.col(b).alias(f"_{b}") for b in by], "median")
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True))
    return stats.join(middle, same, "left").select(*by, "count", "mean", zero(F.col("median")).alias("median"), "stddev", "min", "max")


def score_diagnostics(predictions: DataFrame, variant: str = "asymmetric") -> DataFrame:
    """Score statistics by run: 'all' for symmetric runs, else broader_run (<) and narrower_run (>)."""
    spark = predictions.sparkSession
    if variant == "symmetric":
        rows, names = predictions.withColumn("run", F.lit("all")), ["all"]
    else:
        run = F.when(F.col("relation") == "<", "broader_run").when(F.col("relation") == ">", "narrower_run")
        rows, names = predictions.withColumn("run", run).where(F.col("run").isNotNull()), ["broader_run", "narrower_run"]
    frame = spark.createDataFrame([(n,) for n in names], "run string")
    got = frame.join(score_stats(rows, "run"), "run", "left")
    return got.select("run", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "median", "stddev", "min", "max")])
