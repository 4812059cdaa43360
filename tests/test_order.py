import random

from pyspark.sql import functions as F

from kgloom.operators import alignments as A
from kgloom.operators import matchers, order, ranking


def test_selected_against_sorting(spark, monkeypatch):
    rnd, rows = random.Random(3), []
    for g, n in (("hot", 3000), ("ties", 500), (None, 40), ("one", 1), ("pair", 2)):
        for i in range(n):
            rows.append((g, {"ties": rnd.choice([0.5, 0.5, 0.25, -0.0])}.get(g, rnd.gauss(0, 1e6) if i % 3 else rnd.random())))
    rows += [("none", None), ("hot", None)]
    of = {}
    for g, v in rows:
        of.setdefault(g, []).extend([] if v is None else [v])
    of = {g: sorted(v) for g, v in of.items() if v}
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for probes, small in ((order.PROBES, order.SMALL), (order.PROBES, 100), (2, 0)):  # with few probes it takes many rounds
        monkeypatch.setattr(order, "PROBES", probes)
        monkeypatch.setattr(order, "SMALL", small)
        got = order.selected(df, ["g"], "v", F.array(F.lit(0).cast("bigint"), F.expr("n div 3"), F.col("n") - 1, F.lit(700).cast("bigint")))
        want = {(g, len(v), r, v[r]) for g, v in of.items() for r in {0, len(v) // 3, len(v) - 1, 700} if r < len(v)}
        assert {tuple(r) for r in got.collect()} == want
    mid = {r.g: r.median for r in order.medians(df, ["g"], "v").collect()}
    assert mid == {g: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for g, v in of.items()}
    assert order.medians(df.where("v is null"), ["g"], "v").count() == 0


def test_statistics_hold_no_group_in_a_task(spark):
    df = spark.range(5000).selectExpr("if(id % 5 > 0, 'a', 'b') AS run", "cast(id % 997 AS double) AS confidence")
    got = ranking.score_stats(df, "run").orderBy("run")
    want = df.groupBy("run").agg(F.median("confidence").alias("m")).orderBy("run").collect()
    assert [r.median for r in got.collect()] == [r.m for r in want]
    assert "median(" not in got._jdf.queryExecution().optimizedPlan().toString()
    one = ranking.score_stats(df.where("run = 'none'"))
    assert [tuple(r) for r in one.collect()] == [(0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_places(spark):
    rows = [(f"s{i % 40}", f"t{i}", "=", (i % 7) / 7) for i in range(900)]
    got = A.with_place(spark.createDataFrame(rows, "source string, target string, relation string, confidence double").repartition(6))
    want = sorted(rows, key=lambda r: (-r[3], *r[:3]))
    assert [tuple(r)[:4] for r in got.orderBy("place").collect()] == want
    assert [r.place for r in got.orderBy("place").collect()] == list(range(1, 901))
    assert A.with_place(got.drop("place").limit(0)).count() == 0


def test_labels_without_words_match_nothing(spark):
    left = [("a1", "the of"), ("a2", "日本"), ("a3", "Москва"), ("a4", ""), ("a5", "Red Bikes"), ("a6", "日本 7"), ("a7", None)]
    right = [("b1", "and"), ("b2", "中国"), ("b3", "Ελλάδα"), ("b4", " "), ("b5", "the red_bikes"), ("b6", "7")]
    frame = lambda rows: spark.createDataFrame(rows, "uri string, label string")
    got = {(r.source, r.target) for r in matchers.lexical(frame(left), frame(right)).collect()}
    assert got == {("a5", "b5"), ("a6", "b6")}
