"""Crowds: many entities of one label, many equal vectors, large files. Results stay whole and nothing grows with
the square of a crowd that need not."""

import io
import random
from contextlib import redirect_stdout

from kgloom import model as M
from kgloom.functions import text as X
from kgloom.operators import matchers as MA
from kgloom.operators import ranking as R
from kgloom.operators import vectors as V
from kgloom.sources import alignment_xml as AX
from pyspark.sql import functions as F


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def labels(spark, rows):
    return spark.createDataFrame(rows, "uri string, label string")


def test_pairs_of_a_crowd_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(MA, "BLOCK", 4)
    a = labels(spark, [(f"a{i}", "Red bolt") for i in range(30)] + [("a0", "old ring"), ("a1", "of the"), ("x", "lone")])
    b = labels(spark, [(f"b{i}", "bolt red") for i in range(21)] + [("b0", "ring old"), ("b1", ""), ("y", "ring old")])
    got = MA.lexical(a, b)
    # nothing is dealt out or compared once pairs have been made
    text = plan(got)
    assert "Exchange" not in text[: text.rindex("Generate explode(a")] and "Aggregate" not in text[: text.rindex("Generate explode(a")]
    pairs = [(r.source, r.target) for r in got.collect()]
    want = {(f"a{i}", f"b{j}") for i in range(30) for j in range(21)} | {("a0", "y")}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_entities_alike_count_as_often_as_they_are(spark):
    a = labels(spark, [(f"a{i}", x) for i in range(6) for x in (["red bolt"] if i < 4 else ["red bolt", "ring"])])
    b = labels(spark, [(f"b{i}", x) for i in range(7) for x in (["bolt red"] if i < 3 else ["ring"])])
    gold = lambda s, t: s.toDF("source", "label").join(t.toDF("target", "label"), "label").selectExpr("source", "target", "'=' AS relation")
    (s, n), (t, m) = MA.alike(a), MA.alike(b)
    assert {(r.uri, r.n) for r in n.collect()} == {("a0", 4), ("a4", 2)} and s.count() == 3
    want = R.precision_recall(MA.lexical(a, b), gold(a, b)).first()
    assert R.precision_recall(MA.lexical(s, t), gold(s, t), sizes=(n, m)).first() == want
    assert (want.tp, want.fp, want.fn) == (8, 18, 0)


def test_durations_beyond_a_double(spark):
    # a double takes the first for a nanosecond less than it is
    whole = [s * 10**9 for s in (9_223_372_035, 9_100_000_001, 8_999_999_999, 7, 0)] + [9_100_000_001 * 10**9 - 1]
    want = [f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}" for s in (n // 10**9 for n in whole)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(whole)], "i int, ns bigint").orderBy("i")
    assert [r.d for r in df.select(X.duration(F.col("ns")).alias("d")).collect()] == want
    more = df.select((F.col("ns").cast("decimal(25,0)") * 1000).alias("ns"))
    assert [r.d for r in more.select(X.duration(F.col("ns")).alias("d")).collect()] == [f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}" for s in (n * 1000 // 10**9 for n in whole)]


def test_large_alignment_files_are_split(spark, tmp_path):
    rows = [(f"urn:a&{i % 50}", f"urn:b<{i % 7}", "=", i / 1000) for i in range(1000)]
    a = M.alignment(spark.createDataFrame(rows, "source string, target string, relation string, confidence double"))
    path = "file://" + str(tmp_path / "x.rdf")
    AX.write_alignment(a, path)
    odd = "file://" + str(tmp_path / "odd.rdf")
    with open(tmp_path / "x.rdf", encoding="utf-8") as f, open(tmp_path / "odd.rdf", "w", encoding="utf-8") as g:
        g.write(f.read().replace("xmlns=", "xmlns:al=").replace("Cell>", "al:Cell>").replace("<entity", "<al:entity").replace("relation>", "al:relation>").replace("<measure", "<al:measure").replace("</measure", "</al:measure"))
    found = lambda df: sorted(tuple(r) for r in df.select(*M.KEY, "confidence").collect())
    want = found(AX.read_alignment(spark, path))
    split = AX.read_alignment(spark, path, whole=1000)
    assert found(split) == want and len(want) == 350 and "xml" in plan(split).lower() and "binaryFile" not in plan(split)
    assert found(AX.read_alignment(spark, odd, whole=1000)) == want
    AX.write_alignments(a.repartition(3), "file://" + str(tmp_path / "more"))
    assert found(AX.read_alignment(spark, "file://" + str(tmp_path / "more"), whole=1000)) == want
    (tmp_path / "both").mkdir()
    for name in ("x.rdf", "odd.rdf"):
        (tmp_path / name).rename(tmp_path / "both" / name)
    assert found(AX.read_alignment(spark, "file://" + str(tmp_path / "both"), whole=1000)) == want


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    rng = random.Random(3)
    kinds = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(7)]
    rows = lambda c, n: [(f"{c}{i}", rng.choice(kinds)) for i in range(n)]
    a, b, k = rows("s", 60), rows("t", 45), 4
    score = lambda x, y: round(sum(p * q for p, q in zip(x, y)), 6) + 0.0
    top = lambda of, by: {(x, y, c) for x, v in of for c, y in [(-m, y) for m, y in sorted((-score(v, w), y) for y, w in by)[:k]]}
    there, back = top(a, b), {(x, y, c) for y, x, c in top(b, a)}
    seen, old = [], V._beside
    monkeypatch.setattr(V, "_beside", lambda s, t, *more: (seen.append((s.count(), t.count())), old(s, t, *more))[1])
    s, t = (spark.createDataFrame(x, "id string, v array<double>") for x in (a, b))
    for side in (V.SIDE, 0):
        assert {tuple(r) for r in V.top_k(s, t, k, 8, side).collect()} == there
        assert {tuple(r) for r in V.top_k_both(s, t, k, 8, side).collect()} == there | back
    assert seen and all(n <= len(kinds) and m <= len(kinds) for n, m in seen)


def moved(df):
    """Bytes that are shuffled while a frame is read whole."""
    sc = df.sparkSession.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()

    def written():
        array = sc._gateway.new_array(sc._jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, array, sc._jvm.java.util.ArrayList()).iterator()
        total = 0
        while stages.hasNext():
            total += stages.next().shuffleWriteBytes()
        return total

    before = written()
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def test_a_crowd_moves_in_proportion_to_its_entities(spark, monkeypatch):
    monkeypatch.setattr(MA, "BLOCK", 4)
    side = lambda c, n: labels(spark, [(f"{c}{i}", "red bolt") for i in range(n)])
    few, many = (moved(MA.lexical(side("a", n), side("b", n))) for n in (700, 1400))
    assert few < many < 3 * few


def test_pairs_of_several_keys_come_once_from_any_cell(spark, monkeypatch):
    monkeypatch.setattr(MA, "BLOCK", 4)
    monkeypatch.setattr(MA, "WIDE", 8)
    rng = random.Random(5)
    names = ["red bolt", "old ring", "hot nut", "of the", "lone"]
    a, b = ([(f"{c}{i}", x) for i in range(n) for x in rng.sample(names[:-1] if i else names, rng.choice([1, 1, 2, 3]))] for c, n in (("a", 90), ("b", 50)))
    of = lambda rows: {u: {x for v, x in rows if v == u and x != "of the"} for u, _ in rows}
    want = sorted((u, v) for u, x in of(a).items() for v, y in of(b).items() if x & y)
    assert sorted((r.source, r.target) for r in MA.lexical(labels(spark, a), labels(spark, b)).collect()) == want


def test_no_key_is_made_to_be_tested(spark):
    text = plan(MA.lexical(labels(spark, [("a", "Red bolt"), ("b", "of the")]), labels(spark, [("c", "bolt red"), ("d", "")])))
    assert "regexp_replace" in text and not [x for x in text.splitlines() if "Filter" in x and "regexp_replace" in x]


def test_candidates_make_the_keys_of_a_graph_once(spark, monkeypatch):
    seen, old = [], MA._keyed
    monkeypatch.setattr(MA, "_keyed", lambda *a: (seen.append(a), old(*a))[1])
    triples = lambda c: [("g", f"{c}{i}", "iri", p, o, k, None, None) for i, n in enumerate(["red bolt", "old ring", "nut"]) for p, o, k in ((M.TYPE, M.OWL + "Class", "iri"), (M.LABEL, n, "literal"))]
    s, t = (spark.createDataFrame(triples(c), M.TRIPLES) for c in "ab")
    got = {(r.source, r.target): r.confidence for r in MA.CandidateMatcher(k=1).match(s, t).collect()}
    assert len(seen) == 2 and [got[f"a{i}", f"b{i}"] for i in range(3)] == [1.0] * 3
