import random
from collections import defaultdict

from kgloom.operators import ranking as R

NORM = {"=": "=", "≡": "=", "<": "<", "⊑": "<", ">": ">", "≥": ">"}
NAME = {"=": "equivalence", "<": "subclass", ">": "superclass"}


def brute(pred, gold, ks):
    by = defaultdict(list)
    for p in pred:
        by[p[0]].append(p)
    for v in by.values():
        v.sort(key=lambda p: (-p[3], p[1], p[2]))
    rows = defaultdict(list)
    for s, t, r in gold:
        n = NORM.get(r.strip())
        if not n:
            continue
        rank = lambda hit, of: next((i for i, p in enumerate([p for p in by[s] if of(p)], 1) if hit(p)), None)  # noqa: B023, E731
        strict = rank(lambda p: p[1] == t and p[2] == n, lambda p: True)
        lax = rank(lambda p: p[1] == t, lambda p: True)
        for mode, v in (("strict", strict), ("lax", lax)):
            rows[mode, NAME[n]].append(v)
            rows[mode, "all"].append(v)
        if n != "=":
            rows["per_relation_strict", NAME[n]].append(rank(lambda p: p[1] == t, lambda p: p[2] == n))
    recall = {(*k, x): sum(v is not None and v <= x for v in vs) / len(vs) for k, vs in rows.items() for x in ks}
    mrr = {k: sum(1 / v if v else 0 for v in vs) / len(vs) for k, vs in rows.items()}
    return recall, mrr


def test_recall_and_mrr_equal_brute_force(spark):
    rng = random.Random(6)
    pred = list({(f"s{rng.randint(0, 9)}", f"t{rng.randint(0, 9)}", rng.choice("<>="), rng.choice([0.1, 0.4, 0.4, 0.8])) for _ in range(150)})
    pred = list({p[:3]: p for p in pred}.values())
    gold = list({(f"s{rng.randint(0, 11)}", f"t{rng.randint(0, 9)}", rng.choice(["=", "≡", " < ", "⊑", ">", "≥", "~"])) for _ in range(80)})
    p = spark.createDataFrame(pred, "source string, target string, relation string, confidence double")
    g = spark.createDataFrame(gold, "source string, target string, relation string")
    recall, mrr = brute(pred, gold, (1, 5, 10))
    got = {(r.mode, r.label, r.k): r.recall for r in R.recall_at_k(p, g, (1, 5, 10)).collect()}
    assert len(got) == 30 and all(abs(got[k] - recall.get(k, 0.0)) < 1e-12 for k in got)
    got = {(r.mode, r.label): r.mrr for r in R.mrr(p, g).collect()}
    assert len(got) == 10 and all(abs(got[k] - mrr.get(k, 0.0)) < 1e-12 for k in got)
    rows = R.per_source(p, g).collect()
    assert len(rows) == len(pred) and all(r.is_correct_lax or not r.is_correct_strict for r in rows)


def test_precision_recall(spark):
    s = spark.createDataFrame([("a", "b", "="), ("a", "b", "="), ("c", "d", "=")], "source string, target string, relation string")
    g = spark.createDataFrame([("a", "b", "="), ("a", "b", "≡")], "source string, target string, relation string")
    r = R.precision_recall(s, g).collect()[0]
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    none = R.precision_recall(s.limit(0), g.limit(0)).collect()[0]
    assert (none.tp, none.precision, none.recall, none.f1) == (0, 0.0, 0.0, 0.0)


def test_small_reports(spark):
    g = spark.createDataFrame([("a", "b", "~"), ("a", "c", " ~ "), ("a", "d", None), ("a", "e", "<")], "source string, target string, relation string")
    assert {r.relation: r.n for r in R.dropped_relations(g).collect()} == {"~": 2, "": 1}
    assert R.reference_totals(g).collect()[0] == (4, 1) and R.labels_present(g).collect()[0].labels == ["subclass"]
    p = spark.createDataFrame([("a", "e", "<", 0.5), ("z", "e", "<", 0.7)], "source string, target string, relation string, confidence double")
    assert {r.run: (r["count"], r.stddev) for r in R.score_diagnostics(p).collect()} == {"broader_run": (2, 0.09999999999999998), "narrower_run": (0, 0.0)}
    assert {r.source: (r.first_hit_at_k_strict, r.first_hit_at_k_lax) for r in R.first_hits(p, g).collect()} == {"a": (1, 1), "z": (None, None)}
    assert {r.source: r.outcome for r in R.probe(p, g).collect()} == {"a": "HIT@1", "z": "MISS"}
    assert R.k_values(10) == (1, 5, 10) and R.k_values(0) == (0,)
