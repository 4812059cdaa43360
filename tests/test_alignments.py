import random
from collections import Counter

import pytest

from kgloom.operators import alignments as A


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, relation string, confidence double")


def walk(rows, n):
    """Rank cap by the letter: one counter for both roles, every row counts."""
    seen, out = Counter(), []
    for r in sorted(rows, key=lambda r: (-r[3], r[0], r[1], r[2])):
        seen[r[0]] += 1
        seen[r[1]] += 1
        if seen[r[0]] <= n and seen[r[1]] <= n:
            out.append(r)
    return out


def test_rank_cap_equals_the_walk(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 3):
        rows = {}
        for _ in range(60):
            k = (f"u{rng.randint(0, 8)}", f"u{rng.randint(0, 8)}", rng.choice("=<>"))
            rows[k] = rng.choice([0.1, 0.5, 0.5, 0.9])
        rows = [(*k, v) for k, v in rows.items()]
        got = A.rank_cap(frame(spark, rows), n).select("source", "target", "relation", "confidence").collect()
        assert sorted(map(tuple, got)) == sorted(walk(rows, n))


def test_upsert_keeps_highest_confidence_and_first_extensions(spark):
    rows = [("a", "b", "=", 0.2, {"x": "1"}, 0), ("a", "b", "=", 0.9, {"x": "2"}, 1), ("a", "b", "<", 0.1, None, 2)]
    df = spark.createDataFrame(rows, "source string, target string, relation string, confidence double, extensions map<string,string>, seq bigint")
    got = {(r.source, r.target, r.relation): (r.confidence, r.extensions) for r in A.upsert(df).collect()}
    assert got == {("a", "b", "="): (0.9, {"x": "1"}), ("a", "b", "<"): (0.1, None)}
    later = spark.createDataFrame([("a", "b", "=", 0.95)], "source string, target string, relation string, confidence double")
    assert {r.confidence for r in A.upsert(df, later).collect() if r.relation == "="} == {0.95}


def test_nan_is_refused(spark):
    with pytest.raises(Exception, match="NaN"):
        A.upsert(frame(spark, [("a", "b", "=", float("nan"))])).collect()


def test_set_operations(spark):
    a = frame(spark, [("a", "b", "=", 1.0), ("a", "a", "=", 1.0), ("c", "d", "<", 0.5)])
    b = frame(spark, [("a", "b", "=", 0.3), ("c", "d", ">", 0.5)])
    key = lambda df: sorted((r.source, r.target, r.relation) for r in df.collect())
    assert key(A.difference(a, b)) == [("a", "a", "="), ("c", "d", "<")]
    assert key(A.contains(a, b)) == [("a", "b", "=")]
    assert key(A.remove_trivial(a)) == [("a", "b", "="), ("c", "d", "<")]
    assert A.size(a).collect()[0].size == 3
    assert key(A.of_source(a, "a")) == [("a", "a", "="), ("a", "b", "=")]
    assert [r.source for r in A.by_confidence(a).collect()] == ["a", "a", "c"]
