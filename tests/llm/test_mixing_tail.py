"""Sources whose target is below a block, or no multiple of one, have all their words."""

import pytest

from kgloom.llm import mixing


def taken(cells):
    sizes, out = mixing.plan(cells)
    got = {s: 0 for s, _, _ in sizes}
    words = {c[:2]: c[2] for c in cells}
    for s, shard, base, pieces in out:
        assert sum(b - a for a, b, _ in pieces) == words[s, shard] and all(0 <= n <= mixing.MOST for _, _, n in pieces)
        assert all(x[1] == y[0] for x, y in zip(pieces, pieces[1:])) and (not pieces or (pieces[0][0], pieces[-1][1]) == (base, base + words[s, shard]))
        got[s] += sum((b - a) * n for a, b, n in pieces)
    return sizes, got


@pytest.mark.parametrize(
    "cells",
    [
        [(s, 0, 10) for s in range(1000)],
        [(s, s % 3, 200) for s in range(1000)],
        [(0, i, 20_000) for i in range(10)] + [(s, 0, 30) for s in range(1, 1001)],
        [(s, i, (s * 7 + i * 13) % 150) for s in range(60) for i in range(9)],
        [(0, 0, 1), (1, 0, 0), (2, 5, 64), (3, 1, 65), (3, 2, 0)],
        [],
    ],
)
def test_every_source_meets_its_target(cells):
    sizes, got = taken(cells)
    assert all(abs(got[s] - aim) <= 1 for s, _, aim in sizes)
    assert abs(sum(got.values()) - sum(aim for _, _, aim in sizes)) <= 0.5 + 1e-6


def test_small_sources_stay(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(10)), f"s{i:03d}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs).persist()
    got = {r.source: r for r in mixed.collect()}
    assert len(got) == 200 and all(r.taken > 0 and abs(r.taken - r.target) <= 1 for r in got.values())
    assert sum(r.taken for r in got.values()) == 3000
    assert all(r.taken == r.passes * r["size"] + sum(s["to"] - s["from"] for s in r.spans) for r in got.values())
    docs = docs.withColumn("n_chars", mixing.F.length("text"))
    assert mixing.materialize(docs, mixed).select("source").distinct().count() == 200
