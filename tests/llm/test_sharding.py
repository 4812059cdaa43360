import random
import zlib
from collections import defaultdict

import numpy as np

from kgloom.llm import sharding
from tests.llm import corpus


def test_below_counts_probes():
    rng = random.Random(3)
    keys = [(rng.randint(-4, 4), rng.randint(-4, 4)) for _ in range(300)]
    probes = sorted({(rng.randint(-4, 4), rng.randint(-4, 4)) for _ in range(30)})
    got = sharding.below(*(np.array(x) for x in zip(*keys)), *(np.array(x) for x in zip(*probes)))
    assert got.tolist() == [sum(p <= k for p in probes) for k in keys]


def check(got, rows, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def test_shards_are_even_and_slots_gapless(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir)
    big = max(len((r[1] or "").encode()) for r in rows)
    size = check(sharding.digest(sharding.shard(corpus.frame(spark, sf_dir), 4, inner=3)).collect(), rows, 4)
    mean = sum(size.values()) / 4
    assert all(abs(size[s] - mean) <= big + 0.02 * mean for s in range(4))


def test_a_hot_text_is_cut_only_as_far_as_the_law_needs(spark):
    rows = [(i, "hot" * 40 if i % 3 else f"cold {i} " * 12, *[None] * 11) for i in range(900)]
    df = spark.createDataFrame(rows, corpus.SCHEMA).repartition(7)
    got = sharding.digest(sharding.shard(df, 8, inner=2)).collect()
    size = check(got, rows, 8)
    mean = sum(size.values()) / 8
    assert max(abs(x - mean) for x in size.values()) <= 0.02 * mean + 121
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) == 1  # the hot one alone


def test_reruns_agree_and_empty(spark, sf_dir):
    df = corpus.frame(spark, sf_dir)
    a, b = (sorted((str(r.doc_id), r.size, r.shard) for r in sharding.digest(sharding.shard(x, 4)).collect()) for x in (df, df.repartition(2)))
    assert a == b
    assert sharding.shard(corpus.empty(spark), 4).count() == 0
    assert sharding.shard(df, 4).select("row.*").columns == df.columns
