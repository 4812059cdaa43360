import random
import re

import numpy as np
import xxhash

from kgloom.llm import simhash
from tests.llm import corpus


def slow(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(fps):
    """Component label (least index) of each fingerprint by brute force."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_groups_equal_brute_force(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir, 120)
    got = simhash.groups(corpus.frame(spark, sf_dir, 120)).collect()
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [slow(r[1]) for r in rows]
    want = sorted((str(r[0]), f, str(rows[c][0])) for r, f, c in zip(rows, fps, classes(fps)))
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want
    text = simhash.digest(simhash.groups(corpus.frame(spark, sf_dir, 20))).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in text)
    assert simhash.groups(corpus.empty(spark)).count() == 0


def test_links_lose_nothing_over_many_tiles(spark, monkeypatch):
    rng = random.Random(8)
    fps = {0, 2**64 - 1, 1 << 63}
    for _ in range(12):  # crowds of near copies round a centre, and a chain
        c = rng.getrandbits(64)
        for _ in range(60):
            fps.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    x = rng.getrandbits(64)
    for i in range(20):
        x ^= 0b111 << i
        fps.add(x)
    fps = sorted(fps)
    want = classes(fps)
    for tile, fine, most in ((7, 10**9, 5), (2048, 0, 1 << 20)):
        monkeypatch.setattr(simhash, "FINE", fine)
        monkeypatch.setattr(simhash, "LINKS", most)
        df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
        found = {r.node % 2**64: r.component for r in simhash.components(simhash.links(df, len(fps), tile=tile)).collect()}
        got = {}
        for f, c in zip(fps, want):
            got.setdefault(c, set()).add(found.get(f, ("alone", f)))
        assert all(len(v) == 1 for v in got.values())
        assert len({next(iter(v)) for v in got.values()}) == len(got)


def test_keep_one(spark, sf_dir):
    df = corpus.frame(spark, sf_dir)
    left = simhash.keep_one(df)
    assert left.columns == df.columns
    found = simhash.groups(df).collect()
    want = sorted(str(r.doc_id) for r in found if r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(str(r.doc_id) for r in left.collect()) == want


def test_majority():
    hs = np.random.default_rng(1).integers(0, 2**63, 700, dtype=np.uint64)
    assert simhash.majority(hs) == sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in hs) * 2 > len(hs))
