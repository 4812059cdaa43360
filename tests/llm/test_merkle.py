import hashlib
import string
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from kgloom.llm import common, merkle
from tests.llm import corpus


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof(tree, i):
    """Siblings, and the run with its slot, level by level."""
    sib, runs = [], []
    for level in tree[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        sib += run[: i % 16] + run[i % 16 + 1 :]
        runs.append((run, i % 16))
        i //= 16
    return sib, runs


def expected(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for j, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            (a, ra), (b, rb) = proof(trees[s], i), proof(top, j)
            h = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf(r, r[1] and r[1].translate(lower))
            for run, k in ra + rb:
                h = H(*run[:k], h, *run[k + 1 :])
            out.append((r[0], own, trees[s][-1][0], root, H(*a, *b), h, h == root))
    return out


def key(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_against_brute_force(spark, sf_dir):
    got = merkle.digest(corpus.frame(spark, sf_dir))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert key(got.collect()) == key(expected(corpus.rows(spark, sf_dir)))
    assert merkle.digest(corpus.empty(spark)).count() == 0


def test_shapes_of_trees(spark):
    """Lone leaves, runs of one node, several levels, more than sixteen sources."""
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 257, None: 33, "é": 300, "": 1} | {f"s{i:02}": 1 for i in range(12)}
    rows, k = [], 0
    for s, n in sizes.items():
        for i in range(n):
            rows.append((k * 7919 % 1000 - 100, f"Text {i}" if i % 3 else None, None, s, i, *[None] * 8))
            k += 1
    got = merkle.digest(spark.createDataFrame(rows, corpus.SCHEMA).repartition(7)).collect()
    assert key(got) == key(expected(rows))
    one = merkle.digest(spark.createDataFrame(rows[:1], corpus.SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H()


def test_a_hot_source_and_running_sums(spark, monkeypatch):
    """Two thirds of the rows in one source, and a source table that is joined instead of broadcast."""
    monkeypatch.setattr(merkle, "SOURCES", 0)
    rows = [(i, f"T{i}", "en", "hot" if i % 3 else f"s{i % 50}", 2, *[None] * 8) for i in range(3000)]
    got = merkle.digest(spark.createDataFrame(rows, corpus.SCHEMA).repartition(9))
    assert key(got.collect()) == key(expected(rows))
    monkeypatch.setattr(common, "SPAN", 7)
    sums = common.running(spark.range(1000).withColumn("v", F.col("id") % 5), "id", ["v"], 1000).orderBy("id").collect()
    at = 0
    for r in sums:
        at += r.v
        assert r.v_to == at
    assert len(sums) == 1000
