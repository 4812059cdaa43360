import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from kgloom.llm import common, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, d string, x map<string,int>, talk string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "n", None, {"a": 1}, "t") for r in rows], SCHEMA).repartition(parts)


def expected(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    if not own:
        return []
    talks = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = None if c is None else c - (abs(c) % 20) * (1 if c > 0 else -1)
        talks[c] = (own.get(base, [])[:h] if h else []) + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, v in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(v) - 1) * words
    out = []
    for k, v in members.items():
        ids = ",".join(map(str, sorted(c for c in ends[k] if c is not None)))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), kids[k], leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def awkward(n, seed=1):
    rnd, rows = random.Random(seed), []
    for c in range(-30, n):
        if rnd.random() < 0.1:
            continue  # some bases are absent
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a b", "a  b\tc", "", None, "x" * 3000 + " y", "b"])))
    rows += [(None, t, "user", "no id") for t in range(3)] + [rows[5]] * 3
    return rows


def test_against_brute_force(spark):
    rows = awkward(150)
    got = prefix_trie.digest(frame(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert key(got.collect()) == key(expected(rows))
    assert prefix_trie.digest(frame(spark, [])).count() == 0
    assert prefix_trie.digest(frame(spark, [(None, 1, None, None)])).collect()[0].conv_id is None


def test_long_conversations_and_pieces(spark, monkeypatch):
    """Blocks of blocks: conversations far longer than a block that agree for a while; ids in many pieces."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(common, "SPAN", 5)
    rnd, rows = random.Random(2), []
    for c in range(40, 75):
        n = rnd.choice([1, 3, 9, 10, 27, 40])
        rows += [(c, t, "user", "same" if t < 25 else rnd.choice("ab")) for t in range(n)]
    assert key(prefix_trie.digest(frame(spark, rows)).collect()) == key(expected(rows))


def test_a_hot_conversation_and_a_hot_first_turn_spread(spark):
    """One conversation of 1200 turns: no group of its rows larger than a block is formed."""
    rows = [(7, t, "user", f"t {t % 5}") for t in range(1200)] + [(c, 0, "system", "same") for c in range(100, 400)]
    turns, convs = prefix_trie.numbered(frame(spark, rows))
    assert turns.where("conv_id = 7").agg(F.max("d")).first()[0] == 1200
    nodes = prefix_trie.ranked(turns)
    assert nodes.agg(F.max("node")).first()[0] == 1201
    got = prefix_trie.build(turns, convs).where("depth = 1").collect()
    assert sorted((r.n_convs, r.n_leaves) for r in got) == [(1, 1), (300, 1)]
