import hashlib
import random

import numpy as np
import pytest

from kgloom.llm import spotsigs as SP
from tests.llm import corpus


def test_signatures():
    a = SP.signatures("The quick brown fox is in the lazy garden today.")
    assert a.tolist() == sorted(set(a.tolist())) and len(a)
    assert SP.signatures("the Quick, brown fox is in the lazy garden today").tolist() == a.tolist()
    assert len(SP.signatures("")) == 0 and len(SP.signatures(None)) == 0 and len(SP.signatures("word")) == 1 and len(SP.signatures("qq ww ee rr")) == 2
    assert SP.from_text(SP.to_text(a)).tolist() == a.tolist()


def test_jaccard_and_bands():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 200, rng.integers(0, 150)).astype(np.uint32)) for _ in range(2))
        union = set(a.tolist()) | set(b.tolist())
        j = len(set(a.tolist()) & set(b.tolist())) / len(union) if union else 1.0
        assert SP.jaccard(a, b) == pytest.approx(j)
        for t in (0.3, 0.8):
            assert SP.jaccard(a, b, t) == pytest.approx(j if j >= t else 0.0)
    for n in range(1, 400):
        for m in range(n, int(n / 0.8) + 1):
            assert SP.band(m) - SP.band(n) in (0, 1)


def test_compare_with_next_equals_brute_force(spark, sf_dir):
    rows = [r for r in corpus.rows(spark, sf_dir, 40) if r[0] is not None]
    seen, unique = set(), []
    for r in rows:  # ties of doc_id have their own test below
        if r[0] not in seen:
            seen.add(r[0])
            unique.append(r)
    df = spark.createDataFrame(unique, corpus.SCHEMA).repartition(3)
    order = sorted(unique, key=lambda r: -r[0])
    for parts in (1, 4, 9):
        got = {r.doc_id: r for r in SP.compare_with_next(df, parts).collect()}
        assert len(got) == len(order)
        for i, r in enumerate(order):
            text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
            k = len(text) // 3
            alter = text[: len(text) - k] + following[:k]
            g = got[r[0]]
            assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(alter.encode()).hexdigest())
            assert g.fingerprint == SP.to_text(SP.signatures(text)) and g.edited_fingerprint == SP.to_text(SP.signatures(alter))
            assert g.near_edited == SP.jaccard(SP.signatures(text), SP.signatures(alter)) and g.near_next == SP.jaccard(SP.signatures(text), SP.signatures(following))


def test_ties_nulls_and_single_rows(spark, sf_dir):
    df = corpus.frame(spark, sf_dir, 10)
    got = SP.compare_with_next(df, 4).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in df.collect())
    one = df.where("doc_id = 9006")
    r = SP.compare_with_next(one, 3).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert SP.compare_with_next(corpus.empty(spark), 3).count() == 0


def test_a_crowd_and_a_shared_passage(spark):
    """Near copies of one text, and different texts that share a passage: classes by plain Python."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [x for _ in range(n) for x in (rng.choice(["the", "of", "and"]), rng.choice(words), rng.choice(words))]
    base, passage, rows = text(60), text(6), []
    for i in range(120):
        alter = list(base)
        for _ in range(rng.choice([1, 2, 9])):
            alter[rng.randrange(len(alter))] = rng.choice(words)
        rows.append((i, " ".join(alter if i % 2 else [*passage, *text(rng.choice([3, 20]))]), *[None] * 11))
    got = {r.doc_id: r.class_id for r in SP.near_duplicates(spark.createDataFrame(rows, corpus.SCHEMA)).collect()}
    assert got == classes(rows)


def classes(rows):
    sigs, label = [SP.signatures(r[1]) for r in rows], list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if SP.jaccard(sigs[i], sigs[j]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            m = min(label[i], label[j])
            changed |= (label[i], label[j]) != (m, m)
            label[i] = label[j] = m
    return {r[0]: rows[label[i]][0] for i, r in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark, sf_dir):

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and", "is"] * 20
    rows = []
    for g in range(8):
        base = [rng.choice(words) for _ in range(150)]
        for c in range(5):
            alter = list(base)
            for _ in range(rng.choice([0, 1, 3, 30])):
                alter[rng.randrange(len(alter))] = rng.choice(words)
            rows.append((g * 5 + c, " ".join(alter), *[None] * 11))
    rows += [(90, "", *[None] * 11), (91, None, *[None] * 11)]
    got = {r.doc_id: r.class_id for r in SP.near_duplicates(spark.createDataFrame(rows, corpus.SCHEMA)).collect()}
    sigs = [SP.signatures(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if SP.jaccard(sigs[i], sigs[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    assert got == {r[0]: rows[label[i]][0] for i, r in enumerate(rows)}


def test_links_grow_with_a_crowd_not_with_its_square(spark, monkeypatch):
    """Texts that drift from one to another, many of each kind: one class, whoever leads a group."""
    rng = random.Random(3)
    unit = lambda: [rng.choice(["the", "of", "and"]), f"w{rng.randrange(10**6)}", f"w{rng.randrange(10**6)}"]
    one, two, rows = [unit() for _ in range(60)], [unit() for _ in range(60)], []
    for i in range(200):
        units = two[: i // 10] + one[i // 10 :]
        units[rng.randrange(30, 60)] = unit()
        rows.append((i, " ".join(w for u in units for w in u), *[None] * 11))
    made, write = [], SP.common.written
    monkeypatch.setattr(SP.common, "written", lambda df, name, *a: made.append((name, write(df, name, *a))) or made[-1][1])
    got = {r.doc_id: r.class_id for r in SP.near_duplicates(spark.createDataFrame(rows, corpus.SCHEMA)).collect()}
    assert got == classes(rows) and len(set(got.values())) == 1
    assert sum(df.count() for name, df in made if name == "alike") < 10 * len(rows)
