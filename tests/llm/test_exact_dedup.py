import hashlib
from collections import defaultdict

from kgloom.llm import exact_dedup
from tests.llm import corpus


def test_annotate_and_deduplicate(spark, sf_dir):
    rows, df = corpus.rows(spark, sf_dir), corpus.frame(spark, sf_dir)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.digest(exact_dedup.annotate(df)).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    kept = defaultdict(list)
    for r in got:
        t = sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
        if r.kept:
            kept[t].append(r.doc_id)
    assert kept == {t: [best[t]] for t in groups}
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(x) for x in best.values())
    assert exact_dedup.annotate(corpus.empty(spark)).count() == 0
    assert exact_dedup.deduplicate(corpus.empty(spark)).count() == 0


def test_heavy_groups_leave_on_the_map_side(spark):
    rows = [(i, "hot" if i % 3 else f"cold {i}", *[None] * 11) for i in range(3000)]
    df = spark.createDataFrame(rows, corpus.SCHEMA).repartition(6)
    heavy = exact_dedup.heavy_winners(df.selectExpr("doc_id", "unhex(sha2(text, 256)) digest", "monotonically_increasing_id() rid")).collect()
    assert [(r.best.doc_id, r.group_size) for r in heavy] == [(2999, 2000)]
    assert exact_dedup.deduplicate(df).count() == 1001


def test_repeated_winners(spark):
    rows = [(None, "a", 1), (None, "a", 2), (4, "b", 1), (4, "b", 2), (3, "b", 3), (None, "b", 4), (5, None, 1), (5, "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest int")
    left = exact_dedup.deduplicate(df.repartition(3))
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("4", "b"), ("5", ""), ("None", "a")]
    got = exact_dedup.annotate(df).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 3 and sorted({r.group_size for r in got}) == [2, 4]
