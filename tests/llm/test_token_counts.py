import numpy as np
import pytest

from kgloom.llm import token_counts as TC
from kgloom.llm.registry import BYTE_BPE, WORD_BPE, vocabulary
from tests.llm import corpus

TEXTS = ["", "one line", "two\nlines\n", "\n\n\nthree feeds\n\n\n\nand  more   space\n", "é日本\n🙂🙂\nß", "a\n \n\tb", "x" * 500 + "\n" + "y" * 500]


def test_spans_equal_the_library_offsets():
    path = vocabulary(BYTE_BPE)
    tk = TC.encoder(path).tk
    for t in TEXTS:
        starts, ends, in_bytes = TC.spans(path, t)
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])])
        assert in_bytes and (ends[-1] if len(ends) else 0) == at[-1]
        for (a, b), s, e in zip(tk.encode(t, add_special_tokens=False).offsets, starts, ends):
            assert at[a] <= s < e <= at[b]  # a token within a character spans it whole in characters


@pytest.mark.parametrize("rule", TC.RULES)
def test_attribution_by_rule(rule):
    rng = np.random.default_rng(1)
    for _ in range(100):
        edges = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 30))])
        bounds = np.concatenate([[0], np.sort(rng.integers(0, edges[-1] + 1, 5)), [edges[-1]]])
        want = np.zeros(len(bounds) - 1, int)
        for a, b in zip(edges[:-1], edges[1:]):
            held = [max(0, min(b, hi) - max(a, lo)) for lo, hi in zip(bounds[:-1], bounds[1:])]
            inside = [i for i, h in enumerate(held) if h]
            want[{"start": inside[0], "end": inside[-1], "largest": int(np.argmax(held))}[rule]] += 1
        assert TC.attribute(edges[:-1], edges[1:], bounds, rule).tolist() == want.tolist()


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_sections_add_up(spark, sf_dir, name):
    path = vocabulary(name)
    df, tk = corpus.frame(spark, sf_dir, 25), TC.encoder(path).tk
    got = TC.sections(df, path).collect()
    want = sorted((str(r.doc_id), len(tk.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    by = {}
    for r in got:
        assert 0 <= r.start <= r.end
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r.n_tokens)
    assert all(sum(v) % k[1] == 0 if k[1] else sum(v) == 0 for k, v in by.items())
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.section == 0) == want
    assert TC.sections(corpus.empty(spark), path).count() == 0
    with pytest.raises(ValueError):
        TC.sections(df, path, "middle")


def test_fields(spark):
    df = spark.createDataFrame([(1, "Hello wor", "ld again", None)], "id bigint, a string, b string, c string")
    got = {r.field: r.n_tokens for r in TC.fields(df, vocabulary(BYTE_BPE), "id", ["a", "b", "c"]).collect()}
    assert got == {"a": 2, "b": 1, "c": 0}  # " world" begins in a
    got = {r.field: r.n_tokens for r in TC.fields(df, vocabulary(BYTE_BPE), "id", ["a", "b", "c"], "end").collect()}
    assert got == {"a": 1, "b": 2, "c": 0}
