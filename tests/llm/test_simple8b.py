import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kgloom.llm import simple8b
from kgloom.llm.registry import BYTE_BPE, vocabulary
from tests.llm import corpus


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 50_256), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1)), max_size=700))
def test_round_trip(ids):
    words, offsets = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, offsets, len(ids)).tolist() == ids


@pytest.mark.parametrize("ids", [[0] * 1000, [0] * 119 + [7], [1] * 500, [2**64 - 1] * 300, [2**60, 15 << 60, 0, 2**60 - 1] * 50, list(range(5000))])
def test_runs_and_escapes(ids):
    words, offsets = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, offsets, len(ids)).tolist() == ids
    if not any(ids):
        assert len(words) <= 2 * (len(ids) // 128 + 1)


def test_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK", 3000)
    rows = corpus.rows(spark, sf_dir)
    got = simple8b.digest(simple8b.read_files(simple8b.write_files(corpus.frame(spark, sf_dir), vocabulary(BYTE_BPE), files=4))).collect()
    enc = Tokenizer.from_file(vocabulary(BYTE_BPE))
    want = {}
    for r in rows:
        ids = np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.setdefault(r[0], []).append((len(ids) // 4, zlib.crc32(ids)))
    mine, at = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        mine.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert simple8b.read_files(simple8b.write_files(corpus.empty(spark), vocabulary(BYTE_BPE))).count() == 0
