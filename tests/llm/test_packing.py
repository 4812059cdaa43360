import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from kgloom.llm import packing
from kgloom.llm.registry import BYTE_BPE, WORD_BPE, vocabulary
from kgloom.llm.tokens import Encoder, binary

TRICKY = [
    "", " ", "a", "  two  spaces ", "line\nline\n\nmore\n", "tab\tin side", "trail ", " lead", "don't we'll it's",
    "Ünïcödé straße Σίσυφος ΣΑΣ", "é combining ́ alone", "<|endoftext|> text <|startoftext|>", "x nbsp y em",
    "\x00 control \x1c sep\x1d", "日本語 テキスト 🙂🙂", "a\r\nb\r\n c", "123 4567 8,9.0", "\n", "\nfirst", "word", "A​B zero", "İstanbul ǅ", "﻿bom",
    "TARİHİ.", "TARİHİ, ve", "İ?", "<|ENDOFTEXT|>", "a<|endoftext|>b", "J\u030c H\u0331.", "\u212aK", " a b", "a b ", "a  b", " \na", "\x85a b\x85", "ŉ x. ǅ!",
]


@lru_cache
def library(name):
    """An untouched tokenizer of the library."""
    return Tokenizer.from_file(vocabulary(name))


def want(name, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in library(name).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_encoder_equals_the_library(name, spark, sf_dir):
    e = Encoder(vocabulary(name), memory=500)
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    ref = want(name, texts)
    assert [x.tobytes() for x in e.each(pa.array(texts))] == ref
    for t, r in zip(texts[: len(TRICKY)], ref):
        assert e.ids(t) == r, t


LETTERS = "aAbBİIıΣςÉé\u030c\u0307\u0301J.,;:!?'st \n\t09<|> \xa0\u2003\u200b\x1c\x85ßǅʼ日🙂-_ " + "    "


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from(LETTERS), max_size=14), st.text(max_size=14), st.sampled_from(TRICKY)), min_size=1, max_size=60))
def test_random_strings_equal_the_library(name, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    e = Encoder(vocabulary(name), memory=40)
    for a in (0, 1):  # the second time from memory
        assert [x.tobytes() for x in e.each(pa.array(texts))] == want(name, texts)
    ids, n = (np.concatenate(x) for x in zip(*[(i, c) for _, i, c in e.batches(pa.array([*texts, None]), tail=2)]))
    assert binary(ids, n).to_pylist() == [x + b"\x02\0\0\0" for x in [*want(name, texts), b""]]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()), T.StructField("ids", T.LongType())])


def test_pieces_cover_every_id_once(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TRICKY)] + [(None, "no id", None, None), (7, None, "y", 2), (7, None, "y", 2), (90, "long words here " * 900, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pieces = packing.pack(df, vocabulary(WORD_BPE), window=16)
    got = packing.digest(pieces).collect()
    enc = library(WORD_BPE)
    ids_of = lambda t: np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert sum(r.length for r in got) == sum(len(ids_of(r[1])) for r in rows)
    byseq = {}
    for r in got:
        byseq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, spans in byseq.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == 16 or s == max(byseq) and at <= 16
    long = ids_of("long words here " * 900)
    mine = sorted((r for r in got if r.doc_id == 90), key=lambda r: r.start)
    assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
    for r in mine:
        assert r.doc_tokens == len(long)
        assert r.ids_crc32 == zlib.crc32(long[r.start : r.start + r.length].tobytes())
    seq = packing.sequences(pieces, 16).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in seq)
    assert all(r.padded_tokens == (r.n_tokens if bin(r.n_tokens).count("1") == 1 else 16) for r in seq)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), vocabulary(WORD_BPE)).count() == 0


def test_the_memory_is_bounded_by_characters(monkeypatch):
    from kgloom.llm import tokens

    monkeypatch.setattr(tokens, "CHARS", 500)
    e, texts = Encoder(vocabulary(BYTE_BPE)), [f"{'日本' * 40}{i} {'x' * 90}{i}" for i in range(60)]
    got = [x.tobytes() for t in texts for x in e.each(pa.array([t]))]
    assert got == want(BYTE_BPE, texts) and e.chars < 1200
