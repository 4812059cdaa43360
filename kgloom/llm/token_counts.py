"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Its tokens' spans are then joined with the spans of its
sections, interval against interval, so a section's count is what it really costs inside its
document, not what it would cost alone. Both lists of spans ascend; the join is a search of one
in the other.

Boundary-crossing tokens are allocated by an explicit rule:

    "start"    to the section in which the token's first byte lies (the default)
    "end"      to the section in which its last byte lies
    "largest"  to the section with most of its bytes, the earlier one of equals

Counts of all sections add up to the document's, whatever the rule. Spans are in bytes of UTF-8,
as a byte-level token may hold a part of a character; sections are reported in characters. Where
a vocabulary drops white space, spans are the library's character offsets, with the same rules.

Sections of a text are its lines, each with its line feed, so they tile the text. ``fields``
counts several columns of a row as the sections of their concatenation.

Defined results: a null or empty text is one empty section without tokens; repeated rows are
counted as often as they occur, ties in any order; a null doc_id stays null; a very long text is
encoded whole; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.tokens import encoder

RULES = ("start", "end", "largest")
FLUSH = 50_000


@lru_cache(maxsize=8)
def _byte_lengths(path: str) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary: its alphabet has one character per byte."""
    tk = encoder(path).tk
    return np.array([len(tk.id_to_token(i) or "") for i in range(tk.get_vocab_size())], np.int64)


def spans(path: str, text: str, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(starts, ends) of the text's tokens, in bytes where the vocabulary is byte-level and keeps
    white space (then True), else in characters. ids: the text's, if they are known."""
    enc = encoder(path)
    if enc.kind == "spaced":
        ends = np.cumsum(_byte_lengths(path)[np.frombuffer(enc.ids(text), "<u4") if ids is None else ids])
        return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends, True
    got = np.array(enc.tk.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1], False


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section. ``bounds`` are the sections' edges, ascending, one more than sections."""
    n = len(bounds) - 1
    last = np.maximum(ends - 1, starts)
    first_in = np.searchsorted(bounds[1:], starts, "right")
    last_in = np.searchsorted(bounds[1:], last, "right")
    if rule == "start":
        at = first_in
    elif rule == "end":
        at = last_in
    elif rule == "largest":
        at = first_in.copy()
        for i in np.flatnonzero(first_in != last_in):  # crossing tokens: few
            k = np.arange(first_in[i], last_in[i] + 1)
            held = np.minimum(ends[i], bounds[k + 1]) - np.maximum(starts[i], bounds[k])
            at[i] = k[np.argmax(held)]
    else:
        raise ValueError(f"unknown rule {rule!r}, not one of {RULES}")
    return np.bincount(np.minimum(at, n - 1), minlength=n)


def count_sections(path: str, pieces: list[str], rule: str = "start", ids: np.ndarray | None = None) -> np.ndarray:
    """Tokens of each of the pieces as sections of their concatenation."""
    starts, ends, in_bytes = spans(path, "".join(pieces), ids)
    size = [len(p.encode("utf-8", "surrogatepass")) if in_bytes else len(p) for p in pieces]
    return attribute(starts, ends, np.concatenate([[0], np.cumsum(size)]), rule)


def lines(text: str) -> list[str]:
    """Lines with their line feed; an empty text is one empty line."""
    cut = text.split("\n")
    out = [x + "\n" for x in cut[:-1]] + ([cut[-1]] if cut[-1] else [])
    return out or [""]


def sections(docs: DataFrame, path: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per section: doc_id, section, start, end (characters), n_tokens, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}, not one of {RULES}")
    names = ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"]

    def out(got):
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in got[1:]]
        return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), *[pa.array(c, pa.int64()) for c in cols]], names)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            got, held = [[], [], [], [], [], []], 0
            for doc, t, own in zip(b.column(0).to_pylist(), b.column(1), enc.each(b.column(1)) if enc.kind == "spaced" else repeat(None)):
                pieces = lines(t.as_py() or "")
                counts = count_sections(path, pieces, rule, own)
                ends = np.cumsum([len(p) for p in pieces])
                n = len(pieces)
                got[0] += [doc] * n
                for c, v in zip(got[1:], (np.arange(n), np.concatenate([[0], ends[:-1]]), ends, counts, np.full(n, counts.sum()))):
                    c.append(v)
                held += n
                if held >= FLUSH:
                    yield out(got)
                    got, held = [[], [], [], [], [], []], 0
            yield out(got)

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return read.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def fields(table: DataFrame, path: str, id_col: str, cols: list[str], rule: str = "start") -> DataFrame:
    """A row per row and field: id, field, n_tokens, for columns read one after another as one text."""

    def run(batches):
        for b in batches:
            ids, names, n = [], [], []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                ids += [row[0]] * len(cols)
                names += cols
                n += count_sections(path, [x or "" for x in row[1:]], rule).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(n, pa.int64())], ["id", "field", "n_tokens"])

    read = table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    return read.mapInArrow(run, "id bigint, field string, n_tokens bigint")
