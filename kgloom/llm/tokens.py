"""Exact tokenization by a tokenizer file, batch by batch over distinct words.

Both public vocabularies pre-split a text, and the split never crosses the edge of a chunk between
two single white spaces. A chunk's ids therefore depend on the chunk alone. A batch of texts is cut
at its spaces and line feeds in Arrow, its chunks are dictionary-encoded there, only distinct chunks
are looked up in a memory of those already seen, only new ones reach the tokenizers library, and the
ids of all chunks are gathered in numpy. Texts that do not meet the conditions (runs of white
space, strings of special tokens, controls at a chunk's edge) and files with any other layout are
encoded whole by the library.

The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` with
nothing set on the tokenizer: the string of a special token in a text is that one token.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-splitting patterns of the two public files, restricted to printable ASCII.
SPACED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\n")
BARE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
BARE_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A plain word, with or without a line feed before it and marks behind it, which are one
#: pre-split piece. Its letters have one lower case each, and no two of them compose; a dotted capital I
#: is none of them, as its lower case ends in a mark.
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{1C3}\x{1CD}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}"
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
PLAIN, BEHIND = rf"^\n?[{_LETTERS}]+[!-/:-@\[-`{{-~]*$", rf"^\n?[{_LETTERS}]+"
#: The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Characters on whose being white space Python and the tokenizers differ, and other controls.
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f᠎​﻿]")

#: Distinct chunks a worker remembers, their characters, pieces, and bytes of text that are encoded at once.
MEMORY, CHARS, PIECES, SLICE = 500_000, 32 << 20, 50_000, 6 << 20

_encoders: dict[tuple, "Encoder"] = {}


def encoder(path: str, memory: int = MEMORY) -> "Encoder":
    """One encoder per worker process and file; it outlives the task."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = Encoder(path, memory)
    return _encoders[path, memory]


def kind_of(path: str) -> str:
    """"spaced": byte-level BPE whose words carry their space; "bare": lower-cased words, white
    space dropped; "whole": anything else, encoded by the library alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("post_processor") or model.get("type") != "BPE" or model.get("dropout"):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    pres = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pres] == ["Split", "ByteLevel"]:
        split = pres[0]
        if split["pattern"].get("Regex") == BARE_SOURCE and split["behavior"] == "Removed" and split["invert"] and not pres[1]["use_regex"]:
            return "bare"
    return "whole"


def _bytes_of(ids) -> bytes:
    return array("I", ids).tobytes()


def listed(words: pa.Array) -> list[str]:
    """Strings without line feeds as a list, by way of one string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n") if len(words) else []


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``start``, one after another."""
    ends = np.cumsum(length)
    kind = np.int32 if len(pool) < 1 << 30 and (not len(ends) or ends[-1] < 1 << 30) else np.int64
    place = np.repeat((start - ends + length).astype(kind), length)
    place += np.arange(len(place), dtype=kind)
    return pool[place]


class Encoder:
    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.model = self.tk.model
        self.kind, self.memory = kind_of(path), memory
        self.special = sorted({t.content for t in self.tk.get_added_tokens_decoder().values()})
        self.pieces: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """The memory is emptied when it is full; entry 0 is the empty string."""
        self.index: dict[str, int] = {"": 0}
        self.count, self.used, self.chars = 1, 0, 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, "<u4")

    # ---- one chunk ----

    def whole(self, text: str) -> bytes:
        return _bytes_of(self.tk.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-split piece in the byte-level alphabet; few pieces but plain words are many."""
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            got = self.pieces[piece] = _bytes_of([t.id for t in self.model.tokenize(piece)])
        return got

    def bare(self, chunk: str) -> bytes:
        """A chunk of a vocabulary that drops white space."""
        if chunk.isascii() and chunk.isprintable():
            return b"".join(map(self.piece, BARE.findall(chunk.lower())))
        norm = self.tk.normalizer.normalize_str(chunk)
        return b"".join([self.piece(p) for p, _ in self.tk.pre_tokenizer.pre_tokenize_str(norm)])

    def spaced(self, chunk: str) -> bytes | None:
        """A chunk with the space before it; a leading line feed stands for that space. None: the
        chunk has white space, or what may be some, at an edge and can't stand alone."""
        feed = chunk[0] == "\n"
        body = chunk[1:] if feed else chunk
        if not body or body[0].isspace() or body[-1].isspace() or _CONTROL.search(body):
            return None
        full = chunk if feed else " " + chunk
        if body.isascii() and body.isprintable():
            return b"".join([self.piece(p.replace(" ", "Ġ").replace("\n", "Ċ")) for p in SPACED.findall(full)])
        return b"".join([self.piece(p) for p, _ in self.tk.pre_tokenizer.pre_tokenize_str(full)])

    # ---- many chunks ----

    def plain(self, words: list[str], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids a word) of words of letters alone, which are one pre-split piece each."""
        shown = [lead + (w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LEVEL)) for w in words]
        made = list(map(self.model.tokenize, shown))
        size = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(map(attrgetter("id"), chain.from_iterable(made)), "<u4", int(size.sum())), size

    def spaced_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.plain(words, "Ġ")

    def chunked(self, chunks: list[str], make) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids a chunk) of any chunks; a chunk that can't stand alone has -1."""
        made = [make(c) for c in chunks]
        size = np.fromiter((-1 if b is None else len(b) // 4 for b in made), np.int64, len(made))
        return np.frombuffer(b"".join([b for b in made if b]), "<u4"), size

    def entries(self, words: list[str], make, mark: str = "") -> np.ndarray:
        """Entries of the words in the memory; new ones are made. A mark sets words apart."""
        keys = [mark + w for w in words] if mark else words
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        ids, size = make([words[i] for i in new.tolist()])
        first, self.count = self.count, self.count + len(new)
        while self.count > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.length[first : self.count] = size
        size = np.maximum(size, 0)
        self.start[first : self.count] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at[new] = np.arange(first, self.count)
        fresh = [keys[i] for i in new.tolist()]
        self.chars += sum(map(len, fresh))
        self.index.update(zip(fresh, range(first, self.count)))
        return at

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, starts, lengths) of distinct chunks. A plain word is looked up without the line feed
        before it and the marks behind it, and in lower case where the vocabulary has no other."""
        bare = self.kind == "bare"
        is_plain = pc.match_substring_regex(words, PLAIN)
        hit = np.flatnonzero(is_plain.to_numpy(zero_copy_only=False))
        other = np.flatnonzero(~is_plain.to_numpy(zero_copy_only=False))
        plain = words.filter(is_plain)
        units = np.zeros((len(words), 3), np.int64)  # entries of line feed, word and marks; 0 is nothing
        ends, data = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1], np.frombuffer(plain.buffers()[2] or b"", np.uint8)
        feeds = data[ends[:-1]] == 10 if len(plain) else np.zeros(0, bool)
        base = pc.ascii_trim(plain, MARKS + "\n")
        ended = pc.binary_length(plain).to_numpy() > pc.binary_length(base).to_numpy() + feeds
        if ended.any():
            behind = pc.replace_substring_regex(plain.filter(pa.array(ended)), BEHIND, "").dictionary_encode()
            make = lambda x: self.chunked(x, lambda c: _bytes_of([t.id for t in self.model.tokenize(c)]))
            units[hit[ended], 2] = self.entries(listed(behind.dictionary), make, "\x00\n.")[behind.indices.to_numpy()]
        base = pc.utf8_lower(base) if bare else base
        for make, mark, rows in ((self.plain if bare else self.spaced_plain, "", ~feeds), (self.plain, "\x00\nw", feeds)):
            if rows.any():
                own = base.filter(pa.array(rows)).dictionary_encode()
                units[hit[rows], 1] = self.entries(listed(own.dictionary), make, mark)[own.indices.to_numpy()]
        units[hit[feeds], 0] = self.entries(["\n"], lambda x: self.chunked(x, lambda c: _bytes_of([t.id for t in self.model.tokenize("Ċ")])), "\x00\nf")[0]
        units[other, 1] = self.entries(words.take(pa.array(other)).to_pylist(), lambda x: self.chunked(x, self.bare if bare else self.spaced))
        length = self.length[units]
        size = length.sum(axis=1)  # a chunk that can't stand alone has nothing beside it
        pool = gather(self.pool, self.start[units].ravel(), np.maximum(length, 0).ravel())
        kept = np.maximum(size, 0)
        return pool, np.cumsum(kept) - kept, size

    def slice(self, texts: pa.Array, tail: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, their numbers) of texts without nulls."""
        m = len(texts)
        if self.count > self.memory or self.chars > CHARS:
            self.forget()
        by_library = np.zeros(m, bool)
        if self.kind == "whole":
            by_library[:] = True
            offsets, pool, start, length = np.arange(m + 1), self.pool[:0], np.zeros(m, np.int64), np.zeros(m, np.int64)
        else:
            for s in self.special:
                by_library |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.kind == "bare" else " \n"), " ")
            offsets = cut.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            distinct = cut.flatten().dictionary_encode()
            code, words = distinct.indices.to_numpy(), distinct.dictionary
            del cut, distinct
            pool, start, length = self.lookup(words)
            if self.kind == "spaced":
                # an empty chunk is a run of white space, but for the one that opens a text
                length = np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), -1, length)
                first = code[offsets[:-1]]
            start, length = start[code], length[code]
            if self.kind == "spaced":  # the chunk that opens a text has no space before it
                heads, which = np.unique(first, return_inverse=True)
                at = self.entries(words.take(pa.array(heads)).to_pylist(), lambda x: self.chunked(x, self.whole), "\x00\nh")
                ids = gather(self.pool, self.start[at], self.length[at])
                start[offsets[:-1]] = (len(pool) + np.cumsum(self.length[at]) - self.length[at])[which]
                length[offsets[:-1]] = self.length[at][which]
                pool = np.concatenate([pool, ids])
            if (length < 0).any():
                by_library[np.searchsorted(offsets, np.flatnonzero(length < 0), "right") - 1] = True
        if by_library.any():
            hit = np.flatnonzero(by_library)
            made = [self.whole(texts[i].as_py()) for i in hit.tolist()]
            length[np.repeat(by_library, np.diff(offsets))] = 0
            size = np.array([len(b) // 4 for b in made], np.int64)
            start[offsets[hit]] = len(pool) + np.cumsum(size) - size
            length[offsets[hit]] = size
            pool = np.concatenate([pool, np.frombuffer(b"".join(made), "<u4")])
        if tail is not None:  # one more unit behind each text
            pool = np.append(pool, np.array([tail], "<u4"))
            start, length = np.insert(start, offsets[1:], len(pool) - 1), np.insert(length, offsets[1:], 1)
            offsets = offsets + np.arange(m + 1)
        ends = np.concatenate([[0], np.cumsum(length)])
        return gather(pool, start, length), np.diff(ends[offsets])

    def batches(self, texts, tail: int | None = None, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, ids a text) by slices of about ``size`` bytes, whole texts
        each. A null text is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield i, *self.slice(texts[i:j], tail)
            i = j

    def each(self, texts) -> Iterator[np.ndarray]:
        """The ids of every text."""
        for _, ids, n in self.batches(texts):
            yield from np.split(ids, np.cumsum(n)[:-1])

    def ids(self, text: str | None) -> bytes:
        """Ids of one whole text as little-endian 32-bit bytes; null counts as empty."""
        return self.slice(pa.array([text or ""], pa.string()), None)[0].tobytes()


def binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value a text, of ids that stand one after another."""
    offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
