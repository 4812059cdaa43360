"""Language of documents: string kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

A text's features are the character n-grams of length 1 to 3 (the blended spectrum) that occur in it:
presence, not counts. Letters are lowered, what lies between them is one space. The kernel of two texts
is the number of n-grams they share over the geometric mean of the numbers they have, within a
dictionary. LANDMARKS sample texts stand for the sample (Nyström); a ridge regression of +1 and -1 for
each language is solved on their features. A batch is scored by two matrix products: presence with the
landmarks' presence, kernel values with the machines' weights.

The fit reads a bounded sample: at most SAMPLE labelled rows, for each language an equal share chosen by
a hash, of rare languages all rows. Its dictionary is the DICTIONARY n-grams of most sample
texts, counted in the cluster; a sample row comes to the driver as one bit for each. At most LANGUAGES
languages, those of most rows, are learned. Everything else covers all rows and whole texts.

Defined results: ``und`` with score 0 for a null text and one without a letter, and for all rows where
nothing could be learned; with one language learned that one, with score 1. An empty text has no letter.
Ties go to the lesser language name. Rows without an id are never held out. Repeated rows and equal texts
get equal predictions. A very long text is read whole, in slices that overlap. An empty table gives no
rows. Other columns, whatever their names, are not read; ``lang`` is read for the fit alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common

#: Bounds of the fit.
SAMPLE, DICTIONARY, LANDMARKS, LANGUAGES = 3000, 16_384, 256, 200
#: Texts of a matrix product, characters of a slice, entries of a table that finds n-grams at once.
BATCH, SLICE, DIRECT = 128, 1 << 20, 1 << 22
#: Bits of a character in the code of an n-gram; 0 is no character.
BITS = 21
SPACE = 32


@functools.cache
def _plain() -> np.ndarray:
    """For every code point: the lower-case letter, or 0 for anything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str) -> Iterator[np.ndarray]:
    """A text's characters, whole, in slices that share two: letters lowered, one space for anything between."""
    tail = np.zeros(0, np.int64)
    for at in range(0, len(text), SLICE):
        c = _plain()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        c[c == 0] = SPACE
        c = np.concatenate([tail, c])
        gap = c == SPACE
        c = c[~(gap & np.concatenate([[False], gap[:-1]]))]
        yield c
        tail = c[-2:]


def spectrum(c: np.ndarray) -> list[np.ndarray]:
    """The codes of the n-grams of 1, 2 and 3 characters."""
    one = c
    two = (c[:-1] << BITS) | c[1:]
    three = (two[:-1] << BITS) | c[2:]
    return [one, two, three]


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text; none of a text without a letter."""
    found = np.zeros(0, np.int64)
    for c in letters(text or ""):
        found = np.union1d(found, np.unique(np.concatenate(spectrum(c))))
    return found[found != SPACE] if (found != SPACE).any() else np.zeros(0, np.int64)


class Dictionary:
    """n-grams by their code, found for whole arrays of them."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes)
        chars = np.unique(np.concatenate([self.codes & 0x1FFFFF, (self.codes >> BITS) & 0x1FFFFF, self.codes >> 2 * BITS]))
        self.chars = np.zeros(0x110000, np.int64)  # 0: no character, or none of the dictionary
        self.chars[chars[chars > 0]] = np.arange(1, (chars > 0).sum() + 1)
        self.base = int((chars > 0).sum()) + 1
        self.table = None
        if self.base**3 <= DIRECT:
            self.table = np.full(self.base**3, -1, np.int32)
            a, b, c = (self.chars[x] for x in (self.codes >> 2 * BITS, (self.codes >> BITS) & 0x1FFFFF, self.codes & 0x1FFFFF))
            self.table[(a * self.base + b) * self.base + c] = np.arange(len(self.codes))

    def __len__(self) -> int:
        return len(self.codes)

    def present(self, text: str) -> tuple[np.ndarray, bool]:
        """Which of the n-grams occur in a text, and whether it has a letter."""
        out, any_letter = np.zeros(len(self) + 1, bool), False
        for c in letters(text):
            any_letter |= bool((c != SPACE).any())
            if self.table is not None:
                k = self.chars[c]
                two = k[:-1] * self.base + k[1:]
                for x in (k, np.where(k[:-1] > 0, two, 0), np.where((k[:-2] > 0) & (k[1:-1] > 0), two[:-1] * self.base + k[2:], 0)):
                    out[self.table[x]] = True  # -1, not there, is the place after the last
            elif len(self):
                for x in spectrum(c):
                    at = np.minimum(np.searchsorted(self.codes, x), len(self) - 1)
                    out[at[self.codes[at] == x]] = True
        return out[:-1], any_letter


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # the dictionary
    marks: np.ndarray  # presence of its n-grams in the landmarks, a bit each
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    sharp: float  # of the score's exponential


def _kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of presence rows with the landmarks."""
    norm = lambda m: np.sqrt(np.maximum(m.sum(1, dtype=np.float32), 1))
    return (x @ marks.T) / (norm(x)[:, None] * norm(marks)[None])


def _dense(bits: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=width).astype(np.float32)


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, key, text in zip(b.column("lang"), b.column("key"), b.column("text")):
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang.as_py()]), "key": pa.array([key.as_py()], pa.int64()), "grams": pa.array([grams(text.as_py())], pa.list_(pa.int64()))})


def sample(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` rows (lang, key, text) to learn from: those with a language and a text that are not held
    out, repeated rows once. A language's rows are thinned to its share by a hash; what chance leaves above the
    bound goes by the hash. Hashes alone are sorted; texts move only after the choice."""
    rows = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("count")).orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    share, left = 0.0, 0.9 * most
    for i, n in enumerate(sorted(r["count"] for r in counts)):  # what small languages leave goes to the others
        share = left / (len(counts) - i)
        left -= min(n, share)
    rate = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["count"])) for r in counts], "learned string, rate double")
    thin = rows.select("key", "lang").join(F.broadcast(rate), F.col("lang") == F.col("learned")).where(F.pmod("key", F.lit(1 << 50)) < F.col("rate") * (1 << 50))
    keys = common.written(thin.select("key").distinct().orderBy("key").limit(most), "chosen")
    return rows.join(F.broadcast(keys), "key").select("lang", "key", "text").dropDuplicates(["key"])


def fit(docs: DataFrame) -> Model | None:
    """The model of ``docs`` (doc_id, text, lang, held_out); None where nothing can be learned."""
    drawn = common.written(sample(docs).mapInArrow(_grams_of, "lang string, key bigint, grams array<bigint>"), "grams")
    drawn = drawn.where(F.size("grams") > 0)
    top = drawn.select(F.explode("grams").alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(DICTIONARY)
    codes = np.sort(np.array([r["g"] for r in top.collect()], np.int64))
    if not len(codes):
        return None
    held = drawn.sparkSession.sparkContext.broadcast(codes)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.packbits(np.isin(held.value, x.values.to_numpy(), assume_unique=True)).tobytes() for x in b.column("grams")]
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "key": b.column("key"), "bits": pa.array(packed, pa.binary())})

    rows = sorted(drawn.mapInArrow(bits, "lang string, key bigint, bits binary").collect(), key=lambda r: (r["key"], r["lang"]))
    langs = sorted({r["lang"] for r in rows})
    x = np.array([np.frombuffer(r["bits"], np.uint8) for r in rows])
    y = np.array([langs.index(r["lang"]) for r in rows])
    return solve(x, y, langs, codes)


def solve(x: np.ndarray, y: np.ndarray, langs: list[str], codes: np.ndarray) -> Model:
    """One-versus-rest ridge regression on Nyström features. The penalty and the sharpness of scores are those
    that predict left-out sample rows best, which a ridge regression gives in closed form."""
    turn = np.zeros(len(y), np.int64)  # landmarks: languages take turns
    for k in range(len(langs)):
        turn[y == k] = np.arange((y == k).sum())
    chosen, seen = [], set()
    for i in np.lexsort((np.arange(len(y)), turn)):
        if x[i].tobytes() not in seen and len(chosen) < LANDMARKS:
            chosen.append(i), seen.add(x[i].tobytes())
    marks = _dense(x[chosen], len(codes))
    k = np.concatenate([_kernel(_dense(x[i : i + BATCH], len(codes)), marks) for i in range(0, len(x), BATCH)]).astype(np.float64)
    val, vec = np.linalg.eigh(k[chosen])
    root = vec[:, val > 1e-6] / np.sqrt(val[val > 1e-6])
    f = np.column_stack([k @ root, np.ones(len(y))])
    t = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(langs))[y]
    weight *= len(y) / weight.sum()
    best = None
    for lam in (1e-4, 1e-3, 1e-2, 1e-1):
        gram = np.linalg.inv((f * weight[:, None]).T @ f + lam * len(y) * np.diag(np.append(np.ones(f.shape[1] - 1), 1e-6)))
        w = gram @ (f * weight[:, None]).T @ t
        lever = np.minimum(np.einsum("ij,jk,ik->i", f, gram, f) * weight, 0.999)
        left = t - (t - f @ w) / (1 - lever)[:, None]
        for sharp in (1.0, 2.0, 4.0, 8.0, 16.0):
            p = _softmax(left, sharp)[np.arange(len(y)), y]
            loss = -(weight * np.log(np.maximum(p, 1e-9))).mean()
            if best is None or loss < best[0]:
                best = (loss, w, sharp)
    _, w, sharp = best
    return Model(langs, codes, x[chosen], (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32), sharp)


def _softmax(z: np.ndarray, sharp: float) -> np.ndarray:
    e = np.exp(sharp * (z - z.max(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to docs (text, ...), by the text alone; the other columns stay."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)}).drop("text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def batch(texts: list[str | None], m: Model, known: Dictionary, marks: np.ndarray) -> tuple[list[str], list[float]]:
        x, real = np.zeros((len(texts), len(known)), np.float32), np.zeros(len(texts), bool)
        for i, s in enumerate(texts):
            if s:
                x[i], real[i] = known.present(s)
        p = _softmax(_kernel(x, marks) @ m.weights + m.bias, m.sharp)
        at = p.argmax(1)
        return [m.langs[k] if ok else "und" for k, ok in zip(at, real)], [float(p[i, k]) if ok else 0.0 for i, (k, ok) in enumerate(zip(at, real))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known, marks = Dictionary(m.codes), _dense(m.marks, len(m.codes))
        for b in batches:
            names, scores, text = [], [], b.column("text")
            for i in range(0, b.num_rows, BATCH):
                n, s = batch(text.slice(i, BATCH).to_pylist(), m, known, marks)
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in rest] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f.name for f in rest] + ["lang_pred", "score"])

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = common.columns(docs, doc_id="bigint", text="string", lang="string")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    return score(docs.select("doc_id", "held_out", "text"), fit(docs))
