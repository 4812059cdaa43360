"""Toxicity by a classifier chain.

Categories are predicted one after another by sparse linear models over the distinct words of a
text and their stems. Every later model sees, beside the words, the probabilities of all earlier categories. In
training these are out-of-fold predictions, so that a later model meets earlier probabilities of
the quality it will meet when documents are scored. The last link of the chain is ``toxic``, the
label itself. The earlier ones are kinds of abuse, and no word list names them: the labelled toxic
texts are clustered by the words that tell toxic texts from others, and a text belongs to the kind
of its cluster. Kinds differ in vocabulary, for instance by language, so a link learns one way of
being toxic and hands on how sure it is.

The models are fitted on the driver on at most ``LABELLED`` labelled rows (a documented bound,
chosen by a hash of the id). Features are all words and stems whose presence depends on the label
beyond chance (``LEAST`` of the log-likelihood ratio, and ``ROWS`` rows), without a cap on their
number, which the sample bounds. All documents are scored, whole texts, in one pass without a
shuffle. The threshold is the one with the fewest errors among out-of-fold predictions, in the middle of their range.

Defined results: a null or empty text has no words and gets the chain's base rates; without
labels of both kinds every probability is that of a constant model; repeated rows get equal
results, as do ties of doc_id with equal texts; a very long text counts each of its words once; a
null doc_id stays null and is never labelled; an empty table gives no rows; columns other than id
and text are not read by ``score`` and travel along in ``clean``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common, linear

LABELLED, FOLDS, KINDS = 6000, 4, 3
#: Log-likelihood ratio of a feature at least (chance gives as much once in 10,000), and rows that have it.
LEAST, ROWS = 15.0, 4
#: Sparse penalty of a link, and steps of its training.
PENALTY, STEPS = 1e-4, 600
#: Lengths of word beginnings that are features, so that an inflected word is known by its stem.
STEMS = (3, 4, 5, 6)
CHAIN = (*[f"kind_{i + 1}" for i in range(KINDS)], "toxic")
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_~`^+=@“”‘’«»¿¡…"


def words_of(text: str | None) -> set[str]:
    """Distinct words in lower case without punctuation at their ends, and their beginnings of three to
    six letters, marked with an asterisk."""
    words = {w.strip(_EDGES) for w in set((text or "").lower().split())}
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}


class Chain:
    """words: word -> feature; weights: per link (word weights, weights of earlier links, intercept)."""

    def __init__(self, words: dict[str, int], weights: list[tuple[np.ndarray, np.ndarray, float]], threshold: float):
        self.words, self.weights, self.threshold = words, weights, threshold
        self.table = np.stack([w for w, _, _ in weights], axis=1) if words else np.zeros((0, len(weights)))
        used = [i for i in range(len(self.table)) if self.table[i].any()]
        row = {i: self.table[i] for i in used}
        self.rows = {w: row[i] for w, i in words.items() if i in row}
        self.vocabulary = frozenset(self.rows)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row a text and a column a link."""
        z = np.zeros((len(texts), len(self.weights)))
        for i, t in enumerate(texts):
            for w in sorted(self.vocabulary & words_of(t)):  # in order: sums of floats shouldn't depend on it
                z[i] += self.rows[w]
        out = np.zeros_like(z)
        for k, (_, earlier, b) in enumerate(self.weights):
            out[:, k] = linear.sigmoid(z[:, k] + out[:, :k] @ earlier + b)
        return out


def select_features(words: DataFrame, least: float = LEAST, rows: int = ROWS) -> list[str]:
    """The words whose presence depends on the label, by the log-likelihood ratio of the two.

    ``words`` is (id, toxic, word), distinct. Counting is distributed; only the chosen words come
    to the driver."""
    n, p = words.select("id", "toxic").distinct().agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).collect()[0]
    if not n:
        return []
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).where(f"n >= {int(rows)} AND word <> ''")

    def cell(seen: F.Column, margin: F.Column, total: int) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen * n / (margin * total))).otherwise(0.0) if total else F.lit(0.0)

    with_, without = F.col("n"), n - F.col("n")
    ratio = 2 * (cell(F.col("p"), with_, p) + cell(with_ - F.col("p"), with_, n - p) + cell(p - F.col("p"), without, p) + cell(without - p + F.col("p"), without, n - p))
    return sorted(r.word for r in counts.where(ratio >= least).select("word").collect())


def kinds_of(x: linear.Rows, toxic: np.ndarray, kinds: int = KINDS, rounds: int = 25) -> np.ndarray:
    """The cluster of each toxic row, by k-means on unit vectors of the features that speak for toxicity;
    -1 for other rows. The first centre is the row nearest to the mean, each further one the row least
    like those before, so the result is the same on every run."""
    out = np.full(x.n, -1)
    at = np.flatnonzero(toxic)
    if not len(at) or not x.width:
        return out
    share = np.bincount(x.col, toxic[x.row], x.width) / np.maximum(np.bincount(x.col, minlength=x.width), 1)
    own = x.take(at)
    hit = share[own.col] > toxic.mean()
    v = np.zeros((len(at), x.width), np.float32)
    v[own.row[hit], own.col[hit]] = own.val[hit]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    centres = [v[np.argmax(v @ v.mean(axis=0))]]
    while len(centres) < kinds:
        centres.append(v[np.argmin(np.max(v @ np.array(centres).T, axis=1))])
    c, label = np.array(centres), np.zeros(len(at), int)
    for _ in range(rounds):
        label = np.argmax(v @ c.T, axis=1)
        new = np.array([v[label == k].sum(axis=0) if (label == k).any() else c[k] for k in range(kinds)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c):
            break
        c = new
    out[at] = label
    return out


def threshold_of(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of fewest errors: in log odds, the middle of the longest range of such thresholds."""
    if not len(y):
        return 0.5
    grid = np.linspace(-6, 6, 241)
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    errors = np.array([((z >= t) != y).sum() for t in grid])
    runs = np.split(best := np.flatnonzero(errors == errors.min()), np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    return float(linear.sigmoid(grid[[run[0], run[-1]]].mean()))


def train(ids: np.ndarray, sets: list[set[str]], toxic: np.ndarray, names: list[str], k: int = FOLDS) -> Chain:
    """The chain over the features ``names``; ``sets`` are those that each row has."""
    words = {w: i for i, w in enumerate(names)}
    x = linear.Rows([{words[w]: 1.0 for w in s if w in words} for s in sets], len(words))
    fold = linear.folds(ids, k)
    seen = np.zeros((len(ids), 0))  # out-of-fold probabilities of the links so far
    kind, weights = kinds_of(x, toxic.astype(float)), []
    for i in range(len(CHAIN)):
        y = (kind == i if i < KINDS else toxic).astype(float)
        full = x.with_columns(seen)
        w, b = linear.fit(full, y, PENALTY, rounds=STEPS)
        weights.append((w[: len(words)], w[len(words) :], b))
        out = np.zeros(len(ids))
        for f in range(k):
            held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            wf, bf = linear.fit(full.take(rest), y[rest], PENALTY, rounds=STEPS)
            out[held] = linear.sigmoid(full.take(held).dot(wf) + bf)
        seen = np.column_stack([seen, out])
    return Chain(words, weights, threshold_of(seen[:, -1], toxic))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    def run(batches):
        for b in batches:
            words = [sorted(words_of(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], ["id", "toxic", "words"])

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = linear.labelled(read, labels, ["toxic"], most).select("label_id", (F.col("label_toxic") > 0).cast("int").alias("toxic"), "text")
    rows = common.written(rows.mapInArrow(run, "id bigint, toxic int, words array<string>"), "labelled")
    names = select_features(rows.select("id", "toxic", F.explode("words").alias("word")))
    # rows come to the driver with the chosen features alone: the labelled bound times a short list
    listed = common.driver_table(docs.sparkSession, [(names,)], "names array<string>")
    chosen = rows.crossJoin(listed).select("id", "toxic", F.array_intersect("words", "names").alias("words"))  # one row beside each
    got = chosen.toPandas().sort_values("id", kind="stable")
    return train(got["id"].to_numpy(np.int64), [set(w) for w in got["words"]], got["toxic"].to_numpy() > 0, names)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, a probability per link, toxic (is_toxic)."""

    def run(batches):
        for b in batches:
            p = chain.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, i]) for i in range(len(CHAIN))], pa.array(p[:, -1] >= chain.threshold)], ["doc_id", *[f"p_{c}" for c in CHAIN], "is_toxic"])

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id bigint, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", is_toxic boolean")


def clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(chain.predict(texts.tolist())[:, -1] >= chain.threshold)

    return docs.where(~toxic(F.col(f"`{text_col}`").cast("string")))
