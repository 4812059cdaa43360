"""Quality classifier by co-training.

Two classifiers look at disjoint views of a page. The content view reads the text: kinds of
characters, repetition, how varied and how common its words are, lines, how well it compresses. The
metadata view never sees the text, only what stands beside it in the record: the columns ``TAGS``
and ``NUMBERS``. Each round, either classifier labels the unlabelled pages it is surest of, among all
there are, and the other learns from them. After the last round each view is calibrated on labelled
rows held out from it (Platt's sigmoid over out-of-fold scores), and the calibrated log odds add up,
less the prior counted twice.

Texts are read once: their features, some numbers a page, are written as a table, from which both
classifiers are fitted and all pages are scored. The models are fitted on the driver on at most
``LABELLED`` labelled rows (a documented bound; rows are chosen by a hash of their id). Unlabelled
pages are all scored in the cluster in every round, and only the ``GROWTH`` surest of them, as a
share of the labelled rows, come to the driver. Features are binned at the labelled rows' quantiles,
so that linear models can follow any shape.

Defined results: a null or empty text has zero features; a null tag is a value of its own, a null
number and a column that the table lacks, one too; without labels of both kinds every score is that
of a constant model; repeated rows get equal scores; a null doc_id stays null and is never labelled,
ties share their label; a very long text is read whole; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common, linear
from kgloom.llm.spotsigs import ANCHORS

LABELLED, ROUNDS, GROWTH, FOLDS = 6000, 4, 0.05, 4
BINS, SOURCES = 16, 64
#: Probability below which a classifier is not sure enough to label a page.
SURE = 0.9
#: Columns of a page's record beside its text.
TAGS, NUMBERS = ("lang", "source"), ("n_chars",)

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:'\"()-?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_UPPER | _LOWER | _DIGIT | _PUNCT)
_HIGH = np.arange(256) >= 128
CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _PUNCT, _SYMBOL, _HIGH]).astype(float)


def content(text: str) -> list[float]:
    """Make-up of a text: shares of its bytes and words, lines, compression."""
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    words = text.split()
    n, kinds, size, feeds = max(len(words), 1), set(words), max(len(raw), 1), text.count("\n")
    top = counts[33:].max() / size
    repeats = sum(map(eq, words, words[1:])) / n
    plain = sum(1 for w in kinds if w.isalpha()) / max(len(kinds), 1)
    common = sum(map(ANCHORS.__contains__, words)) / n
    shares = [*(CLASSES @ counts / size), top, len(kinds) / n, repeats, plain, common, sum(map(len, kinds)) / max(len(kinds), 1)]
    return [*shares, np.log1p(feeds), len(text) / (feeds + 1), counts[32] / size, len(zlib.compress(data, 1)) / (len(raw) + 12)]


def tag_of(column: str, value: str | None) -> str:
    """A feature's name: the value itself for a language, one of SOURCES buckets for other columns."""
    return f"{column} {value}" if column == "lang" or value is None else f"{column} {zlib.crc32(value.encode()) % SOURCES}"


class View:
    """Binned features of one view and a linear model over them."""

    def __init__(self, dense: np.ndarray, tagged: list[list[str]]):
        k = dense.shape[1] if dense.size else 0
        self.edges = [np.unique(np.quantile(dense[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])]).astype(int)
        names = sorted({t for ts in tagged for t in ts})
        self.tag = {t: int(self.start[-1]) + i for i, t in enumerate(names)}
        self.width = int(self.start[-1]) + len(names)
        self.w, self.b, self.scale = np.zeros(self.width), 0.0, (1.0, 0.0)

    def rows(self, dense: np.ndarray, tagged: list[list[str]]) -> linear.Rows:
        binned = [self.start[j] + np.searchsorted(e, dense[:, j], "right") for j, e in enumerate(self.edges)]
        got = np.stack(binned, axis=1).tolist() if binned else [[] for _ in tagged]
        return linear.Rows([{**dict.fromkeys(g, 1.0), **{self.tag[t]: 1.0 for t in ts if t in self.tag}} for g, ts in zip(got, tagged)], self.width)

    def margin(self, x: linear.Rows) -> np.ndarray:
        return x.dot(self.w) + self.b

    def margins(self, dense: np.ndarray, tagged: list[list[str]]) -> np.ndarray:
        """The margin of every row, looked up a feature at a time."""
        out = np.full(len(tagged), self.b)
        for j, e in enumerate(self.edges):
            out += self.w[self.start[j] + np.searchsorted(e, dense[:, j], "right")]
        if self.tag:
            weight = {t: self.w[i] for t, i in self.tag.items()}
            out += [sum([weight.get(t, 0.0) for t in ts]) for ts in tagged]
        return out

    def odds(self, margins: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        return margins * self.scale[0] + self.scale[1]


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    w, b = linear.fit(linear.Rows([{0: float(m)} for m in margin], 1), y, l1=0.0, l2=1e-3, rounds=200)
    return float(max(w[0], 0.0)), b


Features = tuple[np.ndarray, list[list[str]]]  # dense values, tags


class CoTrained:
    def __init__(self, views: list[View], prior: float):
        self.views, self.prior = views, prior

    def score(self, views: list[Features]) -> np.ndarray:
        """(content, metadata, both): probabilities of good quality."""
        odds = [v.odds(v.margins(*x)) for v, x in zip(self.views, views)]
        return linear.sigmoid(np.stack([*odds, odds[0] + odds[1] - self.prior]))


def cotrain(ids: np.ndarray, labelled: list[Features], y: np.ndarray, surest) -> CoTrained:
    """labelled: per view the labelled rows' features. ``surest(views, most)`` gives, for a round, the
    unlabelled rows that views are surest of and that were not given before: (view, label, features
    of both views), at most most[label] a view and label."""
    views = [View(*x) for x in labelled]
    own = [v.rows(*x) for v, x in zip(views, labelled)]
    n, good = len(y), float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    given: list[list[tuple[linear.Rows, float]]] = [[], []]  # pseudo-labels each view has received

    def learn(k: int, keep: np.ndarray) -> tuple[np.ndarray, float]:
        """Model of view k on the labelled rows to keep and all pseudo-labels given to it."""
        parts = [own[k].take(keep), *[x for x, _ in given[k]]]
        label = np.concatenate([y[keep], *[np.full(x.n, p) for x, p in given[k]]])
        x, first = linear.Rows(width=views[k].width), np.cumsum([0, *[p.n for p in parts]])
        x.n = int(first[-1])
        x.row = np.concatenate([p.row + at for p, at in zip(parts, first)])
        x.col, x.val = (np.concatenate([getattr(p, c) for p in parts]) for c in ("col", "val"))
        return linear.fit(x, label, l1=3e-4)

    most = {1: int(np.ceil(GROWTH * n * good)), 0: int(np.ceil(GROWTH * n * (1 - good)))}
    for _ in range(ROUNDS if 0 < y.sum() < n else 0):
        for k, v in enumerate(views):
            v.w, v.b = learn(k, np.arange(n))
        got = surest(views, most)
        for k, label, both in got:
            given[1 - k].append((views[1 - k].rows(*both[1 - k]), float(label)))
        if not got:
            break
    fold = linear.folds(ids, FOLDS)
    for k, v in enumerate(views):
        v.w, v.b = learn(k, np.arange(n))
        margin = np.zeros(n)
        for f in range(FOLDS):
            held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            w, b = learn(k, rest)
            margin[held] = own[k].take(held).dot(w) + b
        v.scale = _platt(margin, y)
    return CoTrained(views, float(np.log(good / (1 - good))))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tags: tuple = TAGS, numbers: tuple = NUMBERS) -> DataFrame:
    """A row per document: doc_id, content (numbers read off the text), numbers and tags (of its record)."""

    def run(batches):
        for b in batches:
            values = [content(t.as_py() or "") for t in b.column(1)]
            beside = zip(*[b.column(i).to_pylist() for i in range(2, 2 + len(numbers))]) if numbers else [()] * len(values)
            named = zip(*[[tag_of(c, v) for v in b.column(2 + len(numbers) + i).to_pylist()] for i, c in enumerate(tags)]) if tags else [()] * len(values)
            cols = [values, [[-1.0 if v is None else v for v in x] for x in beside], list(map(list, named))]
            kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "content", "numbers", "tags"])

    cols = {id_col: ("bigint", "doc_id"), text_col: ("string", "text")}
    held = lambda c, kind: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kind)
    read = docs.select(
        *[F.col(f"`{c}`").cast(k).alias(a) for c, (k, a) in cols.items()],
        *[held(c, "double").alias(f"n{i}") for i, c in enumerate(numbers)], *[held(c, "string").alias(f"t{i}") for i, c in enumerate(tags)],
    )
    return read.mapInArrow(run, "doc_id bigint, content array<double>, numbers array<double>, tags array<string>")


def _matrix(values, n: int) -> np.ndarray:
    got = np.array(list(values), float)
    return got.reshape(n, -1) if n else np.zeros((0, 0))


def _views(got: pd.DataFrame) -> list[Features]:
    n = len(got)
    return [(_matrix(got["content"], n), [[]] * n), (_matrix(got["numbers"], n), [list(t) for t in got["tags"]])]


def fit(table: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained:
    """``table`` is what ``features`` gives, written; ``labels`` has doc_id and quality."""
    got = linear.labelled(table, labels, ["quality"], labelled).toPandas()
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")  # of ties one is taught
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    free = common.written(table.join(known, "doc_id", "left_anti").withColumn("rid", F.monotonically_increasing_id()).withColumn("tie", F.xxhash64("doc_id", "content", "numbers", "tags")), "unlabelled")
    used: list[int] = []

    def surest(views: list[View], most: dict[int, int]) -> list[tuple]:
        taken = set(used)

        def run(batches):
            for b in batches:
                rid = b.column(3).to_numpy()
                rows = _views(pd.DataFrame({"content": b.column(0).to_pylist(), "numbers": b.column(1).to_pylist(), "tags": b.column(2).to_pylist()}))
                for k, v in enumerate(views):
                    p = linear.sigmoid(v.margins(*rows[k]))
                    for label, sure in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(sure >= SURE)
                        at = np.array([i for i in at if rid[i] not in taken], int)
                        at = at[np.argsort(-sure[at], kind="stable")]
                        at = at[sure[at] >= sure[at[min(most[label], len(at)) - 1]]] if len(at) else at  # with all ties of the last
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(sure[at]), pa.array(rid[at]), b.column(4).take(pa.array(at))], ["view", "label", "sure", "rid", "tie"])

        seen = free.select("content", "numbers", "tags", "rid", "tie").mapInArrow(run, "view int, label int, sure double, rid bigint, tie bigint")
        seen = common.written(seen, "surest")
        best = [seen.where((F.col("view") == k) & (F.col("label") == x)).orderBy(F.desc("sure"), "tie", "rid").limit(most[x]).drop("tie") for k in (0, 1) for x in (1, 0)]
        chosen = best[0].unionByName(best[1]).unionByName(best[2]).unionByName(best[3])
        rows = free.join(F.broadcast(chosen), "rid").toPandas().sort_values(["view", "label", "tie"], kind="stable")  # twice two bounded lists
        used.extend(int(r) for r in rows["rid"])
        return [(int(k), int(x), _views(part)) for (k, x), part in rows.groupby(["view", "label"], sort=True)]

    return cotrain(got["doc_id"].to_numpy(np.int64), _views(got), (got["label_quality"].to_numpy() > 0).astype(float), surest)


def score(table: DataFrame, model: CoTrained) -> DataFrame:
    """One row per row of ``features``: doc_id, content_quality, metadata_quality, quality, keep."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = model.score(_views(pd.DataFrame({"content": b.column(1).to_pylist(), "numbers": b.column(2).to_pylist(), "tags": b.column(3).to_pylist()})))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p), pa.array(p[2] >= 0.5)], ["doc_id", "content_quality", "metadata_quality", "quality", "keep"])

    return table.select("doc_id", "content", "numbers", "tags").mapInArrow(run, "doc_id bigint, content_quality double, metadata_quality double, quality double, keep boolean")
