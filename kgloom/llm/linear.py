"""Sparse linear models trained on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rows:
    """Rows of sparse features in compressed form."""

    def __init__(self, rows: list[dict[int, float]] | None = None, width: int = 0):
        rows = rows or []
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        self.col = np.array([k for r in rows for k in r], np.int64)
        self.val = np.array([v for r in rows for v in r.values()], np.float64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)

    def take(self, keep: np.ndarray) -> "Rows":
        out, new = Rows(width=self.width), np.full(self.n, -1)
        new[keep] = np.arange(len(keep))
        hit = new[self.row] >= 0
        out.n, out.row, out.col, out.val = len(keep), new[self.row[hit]], self.col[hit], self.val[hit]
        return out

    def with_columns(self, dense: np.ndarray) -> "Rows":
        """The rows with dense columns after the last one."""
        out, k = Rows(width=self.width + dense.shape[1]), dense.shape[1]
        out.n = self.n
        out.row = np.concatenate([self.row, np.repeat(np.arange(self.n), k)])
        out.col = np.concatenate([self.col, self.width + np.tile(np.arange(k), self.n)])
        out.val = np.concatenate([self.val, dense.ravel()])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _slope(x: Rows, weight: np.ndarray) -> float:
    """The largest curvature of the loss, by power iteration."""
    u, n = np.ones(x.width + 1), max(x.n, 1)
    for _ in range(20):
        z = (x.dot(u[:-1]) + u[-1]) * weight / (4 * n)
        new = np.append(x.tdot(z), z.sum())
        size = np.linalg.norm(new)
        if size == 0:
            return 1.0
        u = new / size
    return float(size)


def fit(x: Rows, y: np.ndarray, l1: float = 1e-3, l2: float = 1e-4, rounds: int = 300, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression with an elastic net, by accelerated proximal gradient steps. The sparse
    penalty gives the weight to the few features that explain the label."""
    n = max(x.n, 1)
    weight = np.ones(x.n) if weight is None else weight
    if not x.n or y.min() == y.max():
        return np.zeros(x.width), -8.0 if not x.n or y.max() == 0 else 8.0
    slope = _slope(x, weight) * 1.05
    w, b, t = np.zeros(x.width), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    v, vb, step = w, b, 1 / slope
    for _ in range(rounds):
        g = (sigmoid(x.dot(v) + vb) - y) * weight / n
        new = v - step * (x.tdot(g) + l2 * v)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * g.sum()
        if (v - new) @ (new - w) + (vb - nb) * (nb - b) > 0:  # overshot: drop the momentum
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, float(b)


def folds(keys: np.ndarray, k: int) -> np.ndarray:
    """Fold of each row by a hash of its key, so that reruns agree."""
    h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (h % np.uint64(k)).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label_cols: list[str], most: int) -> DataFrame:
    """The documents of at most ``most`` labels, chosen by a hash of their id. Labels are cut to
    the bound before they meet the documents, so only the chosen texts move. A label column gets
    the prefix label_; an id that is labelled twice keeps one of its labels."""
    keys = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), *[F.col(c).cast("int").alias(f"label_{c}") for c in label_cols])
    keys = keys.dropna().groupBy("label_id").agg(*[F.max(f"label_{c}").alias(f"label_{c}") for c in label_cols]).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    return docs.join(F.broadcast(keys), F.col("doc_id") == F.col("label_id"))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y.sum()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(pos * (len(y) - pos), 1))
