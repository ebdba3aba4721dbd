"""Quality scores by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a quantile as threshold.

A good and a bad document form a preference; the model is one weight per feature, fitted so that the score difference of a
pair predicts which of the two is the good one. The threshold is the quantile of the training scores that separates the
labels best. Features are counts over the whole text: shares of byte classes, word lengths, repetition, line shape.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import blocks, words

#: Labelled rows of each class that the fit uses at most (those with the smallest hash of doc_id).
TRAIN_ROWS = 6000
PAIRS = 60000
#: Score at the threshold.
CUT = 0.3

# byte classes: each ASCII punctuation mark its own, then upper, lower, digit, blank, line end, control, non-ASCII
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.full(256, len(_MARKS) + 5, dtype=np.int64)
_CLASS[_MARKS] = np.arange(len(_MARKS))
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = len(_MARKS), len(_MARKS) + 1, len(_MARKS) + 2
_CLASS[32], _CLASS[10], _CLASS[128:] = len(_MARKS) + 3, len(_MARKS) + 4, len(_MARKS) + 6
_CLASSES = len(_MARKS) + 7
_SHAPE = 8
WIDTH = _CLASSES + _SHAPE


def features(column: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` features per text; a text without words has the shape features 0."""
    out = np.zeros((len(column), WIDTH))
    for run in words.runs(column, lower=False):
        rows = run.hi - run.lo
        size = np.maximum(np.diff(run.offsets), 1)
        byte_row = np.repeat(np.arange(rows) * _CLASSES, np.diff(run.offsets))
        share = np.bincount(byte_row + _CLASS[run.data], minlength=rows * _CLASSES).reshape(rows, _CLASSES) / size[:, None]
        row, n = run.row, np.maximum(np.diff(run.first), 1)
        total = lambda x: np.bincount(row, weights=x, minlength=rows)
        length = (run.ends - run.starts).astype(np.float64)
        last = run.data[run.ends - 1]
        again = np.zeros(len(row))
        again[1:] = (run.hashes[1:] == run.hashes[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((run.hashes, row))
        new = np.ones(len(row))
        new[1:] = (run.hashes[order][1:] != run.hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order], weights=new, minlength=rows)
        mean = total(length) / n
        shape = [np.log1p(np.diff(run.first)) / 10, mean / 10, np.sqrt(np.maximum(total(length**2) / n - mean**2, 0)) / 10, distinct / n,
                 total(again) / n, total(~words.ALNUM[words.LOWER[last]]) / n, total(length == 1) / n, distinct / np.sqrt(n) / 10]
        out[run.lo : run.hi] = np.column_stack([np.sqrt(share), *shape])
    return out


class Ranker(NamedTuple):
    """score = sigmoid((features - centre) / spread . weights - threshold + logit(CUT))"""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -20, 20) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, decay: float = 1e-3, steps: int = 30) -> Ranker:
    """Newton steps on the pairwise logistic loss; without both labels every score is 0.5."""
    width = x.shape[1]
    if not good.any() or good.all():
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(CUT / (1 - CUT))))
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / spread, -20, 20)
    rng = np.random.default_rng(7)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    diff = z[rng.choice(winners, pairs)] - z[rng.choice(losers, pairs)]
    w = np.zeros(width)
    loss = lambda w: np.logaddexp(0, -diff @ w).mean() + decay / 2 * w @ w
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + decay * np.eye(width), diff.T @ p / pairs - decay * w)
        rate = 1.0
        while rate > 1e-4 and loss(w + rate * step) > now:
            rate /= 2
        new = loss(w + rate * step)
        if now - new < 1e-9:
            break
        w, now = w + rate * step, new
    s = z @ w
    cuts = np.quantile(s, np.linspace(0.001, 0.999, 999))
    balanced = np.array([(s[winners] >= c).mean() + (s[losers] < c).mean() for c in cuts])
    best = np.flatnonzero(balanced == balanced.max())
    return Ranker(centre, spread, w, float((cuts[best[0]] + cuts[best[-1]]) / 2))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ranker:
    """Fits on labelled rows that are not held out, at most ``rows`` of each class."""
    seen = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = [seen.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # 2 x rows at most

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b["quality"], pa.array(list(features(b["text"])), pa.list_(pa.float64()))], ["quality", "x"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id").select("quality", "text")
    blocks.bound_batches(docs.sparkSession)
    found = chosen.mapInArrow(batches, "quality int, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist()).reshape(-1, WIDTH)
    good = found["quality"].to_numpy() == 1
    order = np.lexsort([*x.T[::-1], good])  # the same fit in whatever order rows arrive
    return fit(x[order], good[order])


def scored(docs: DataFrame, model: Ranker) -> DataFrame:
    """(row, score): every row as a struct of its columns, and its score between 0 and 1."""
    blocks.bound_batches(docs.sparkSession)
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def batches(it):
        for b in it:
            scores = model.score(features(b["row"].field("text").cast(pa.string())))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(scores, pa.float64())], ["row", "score"])

    return out.mapInArrow(batches, f"row {out.schema['row'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score ``CUT`` or more, unchanged.

    Null texts are scored as empty ones; repeated rows get the same score; other columns pass through. An empty table
    gives no rows. Without labels of both classes every row is kept.
    """
    return scored(docs, train(docs, labels)).where(F.col("score") >= CUT).select("row.*")
