"""A classifier with one hidden layer, trained on sparse rows.

Spark's own trainer keeps every row as a dense vector, 32 KB for 4,096 columns. Here a row costs its non-zero entries: rows are
packed into blocks, tasks sum the gradient of their blocks, and the driver holds weights only. The result is Spark's model.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise, settle

#: Rows of a block; what a task holds at a time is a block's entries times the hidden units.
_ROWS = 2048
_BLOCK = "n int, labels binary, sizes binary, places binary, entries binary"


def _pack(batches):
    """One row per block: labels, numbers of entries, their columns and values."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            b = batch.slice(at, _ROWS)
            v = b.column("features")
            places, entries, dense = v.field("indices"), v.field("values"), v.field("type").to_numpy(zero_copy_only=False) == 1
            if dense.any():
                raise ValueError("features are to be sparse")
            sizes = np.diff(places.offsets.to_numpy()).astype(np.int32)
            held = [b.column("label").to_numpy(zero_copy_only=False).astype(np.int32), sizes,
                    places.flatten().to_numpy(zero_copy_only=False).astype(np.int32), entries.flatten().to_numpy(zero_copy_only=False).astype(np.float64)]
            columns = [pa.array([len(b)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in held]]
            yield pa.RecordBatch.from_arrays(columns, ["n", "labels", "sizes", "places", "entries"])


def _layers(weights: np.ndarray, width: int, hidden: int, classes: int) -> list[np.ndarray]:
    """Views of the weights in Spark's order: per layer a row of outputs for each input, then the biases."""
    first, second = width * hidden, hidden * classes
    cut = np.split(weights, np.cumsum([first, hidden, second]))
    return [cut[0].reshape(width, hidden), cut[1], cut[2].reshape(hidden, classes), cut[3]]


#: Entries whose table rows are gathered at once: few enough to stay in the processor's cache.
_GATHERED = 512


def _run_sums(table: np.ndarray, places: np.ndarray, entries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of consecutive entries, the sum of the table's rows at their places times the entries.

    Runs of equal length are summed together; ``reduceat`` over rows takes several times as long.
    """
    out, starts = np.zeros((len(sizes), table.shape[1])), np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    lengths, at = np.unique(sizes[order], return_index=True)
    for length, runs in zip(lengths, np.split(order, at[1:])):
        step = max(1, _GATHERED // length) if length else len(runs)
        for i in range(0, len(runs) if length else 0, step):
            some = runs[i:i + step]
            held = starts[some][:, None] + np.arange(length)
            out[some] = np.einsum("rk,rkh->rh", entries[held], table.take(places[held], axis=0, mode="clip"))
    return out


def _forward(places: np.ndarray, entries: np.ndarray, sizes: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the hidden units, and of the outputs before the softmax."""
    h = _run_sums(weights[0], places, entries, sizes)
    h += weights[1]
    np.clip(h, -500, 500, out=h)
    np.exp(np.negative(h, out=h), out=h)
    h += 1
    np.reciprocal(h, out=h)
    return h, h @ weights[2] + weights[3]


def _add_block(row, weights: list[np.ndarray], grads: list[np.ndarray]) -> float:
    """Adds the gradient of one block and returns its loss."""
    labels, sizes, places = (np.frombuffer(row[c], np.int32) for c in ("labels", "sizes", "places"))
    entries = np.frombuffer(row["entries"], np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h, out = _forward(places, entries, sizes, weights)
    out -= out.max(axis=1, keepdims=True)
    log_p = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    mine = np.arange(len(labels)), labels
    loss, d = -log_p[mine].sum(), np.exp(log_p)
    d[mine] -= 1
    grads[2] += h.T @ d
    grads[3] += d.sum(axis=0)
    d = d @ weights[2].T
    d *= h
    d *= np.subtract(1, h, out=h)
    grads[1] += d.sum(axis=0)
    width = len(weights[0])
    order = np.argsort(places.astype(np.uint16) if width <= 1 << 16 else places, kind="stable")
    counts = np.bincount(places, minlength=width)
    column = np.flatnonzero(counts)
    grads[0][column] += _run_sums(d, owner[order], entries[order], counts[column])
    return float(loss)


def _minimise(loss_and_gradient, weights: np.ndarray, iterations: int, kept: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with a halving line search."""
    loss, grad = loss_and_gradient(weights)
    pairs: deque = deque(maxlen=kept)
    for _ in range(iterations):
        way, used = -grad, []
        for s, y in reversed(pairs):
            used.append(s @ way / (s @ y))
            way = way - used[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), a in zip(pairs, reversed(used)):
            way = way + (a - y @ way / (s @ y)) * s
        slope, step = grad @ way, 1.0 if pairs else 1 / max(np.linalg.norm(grad), 1e-12)
        if slope >= 0:
            break
        for _ in range(20):
            new_loss, new_grad = loss_and_gradient(weights + step * way)
            if new_loss <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * way, new_grad - grad
        if s @ y > 1e-12:
            pairs.append((s, y))
        done = abs(loss - new_loss) <= tolerance * max(abs(loss), abs(new_loss), 1e-12)
        weights, loss, grad = weights + s, new_loss, new_grad
        if done:
            break
    return weights


def _entries(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of entries per row, their columns and values; a dense row has an entry for every column."""
    kind, places, entries = (pc.struct_field(v, c) for c in ("type", "indices", "values"))
    sizes = pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = pc.fill_null(pc.equal(kind, 0), False).to_numpy(zero_copy_only=False)
    out[np.repeat(sparse, sizes)] = places.filter(pa.array(sparse)).flatten().to_numpy(zero_copy_only=False)
    return sizes, out, entries.flatten().to_numpy(zero_copy_only=False)


_SCORES = "struct<raw:array<double>,probability:array<double>,prediction:double>"


class SparseNetwork(MultilayerPerceptronClassificationModel):
    """Spark's model, but a row is scored from its non-zero entries; Spark multiplies a dense vector for each row."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = {"raw": self.getRawPredictionCol(), "probability": self.getProbabilityCol(), "prediction": self.getPredictionCol()}
        if self.isDefined(self.thresholds) or not all(names.values()):
            return super()._transform(dataset)
        width, hidden, classes = self.getLayers()
        sent = dataset.sparkSession.sparkContext.broadcast(self.weights.toArray())

        def score(v: pa.Array) -> pa.Array:
            sizes, places, entries = _entries(v)
            weights, raw = _layers(sent.value, width, hidden, classes), np.zeros((len(sizes), classes))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, len(sizes), _ROWS):
                to = min(at + _ROWS, len(sizes))
                cut = slice(ends[at], ends[to])
                raw[at:to] = _forward(places[cut], entries[cut], sizes[at:to], weights)[1]
            high = np.exp(raw - raw.max(axis=1, keepdims=True))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), classes).cast(pa.list_(pa.float64())) for x in (raw, high / high.sum(axis=1, keepdims=True))]
            return pa.StructArray.from_arrays([*lists, pa.array(raw.argmax(axis=1).astype(np.float64))], list(names), mask=v.is_null())

        scored = settle(dataset.withColumn("_scores", F.arrow_udf(score, _SCORES)(F.col(self.getFeaturesCol()))), "_scores")
        columns = {names[c]: array_to_vector(F.col(f"_scores.{c}")) for c in ("raw", "probability")} | {names["prediction"]: F.col("_scores.prediction")}
        return scored.withColumns(columns).drop("_scores")


def fit_hidden(ready: DataFrame, width: int, hidden: int, classes: int, seed: int, iterations: int) -> MultilayerPerceptronClassificationModel:
    """A network of ``width`` inputs, ``hidden`` sigmoid units and a softmax for rows of sparse ``features`` and ``label``.

    It starts from the weights that Spark draws for the seed. A step reads the packed blocks once; gradients are summed in a tree.
    """
    layers, one = [width, hidden, classes], ready.limit(1)
    drawn = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=0).fit(one).weights.toArray()
    blocks = materialise(ready.select("label", "features").mapInArrow(_pack, _BLOCK), "blocks")
    rows = blocks.agg({"n": "sum"}).first()[0]
    context, stored = ready.sparkSession.sparkContext, blocks.drop("n").rdd

    def loss_and_gradient(weights):
        sent = context.broadcast(weights)

        def part(held):
            views = _layers(sent.value, *layers)
            total = np.zeros(len(sent.value))
            grads, loss = _layers(total, *layers), 0.0
            for row in held:
                loss += _add_block(row, views, grads)
            yield loss, total

        loss, grad = stored.mapPartitions(part).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        sent.destroy()
        return loss / rows, grad / rows

    weights = _minimise(loss_and_gradient, drawn, iterations)
    model = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=0, initialWeights=Vectors.dense(weights)).fit(one)
    # a copy of its own: a model that is collected takes its Java object along
    return model._copyValues(SparseNetwork(model._java_obj.copy(model._empty_java_param_map())))
