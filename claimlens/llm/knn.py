"""Exact top-k by inner product as a Voronoi join: rows are grouped by their nearest pivot, a query visits only groups that can hold a result.

For a row x of the group of pivot p with radius r, ``q.x <= q.p + |q| r``. The pivots are rows themselves, so the k-th best
of a query's products with them is a floor under its k-th best result; groups below that floor are skipped. Queries
travel to groups, rows of the table never travel twice; a large group is split into slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.cluster import materialise

SCALE = 1024
PIVOTS = 64
SLICE_ROWS = 8192


def scaled(batch_vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices of vectors with finite components only, and their components times ``scale``, rounded down."""
    keep, out = [], []
    values = batch_vectors.flatten()
    gaps = np.cumsum(np.concatenate([[0], values.is_null().to_numpy(zero_copy_only=False)]))
    flat = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    lengths = batch_vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for i in np.flatnonzero(np.asarray(batch_vectors.is_valid())):
        a, b = ends[i] - lengths[i], ends[i]
        if gaps[b] == gaps[a] and np.isfinite(flat[a:b]).all():
            keep.append(i)
            out.append(np.clip(np.floor(flat[a:b] * scale), -(2.0**62), 2.0**62).astype(np.int64))
    return np.array(keep, dtype=np.int64), out


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : min(width, len(r))] = r[:width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; through float64 where no sum can leave its exact range."""
    most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def integers(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors as integers; rows without an id, and vectors null or with null or non-finite components, are left out."""

    def batches(it):
        for b in it:
            keep, rows = scaled(b["embedding"], scale)
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(keep)), pa.array(rows, pa.list_(pa.int64()))], ["vec_id", "v"])

    source = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id is not null")
    return source.mapInArrow(batches, "vec_id long, v array<long>")


def _assign(table: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it (rounded up)."""

    def batches(it):
        p = pivots.astype(np.float64)
        norms = (p * p).sum(1)
        for pdf in it:
            x = matrix(pdf["v"], p.shape[1]).astype(np.float64)
            square = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + norms, 0)
            cell = square.argmin(1) if len(x) else np.empty(0, dtype=np.int64)
            reach = np.sqrt(((x - p[cell]) ** 2).sum(1)) * (1 + 1e-9) + 1e-3 if len(x) else np.empty(0)
            yield pdf.assign(cell=cell.astype(np.int32), reach=reach)

    return table.mapInPandas(batches, "vec_id long, v array<long>, cell int, reach double")


def top_k(queries: DataFrame, table: DataFrame, k: int = 10, pivots: int = PIVOTS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The k highest inner products of every query with rows of another id: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    Both tables are (vec_id, v) as ``integers`` makes them. Shorter vectors count as padded with zeros. Repeated rows of the
    table are results each; repeated query ids are answered once. Without rows there are no results.
    """
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    centre = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # at most ``pivots`` rows
    width = table.agg(F.max(F.size("v"))).first()[0]
    if not centre or not width:
        return spark.createDataFrame([], out)
    ids, points = np.array([r["vec_id"] for r in centre]), matrix([r["v"] for r in centre], width)
    cells = materialise(_assign(table, points), "cells")
    stats = {r["cell"]: (r["n"], r["reach"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()}  # a row per pivot
    slices = np.array([-(-stats.get(i, (0, 0))[0] // slice_rows) for i in range(len(ids))])
    reach = np.array([stats.get(i, (0, 0.0))[1] for i in range(len(ids))])

    def visits(it):
        """Each query's groups whose bound reaches its floor, one row per slice."""
        for pdf in it:
            q = matrix(pdf["v"], width)
            near = products(q, points).astype(np.float64)
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
            own = pdf["vec_id"].to_numpy()[:, None] == ids
            others = np.sort(np.where(own, -np.inf, near), axis=1)[:, ::-1]
            floor = others[:, k - 1] if others.shape[1] >= k else np.full(len(q), -np.inf)
            slack = 1e-6 * np.maximum(1.0, np.abs(near))
            i, c = np.nonzero((near + norm[:, None] * reach + slack >= floor[:, None]) & (slices > 0))
            times = slices[c]
            i, c, part = np.repeat(i, times), np.repeat(c, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "cell": c.astype(np.int32), "part": part.astype(np.int32)})

    parts = F.element_at(F.array(*[F.lit(int(s)) for s in slices]), F.col("cell") + 1)
    rows = cells.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), parts).cast("int").alias("part"))
    asked = queries.select("vec_id", "v").dropDuplicates(["vec_id"]).mapInPandas(visits, "vec_id long, v array<long>, cell int, part int")

    def local(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(rows):
            rows = rows.sort_values("vec_id")
            vec, x = rows["vec_id"].to_numpy(), matrix(rows["v"], width)
            for at in range(0, len(asked), 512):
                part = asked.iloc[at : at + 512]
                scores = products(matrix(part["v"], width), x)
                for query, s in zip(part["vec_id"], scores):
                    s, v = s[vec != query], vec[vec != query]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        pick = np.flatnonzero(s >= least)
                        s, v = s[pick], v[pick]
                    best = np.lexsort((v, -s))[:k]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": v[best], "score": s[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    local_best = asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInPandas(local, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local_best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
