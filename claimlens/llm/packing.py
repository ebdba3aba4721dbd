"""Best-fit packing under conflicts: documents into bins of a token capacity.

Documents are dealt to shards of bounded size by a hash. In a shard, pieces go from longest to shortest into the
tightest open bin that has room and no conflict: bins are held in order of their residual, each with a bitmap of the
sources and a bitmap of the duplicate clusters inside, and the search walks from the smallest sufficient residual
upwards until a compatible bin is found. A bin holds one piece per source and one per cluster at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise
from claimlens.llm import blocks, words

CAPACITY = 2048
SHARD_PIECES = 4096

MEASURED = "doc_id long, source string, n_tokens long, cluster long"
PACKED = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset int, source string, cluster long"


def measure(docs: DataFrame) -> DataFrame:
    """Token count (words without white space) and duplicate cluster of every text.

    The cluster is a hash of the lower-cased word sequence; texts without words have none. Null texts are empty.
    """

    def batches(it):
        for b in it:
            n, cluster, some = [], [], []
            for run in words.runs(b["text"]):
                n.append(np.diff(run.first))
                # order-dependent sum of the words' hashes within each row
                place = np.arange(len(run.hashes)) - np.repeat(run.first[:-1], n[-1])
                sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(run.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
                cluster.append((sums[run.first[1:]] - sums[run.first[:-1]]).view(np.int64))
                some.append(n[-1] > 0)
            n, cluster, some = (np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in ((n, np.int64), (cluster, np.int64), (some, bool)))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["source"], pa.array(n, pa.int64()), pa.array(cluster, pa.int64(), mask=~some)], ["doc_id", "source", "n_tokens", "cluster"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(batches, MEASURED)


def best_fit(sizes, sources, clusters, capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each piece, taken in the given order; bit masks stand for sources and clusters (0: none)."""
    order: list[tuple[int, int]] = []
    residual, in_source, in_cluster = [], [], []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        at = bisect_left(order, (size, -1))
        while at < len(order) and (in_source[order[at][1]] & source or in_cluster[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            _, chosen = order.pop(at)
        else:
            chosen = len(residual)
            residual.append(capacity)
            in_source.append(0)
            in_cluster.append(0)
        bins.append(chosen)
        offsets.append(capacity - residual[chosen])
        residual[chosen] -= size
        in_source[chosen] |= source
        in_cluster[chosen] |= cluster
        if residual[chosen]:
            insort(order, (residual[chosen], chosen))
    return bins, offsets, len(residual)


def _bits(values: pd.Series) -> list[int]:
    codes, _ = pd.factorize(values)
    return [1 << int(c) if c >= 0 else 0 for c in codes]


def pack_measured(measured: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packs rows of (doc_id, source, n_tokens, cluster); ``measured`` must be stored, it is read twice."""
    rows = measured.agg(F.count("*")).first()[0]
    shards = max(1, -(-rows // shard_pieces))
    pieces = (
        measured.withColumn("row", F.monotonically_increasing_id())
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))
        .withColumn("whole", F.floor((F.greatest("n_tokens", F.lit(1)) - 1) / capacity).cast("long"))
    )

    def fill(shard: pa.Table) -> pa.Table:
        pdf = shard.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        whole = pdf.whole.astype("int64")
        tail = pdf.assign(piece=whole, start=whole * capacity, n_tokens=pdf.n_tokens - whole * capacity)
        full = pdf.loc[pdf.index.repeat(whole)]
        full = full.assign(piece=full.groupby(level=0).cumcount(), n_tokens=capacity)
        full = full.assign(start=full.piece * capacity)
        both = pd.concat([full, tail], ignore_index=True)
        both = both.sort_values(["n_tokens", "doc_id", "row", "piece"], ascending=[False, True, True, True], ignore_index=True)
        todo = both[both.n_tokens > 0]
        bins, offsets, _ = best_fit(todo.n_tokens.tolist(), _bits(todo.source), _bits(todo.cluster), capacity)
        none = [None] * (len(both) - len(todo))
        first = shard["shard"][0].as_py() << 32
        both = both.assign(bin_id=pd.array([first + x for x in bins] + none, dtype="Int64"), bin_offset=pd.array(offsets + none, dtype="Int64"))
        return pa.Table.from_pandas(both[packed.names], preserve_index=False).cast(packed)

    packed = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.int64()),
                        ("bin_offset", pa.int32()), ("source", pa.string()), ("cluster", pa.int64())])
    return pieces.groupBy("shard").applyInArrow(fill, PACKED)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece of every document: its place in the document and in its bin.

    Columns: ``doc_id, piece, start, n_tokens`` (of the piece), ``bin_id, bin_offset, source, cluster``. Texts longer
    than ``capacity`` are cut into pieces of ``capacity`` tokens, no token is lost. Null or empty texts give one row
    without a bin. Null sources and texts without words conflict with nothing. Repeated rows are packed each; as copies
    they never share a bin. Other columns are ignored; an empty table gives no rows.
    """
    blocks.bound_batches(docs.sparkSession)
    return pack_measured(materialise(measure(docs), "packing"), capacity, shard_pieces)
