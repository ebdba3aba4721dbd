"""Fixed-width records dealt to tasks as packed blocks: one shuffled row per batch and bucket instead of one per record."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark schema of dealt rows.
BLOCK = "bucket int, kind string, data binary"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the session's limit of an Arrow batch to 8 MB, for good: results are computed after an operator has returned.

    Whole texts would else go to Python in batches of 64 MB, which are held several times on both sides.
    """
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(_BATCH_BYTES, "64m").strip().lower()).groups()
    now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
    if not 0 < now <= most:
        spark.conf.set(_BATCH_BYTES, str(most))


def pack(kind: str, bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the bytes of its records."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], np.ascontiguousarray(records[order])
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, dtype=np.int64)
    ends = np.append(cuts, len(bucket)) * records.dtype.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array([kind] * len(cuts), pa.string()), data], ["bucket", "kind", "data"])


def unpack(group: pa.Table, kind: str, dtype: np.dtype) -> np.ndarray:
    """All records of one kind in a group of dealt rows."""
    parts = [np.frombuffer(d, dtype=dtype) for k, d in zip(group["kind"].to_pylist(), group["data"].to_pylist()) if k == kind]
    return np.concatenate(parts) if parts else np.empty(0, dtype=dtype)


def first_of(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before in any key."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Complete groups of rows that come sorted by ``key``; one group at a time is held besides the current batch."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        at = np.flatnonzero(first_of(*[t[c].to_numpy() for c in key]))
        for i, j in zip(at[:-1], at[1:]):
            yield t.slice(i, j - i)
        rest = t.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest


def meet(dealt: DataFrame, buckets: int, each, schema: str) -> DataFrame:
    """Brings the blocks of a bucket together and maps each bucket's table with ``each`` to record batches."""

    def batches(it):
        for t in groups(it, ["bucket"]):
            yield from each(t)

    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(batches, schema)
