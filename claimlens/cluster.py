"""Helpers for running well on a cluster: shared folders, scan spreading, hot keys, distributed ordering."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` if the cluster sets it.

    A temporary folder stands in only for a single-machine (``local``) session, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimlens-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once, read back: cuts lineage on reliable storage, so lost executors cost one re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a scan has fewer splits than cores; a scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Computes the named columns once per row before anything else uses them.

    Catalyst copies a column's expression into filters and array functions that use it; for array folds that
    would repeat the fold per element. A one-element ``inline`` keeps the value. No shuffle.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Hints a broadcast for a table of at most ``rows`` rows, counted first; a larger one is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(big: DataFrame, small: DataFrame, key: str, salt_by: Column, salts: int = 16, share: int = 64) -> DataFrame:
    """Inner equi-join in which the keys that own more than one row in ``share`` of ``big`` are split over ``salts`` tasks.

    The keys are counted first, with partial sums, and fewer than ``share`` of them can be that large; all other keys are
    joined as they are.
    """
    counts = big.where(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[key] for r in counts.where(F.col("count") * share > max(total, share * 10_000)).select(key).collect()]
    if not hot:
        return big.join(small, key)
    left = big.withColumn("_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(0))
    right = small.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def running_total(per_key: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all smaller keys, for one row per key; keys may be any ordered values, rows without one are left out.

    Keys are dealt to ranges and stored, so that ranges stay the same; every range is summed by itself and moved up by
    the sums of the ranges before it, of which there are as many as shuffle partitions.
    """
    ranges = int(per_key.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(per_key.where(F.col(key).isNotNull()).repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "ranges")

    def earlier(col, window):
        return F.coalesce(F.sum(col).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", earlier("_sum", Window.orderBy("_range")).alias("_moved"))
    inside = earlier(value, Window.partitionBy("_range").orderBy(key))
    return dealt.join(F.broadcast(sums), "_range").withColumn(out, (F.col("_moved") + inside).cast("long")).drop("_range", "_moved")


def ranked(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0 within the part, in the given order) and ``size`` (rows of the part).

    Rows are dealt to ranges of (part, order) and stored, so that ranges stay the same; a range ranks its own rows, moved by
    the rows that earlier ranges hold of the part. A part of any size is spread over ranges. Rows without a part are left out.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = df.where(F.col(part).isNotNull())
    dealt = materialise(given.repartitionByRange(ranges, part, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part, "_range").count()
    before = F.sum("count").over(Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(part, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy(part)).alias("size"))
    inside = F.row_number().over(Window.partitionBy(part, "_range").orderBy(*order))
    return dealt.join(counts, [part, "_range"]).withColumn("rank", F.col("_before") + inside - 1).drop("_range", "_before")


def gather_ordered(df: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    """Array of ``value`` per key in ``order`` (equal places by value).

    Rows are dealt by key and sorted once, so the values of a key follow each other and are put into its array as they
    come: one exchange, and besides a batch only the array that is being filled is held.
    """
    given = df.select(*keys, F.col(order).alias("_order"), value.alias("_value"))
    dealt = given.repartition(*keys).sortWithinPartitions(*keys, "_order", "_value").drop("_order")
    fields = {f.name: f for f in dealt.schema}
    schema = T.StructType([fields[k] for k in keys] + [T.StructField(out, T.ArrayType(fields["_value"].dataType))])

    def row(held):
        values = pa.concat_arrays([b.column("_value") for b in held])
        listed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([*[held[0].column(k).slice(0, 1) for k in keys], listed], [*keys, out])

    def starts(b, last):
        """Whether a row has another key than the row before; ``last`` is the row before the batch."""
        new = np.zeros(len(b), dtype=bool)
        for k in keys:
            c = b.column(k)
            before = pa.concat_arrays([last.column(k) if last is not None else pa.nulls(1, c.type), c.slice(0, len(c) - 1)])
            same = pc.or_(pc.fill_null(pc.equal(c, before), False), pc.and_(pc.is_null(c), pc.is_null(before)))
            new |= ~same.to_numpy(zero_copy_only=False)
        new[0] |= last is None
        return np.flatnonzero(new)

    def lists(batches):
        held = []
        for b in batches:
            if not len(b):
                continue
            at = starts(b, held[-1].slice(len(held[-1]) - 1) if held else None)
            if not len(at):
                held.append(b)
                continue
            if held:
                yield row([*held, b.slice(0, at[0])])
            if len(at) > 1:
                values = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), b.column("_value").slice(at[0], at[-1] - at[0]))
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at[:-1])) for k in keys], values], [*keys, out])
            held = [b.slice(at[-1])]
        if held:
            yield row(held)

    return dealt.mapInArrow(lists, schema)
