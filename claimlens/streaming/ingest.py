"""Incremental post ingest on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimlens.operators.ingest import shape_user

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_posts(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files of posts as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@contextmanager
def _state_on_disk(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, so that seen keys need not fit in memory; the setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def append_unseen(rows: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends the rows whose key no earlier batch has had, one per key, to a table.

    Seen keys are the stream's state, dealt by key to the shuffle partitions and kept with the checkpoint: a batch looks up
    its own keys and reads no stored row. Tables written this way list their files per batch, so a batch that is replayed
    after a failure leaves no row twice. All ``path`` rows must come through the same checkpoint.
    """
    with _state_on_disk(rows.sparkSession):
        writer = rows.dropDuplicates([key]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start()


def _stamped(stream: DataFrame, crawl_date: str | None) -> DataFrame:
    return stream.withColumn("crawl_date", F.lit(crawl_date) if crawl_date else F.current_timestamp().cast("string"))


def ingest_posts(stream: DataFrame, path: str, checkpoint: str, key: str = "id_str", crawl_date: str | None = None) -> StreamingQuery:
    """Appends unseen posts, stamped with the crawl time; however old a post is, it is stored if its key is new."""
    return append_unseen(_stamped(stream, crawl_date), path, checkpoint, key)


def ingest_users(stream: DataFrame, users: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, crawl_date: str | None = None) -> StreamingQuery:
    """Appends unseen users of the posts; ``users`` makes user rows (``id_str`` first) of stamped posts."""
    return append_unseen(shape_user(users(_stamped(stream, crawl_date))), path, checkpoint, "id_str")
