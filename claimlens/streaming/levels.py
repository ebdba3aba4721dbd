"""A table of rows at review levels, and stages that move rows from level to level.

Rows lie in folders, one per level and write. A version is a small file that lists the folders of the table; it appears
by a rename, so readers see the table before a stage or after it, never in between. A stage rewrites the folders of its own
level only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_LEVEL = "at_level"
Folders = list[tuple[str, int]]


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> tuple[int, Folders]:
    """Number of the table's latest version, and its folders with their levels; -1 and none before the first."""
    place, fs = _files(spark, path)
    top = place(f"{path}/versions")
    found = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    numbers = [int(n) for n in found if n.isdigit()]
    if not numbers:
        return -1, []
    lines = spark.read.text(f"{path}/versions/{max(numbers)}").collect()  # a line per folder
    return max(numbers), [(r["folder"], r["level"]) for r in (json.loads(line["value"]) for line in lines)]


def _add(rows: DataFrame, path: str) -> Folders:
    """Writes rows to a new folder per level."""
    spark, folder = rows.sparkSession, f"{path}/rows/{uuid.uuid4().hex}"
    rows.withColumn(_LEVEL, F.col("review_level")).write.partitionBy(_LEVEL).parquet(folder)
    place, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place(folder)) if s.isDirectory()]
    return [(f"{folder}/{n}", int(n.partition("=")[2])) for n in names if n.startswith(f"{_LEVEL}=")]


def _commit(spark: SparkSession, path: str, number: int, folders: Folders) -> None:
    place, fs = _files(spark, path)
    fs.mkdirs(place(f"{path}/versions"))
    draft, final = place(f"{path}/.draft-{uuid.uuid4().hex}"), place(f"{path}/versions/{number}")
    out = fs.create(draft, False)
    out.write("".join(json.dumps({"folder": f, "level": n}) + "\n" for f, n in folders).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{path} has got version {number} from another writer")


def create(rows: DataFrame, path: str) -> None:
    """Writes the first version of a table; ``rows`` have an integer ``review_level``."""
    _commit(rows.sparkSession, path, 0, _add(rows, path))


def read(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """The latest version's rows, or those at one level; only that level's folders are read."""
    folders = version(spark, path)[1]
    chosen = [f for f, n in folders if level is None or n == level]
    return spark.read.parquet(*chosen) if chosen else spark.read.parquet(*[f for f, _ in folders]).where("false")


def move(spark: SparkSession, path: str, stage: Callable[[DataFrame], DataFrame], level: int) -> bool:
    """Runs a stage over the rows at a level and commits the table with what it returns in their place.

    False if no row is at the level. A run that fails before its commit leaves the table as it was.
    """
    number, folders = version(spark, path)
    if not any(n == level for _, n in folders):
        return False
    moved = _add(stage(read(spark, path, level)), path)
    _commit(spark, path, number + 1, [(f, n) for f, n in folders if n != level] + moved)
    return True


def run_stage(spark: SparkSession, path: str, stage: Callable[[DataFrame], DataFrame], level: int, checkpoint: str) -> StreamingQuery:
    """Polls a table: whenever versions have been added, the rows that have reached the level go through the stage.

    A replayed batch finds its rows moved and does nothing.
    """
    versions = spark.readStream.text(f"{path}/versions")
    return versions.writeStream.foreachBatch(lambda _, __: move(spark, path, stage, level) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
