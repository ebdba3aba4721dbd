"""Connected components of an edge table by alternating large and small stars, each round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id of the (a, b) edges with the smallest id it is connected to, itself included only by edges."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialise(small, "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one edge, to an id that has none: then each id has its component's smallest."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    found = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return not found.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("in") == 1))).limit(1).count()
