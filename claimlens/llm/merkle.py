"""Merkle manifest of a table: ternary hash trees per part under one root, with a proof for every row.

Ranks within a part are written in base three. Rows of a block of ``3 ** LEVELS`` neighbours meet once; within a block
one digit column after the other is grouped away, each grouping nests the structs below it, and the nested struct is
taken apart again by ``transform`` and ``explode``, which yields every row's siblings without a join. Block digests are
the rows of the next round, so no row of any round holds more than one block, however large a part is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.cluster import materialise

WAYS = 3
#: Digits that are grouped away within a block; a block has ``WAYS ** LEVELS`` rows at most.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the field encoding: ``-`` for null, else the UTF-8 length, ``:`` and the value."""

    def field(v):
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def proof(path: Column) -> Column:
    """The siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf digest and its siblings."""
    return F.aggregate(path, leaf, lambda now, p: F.sha2(F.concat(p["left"], now, p["right"]), 256))


def ranked(nodes: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0 within the part) and ``size`` (rows of the part).

    Rows are dealt to ranges of (part, order) and stored, so that ranges stay the same; a range ranks its own rows, moved
    by the rows that earlier ranges hold of the part. A part of any size is spread over ranges.
    """
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(nodes.repartitionByRange(ranges, part, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part, "range").count()
    before = F.sum("count").over(Window.partitionBy(part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(part, "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy(part)).alias("size"))
    inside = F.row_number().over(Window.partitionBy(part, "range").orderBy(*order))
    return dealt.join(counts, [part, "range"]).withColumn("rank", F.col("before") + inside - 1).drop("range", "before")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(part, block, size, node): one nested struct per block of the (part, rank, size, hash, row) rows.

    A level is hashed only while the part has several nodes there; a single node stands for itself.
    """
    digits = [(F.floor(F.col("rank") / WAYS**i) % WAYS).cast("int").alias(f"d{i}") for i in range(LEVELS)]
    block = F.floor(F.col("rank") / WAYS**LEVELS).cast("long").alias("block")
    now = nodes.select("part", block, "size", *digits, F.struct("hash", "row").alias("node")).repartition("part", "block")
    for i in range(LEVELS):
        run = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), F.col("node"))), lambda a, b: a["d"] - b["d"])
        now = now.groupBy("part", "block", "size", *[f"d{j}" for j in range(i + 1, LEVELS)]).agg(run.alias("run"))
        joined = F.sha2(F.array_join(F.transform("run", lambda r: r["node"]["hash"]), ""), 256)
        up = F.when(F.col("size") > WAYS**i, joined).otherwise(F.col("run")[0]["node"]["hash"])
        now = now.withColumn("node", F.struct(up.alias("hash"), F.col("run"))).drop("run")
    return now


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks of every round, and (part, hash): the top digest of each part."""
    rounds = []
    while True:
        blocks = materialise(_blocks(nodes), "blocks")
        rounds.append(blocks)
        largest = blocks.agg(F.max("size")).first()[0]
        if largest is None or largest <= WAYS**LEVELS:
            return rounds, blocks.select("part", F.col("node.hash").alias("hash"))
        size = F.ceil(F.col("size") / WAYS**LEVELS)
        nodes = blocks.select("part", F.col("block").alias("rank"), size.alias("size"), F.col("node.hash").alias("hash"), F.col("block").alias("row"))


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(part, row, hash, path, top): every row of the lowest round with its siblings up to what ``tops`` starts from.

    ``tops`` has (part, path, top): what each part's own top digest has above it.
    """
    above = tops.select("part", F.lit(0).cast("long").alias("block"), "path", "top")
    for blocks in reversed(rounds):
        both = blocks.unionByName(above, allowMissingColumns=True).groupBy("part", "block")
        now = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "node", "path", "top")])
        for i in reversed(range(LEVELS)):
            run = F.col("node.run")

            def side(here, lo, n):
                return F.array_join(F.transform(F.slice(here, lo, n), lambda r: r["node"]["hash"]), "")

            kids = F.transform(run, lambda r, at: F.struct(r["node"].alias("node"), side(run, F.lit(1), at).alias("left"), side(run, at + 2, F.lit(WAYS)).alias("right")))
            now = now.select("part", "size", "path", "top", F.explode(kids).alias("kid"))
            longer = F.concat(F.array(F.struct("kid.left", "kid.right")), F.col("path"))
            now = now.select("part", "size", F.when(F.col("size") > WAYS**i, longer).otherwise(F.col("path")).alias("path"), "top", "kid.node")
        above = now.select("part", F.col("node.row").alias("block"), "path", "top")
    return now.select("part", F.col("node.row").alias("row"), F.col("node.hash").alias("hash"), "path", "top")


def manifest(docs: DataFrame, other: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", part: str = "source") -> DataFrame:
    """(key, part, leaf, subroot, root, path) per row of ``docs``; ``other`` adds values per row, computed with the leaf.

    ``path`` lists the siblings left and right of the row, from the leaf's own run to the run below the root. Leaves of a
    part ascend by key; null keys come first, equal keys ascend by leaf digest. Parts ascend bytewise, the null part first.
    Null fields are hashed as ``-``, empty texts as ``0:``; texts of any length are hashed whole. Repeated rows are leaves
    of their own. An empty table gives no rows. Columns of ``docs`` other than ``fields`` are not read, whatever their names.
    """
    part_key = F.struct(F.col(part).isNotNull().alias("known"), F.coalesce(part, F.lit("")).alias("name"))
    row = F.struct(F.col(key).alias("key"), *[v.alias(n) for n, v in (other or {}).items()])
    leaves = materialise(docs.select(part_key.alias("part"), digest(*[F.col(f) for f in fields]).alias("hash"), row.alias("row")), "leaves")
    rounds, subroots = climb(ranked(leaves.withColumn("key", F.col("row.key")), "part", ["key", "hash"]))

    names = subroots.select(F.lit(0).alias("part"), F.col("part").alias("row"), "hash")
    over, roots = climb(ranked(names, "part", ["row"]))
    nothing = F.array().cast(_PATH).alias("path")
    tops = descend(over, roots.select("part", nothing, F.struct(F.col("hash").alias("root")).alias("top")))
    tops = tops.select(F.col("row").alias("part"), "path", F.struct(F.col("hash").alias("subroot"), "top.root").alias("top"))
    found = descend(rounds, tops)
    source = F.when(F.col("part.known"), F.col("part.name")).alias(part)
    return found.select(F.col("row.key").alias(key), source, F.col("hash").alias("leaf"), "top.subroot", "top.root", "path", *[f"row.{n}" for n in other or {}])
