"""Texts rebuilt or cut across rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import gather_ordered, running_total


def item_text(sentences: DataFrame) -> DataFrame:
    """(item_id, text): sentences in order, each ended by a full stop if it ends in a letter or digit, one per line."""
    s = F.col("sentence")
    line = F.concat(s, F.when(s.rlike(r"[\p{L}\p{N}]$"), ".").otherwise(""), F.lit("\n"))
    lines = gather_ordered(sentences, ["item_id"], "new_sentence_id", line, "_lines")
    return lines.select("item_id", F.array_join("_lines", "").alias("text"))


def whole_chars(text: Column, limit: Column) -> Column:
    """The longest head of whole characters within ``limit`` bytes of UTF-8."""
    raw = F.encode(text, "UTF-8")
    inside = lambda at: F.hex(F.substring(raw, at, F.lit(1))).between("80", "BF")  # noqa: E731  the byte continues a character
    # a character has four bytes at most
    cut = F.when(~inside(limit + 1), limit).when(~inside(limit), limit - 1).when(~inside(limit - 1), limit - 2).otherwise(limit - 3)
    return F.decode(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))), "UTF-8")


def head_bytes(df: DataFrame, key: str, text: str, limit: int = 250_000_000) -> DataFrame:
    """Rows in key order up to ``limit`` bytes of text; the row on the boundary is cut at its last whole character inside.

    Byte totals come from block sums over the integer key, so no task sees the whole column.
    """
    sized = df.withColumn("_size", F.octet_length(text))
    before = running_total(sized.select(key, "_size"), key, "_size", "_before").select(key, "_before")
    cut = sized.join(before, key).where(F.col("_before") < limit)
    keep = whole_chars(F.col(text), F.least(F.lit(limit) - F.col("_before"), F.col("_size")).cast("int"))
    return cut.withColumn(text, F.when(F.col("_before") + F.col("_size") <= limit, F.col(text)).otherwise(keep)).drop("_size", "_before")
