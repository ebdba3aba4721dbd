"""Training variants: transformed copies of items and sentences that keep their lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import gather_ordered, running_total
from claimlens.operators.selectors import item_selector

COPY_LEVEL = 7


def _highest(df: DataFrame, col: str) -> Column:
    return F.coalesce(df.agg(F.max(col).alias("m")).scalar(), F.lit(0))


def _numbered(df: DataFrame, key: str, start: Column, step: int, out: str) -> DataFrame:
    """New ids in key order for rows with a non-zero key; key 0 stays 0."""
    per_key = df.where(F.col(key) != 0).groupBy(key).agg(F.count("*").alias("_n"))
    before = running_total(per_key, key, "_n", "_before").select(key, "_before")
    return df.join(before, key, "left").withColumn(out, F.coalesce(start + step * (F.col("_before") + 1), F.lit(0)).cast("long")).drop("_before")


def augment(items: DataFrame, sentences: DataFrame, transform: Callable[[Column], Column], label: str) -> tuple[DataFrame, DataFrame]:
    """(item copies, sentence copies) of the finished training items.

    The transform is applied to SPO parts and sentence at level 9, to the sentence alone at level 5; other
    levels are emptied. ``new_sentence_id`` must be unique among copied sentences and grow in reading order.
    """
    source = items.where(item_selector("augment"))
    wanted = source.select(F.col("id").alias("item_id"))
    level = F.col("review_level")
    changed = lambda col, cond: F.when(cond, transform(F.trim(F.col(col)))).otherwise(F.lit(""))
    subject, predicate, obj = (changed(c, level == 9) for c in ("big_subject", "predicate", "big_object"))
    copies = sentences.join(wanted, "item_id", "left_semi").withColumns({
        "sentence": changed("sentence", level.isin(9, 5)),
        "subject": subject, "big_subject": subject, "big_predicate": predicate, "manually_identified_predicate": predicate,
        "object": obj, "big_object": obj, "_predicate": predicate,
        "from_sentence_id": F.col("id"), "from_item_id": F.col("item_id"),
        "instance_type": F.concat("instance_type", F.lit(f"_{label}")),
        "_level": F.when(level != 5, COPY_LEVEL).otherwise(level)})
    copies = copies.drop("predicate", "review_level").withColumnsRenamed({"_predicate": "predicate", "_level": "review_level"})
    copies = copies.withColumn("_old", F.col("new_sentence_id"))
    copies = _numbered(copies.drop("new_sentence_id"), "_old", _highest(sentences, "new_sentence_id"), fixed.ID_STEP, "new_sentence_id")

    texts = gather_ordered(copies, ["from_item_id"], "_old", F.col("sentence"), "_lines")
    first = F.array_position(F.transform("_lines", lambda x: x != ""), True).cast("int")
    text = F.when(first > 0, F.array_join(F.slice("_lines", first, F.size("_lines")), "\n")).otherwise(F.lit(""))
    texts = texts.select(F.col("from_item_id").alias("_from"), text.alias("_text"))

    new_items = _numbered(source.withColumn("_from", F.col("id")).drop("id"), "_from", _highest(items, "id"), 1, "id")
    new_items = new_items.join(texts, "_from", "left").withColumns({
        "review_level": F.lit(COPY_LEVEL), "text": F.coalesce("_text", F.lit("")), "item_class_auto": F.lit(0.0),
        "item_class_4_auto": F.lit(""), "from_item_id": F.col("_from"), "instance_type": F.concat("instance_type", F.lit(f"_{label}"))}).drop("_text", "_from")
    owner = new_items.select(F.col("id").alias("_copy"), "from_item_id")
    linked = copies.join(owner, "from_item_id").withColumn("item_id", F.col("_copy")).drop("_copy", "_old")
    return new_items, linked
