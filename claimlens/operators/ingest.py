"""Turning items into numbered sentences, suppressing known records, shaping posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import running_total
from claimlens.functions.text import split_sentences
from claimlens.operators import updates


def pending_items(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """Items without any sentence yet."""
    have = sentences.select(F.col("item_id").alias("id")).distinct()
    return items.join(have, "id", "left_anti")


def number_sentences(df: DataFrame, start: Column, key: str = "item_id", pos: str = "pos") -> DataFrame:
    """new_sentence_id = start + 10 per sentence, in item order then text order; ``pos`` counts from 0.

    Only one row per item takes part in the ordering (block sums, no global window).
    """
    per_item = df.groupBy(key).agg(F.count("*").alias("_n"))
    offsets = running_total(per_item, key, "_n", "_before").select(key, "_before")
    number = start + fixed.ID_STEP * (F.col("_before") + F.col(pos) + 1)
    return df.join(offsets, key).withColumn("new_sentence_id", number.cast("long")).drop("_before")


def start_number(sentences: DataFrame) -> Column:
    """Highest number in use, or 10 for an empty table."""
    return F.coalesce(sentences.agg(F.max("new_sentence_id").alias("m")).scalar(), F.lit(fixed.ID_STEP))


def generate_sentences(items: DataFrame, sentences: DataFrame, level: int = 1) -> tuple[DataFrame, DataFrame]:
    """(new sentence rows, items with their new level) for items at a level that have no sentences yet.

    External articles enter at level 3, corpus articles at level 2, unless the level is 5 or more.
    """
    todo = pending_items(items.where(F.col("review_level") == level), sentences)
    enter = F.when(F.lit(level) >= 5, F.lit(level)).when(updates.external(), 3).otherwise(2)
    cut = todo.select(
        F.col("id").alias("item_id"), "rating", "title", "skip_validations", enter.alias("review_level"),
        F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))
    new = number_sentences(cut, start_number(sentences)).withColumns({
        "check_worthy": F.lit("NA"), "sentence_class": F.lit("NA"), "instance_type": F.lit("Other"),
        "needs_revision": F.lit(False), "health_terms": F.lit(False), "health_terms_auto": F.lit(0),
        "predicate_not_found": F.lit(False), "check_worthy_auto": F.lit(""), "sentence_class_auto": F.lit(""),
        "check_worthy_score_auto": F.lit(0.0), "sentence_class_score_auto": F.lit(0.0),
        **{c: F.lit("") for c in updates.SPO_COLUMNS}, "manually_identified_predicate": F.lit(""),
        "from_sentence_id": F.lit(0).cast("long"), "from_item_id": F.lit(0).cast("long")})
    moved = items.join(todo.select("id", F.lit(True).alias("_new")), "id", "left")
    moved = updates.update_where(moved, F.col("_new"), {"review_level": enter}).drop("_new")
    return new, moved


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are not stored yet, one row per key.

    Incoming rows are reduced to one per key before the join, so copies of one key never meet in a task.
    """
    rest = [c for c in incoming.columns if c not in keys]
    if rest:
        one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*incoming.columns)
    else:
        one = incoming.distinct()
    return one.join(existing.select(*keys).distinct(), keys, "left_anti")


def relink(sentences: DataFrame, items: DataFrame) -> DataFrame:
    """Copied sentences point at the copy of their item (matched on ``from_item_id``)."""
    copies = items.where(F.col("from_item_id") != 0).groupBy("from_item_id").agg(F.max("id").alias("_copy"))
    linked = sentences.join(copies, "from_item_id", "left")
    return linked.withColumn("item_id", F.coalesce("_copy", "item_id")).drop("_copy")


def shape_post(df: DataFrame) -> DataFrame:
    """A social post in table form: empty reply name, quoted id only for quotes, default labels."""
    return df.withColumns({
        "in_reply_to_screen_name": F.coalesce("in_reply_to_screen_name", F.lit("")),
        "quoted_status_id_str": F.when(F.col("is_quote_status"), F.col("quoted_status_id_str")).otherwise(F.lit("")),
        "check_worthy": F.lit("NF"), "tweet_class": F.lit(0), "needs_revision": F.lit(False), "review_level": F.lit(0)})


USER_COLUMNS = ["id_str", "name", "screen_name", "location", "description", "followers_count", "friends_count", "listed_count",
                "favourites_count", "statuses_count", "created_at", "verified", "crawl_date"]


def shape_user(df: DataFrame) -> DataFrame:
    return df.select(*USER_COLUMNS)
