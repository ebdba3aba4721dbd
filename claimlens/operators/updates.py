"""Conditional column updates and workflow transitions. Each is one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed

SPO_COLUMNS = ["spo_type", "subject", "predicate", "object", "big_subject", "big_predicate", "big_object"]


def update_where(df: DataFrame, cond: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where the condition holds; a null condition leaves the row as it is."""
    return df.withColumns({name: F.when(cond, value).otherwise(F.col(name)) for name, value in values.items()})


def external() -> Column:
    return F.col("skip_validations")


def full_spo() -> Column:
    return (F.col("big_subject") != "") & (F.col("big_predicate") != "") & (F.col("big_object") != "")


def clear_spos(df: DataFrame, level: int) -> DataFrame:
    return update_where(df, (F.col("review_level") <= level) & ~F.col("predicate_not_found"),
                        {c: F.lit("") for c in SPO_COLUMNS})


def mark_no_predicate(df: DataFrame, level: int) -> DataFrame:
    cond = (
        (F.col("review_level") <= level) & external() & (F.col("check_worthy_auto") == "FR")
        & ~F.col("predicate_not_found") & ~full_spo()
    )
    return update_where(df, cond, {"predicate_not_found": F.lit(True)})


def preliminary_class(df: DataFrame, is_external: bool) -> DataFrame:
    """Truth label of check-worthy level-5 sentences from the article rating."""
    worthy = F.col("check_worthy_auto" if is_external else "check_worthy") == "FR"
    label = F.when(F.col("rating") < 25, "F").when(F.col("rating") <= 50, "PF").when(F.col("rating") > 50, "T")
    cond = (F.col("review_level") == 5) & worthy & (F.col("skip_validations") == is_external) & label.isNotNull()
    return update_where(df, cond, {"sentence_class": label})


def _level(value) -> Column:
    return F.lit(value).cast("int")


def advance(df: DataFrame, frm: int, to: int | None, to_external: int | None = None) -> DataFrame:
    target = F.when(external(), _level(to_external)).otherwise(_level(to))
    return update_where(df, (F.col("review_level") == frm) & target.isNotNull(), {"review_level": target})


def worthy(full: bool) -> Column:
    return F.col("check_worthy_score_auto") >= 0.5 if full else F.col("check_worthy") == "FR"


def advance_to_check(df: DataFrame, frm: int, to: int, full: bool = False) -> DataFrame:
    cond = (F.col("review_level") == frm) & ~external() & worthy(full)
    return update_where(df, cond, {"review_level": _level(to)})


def advance_completed(df: DataFrame, frm: int, to: int, full: bool = False) -> DataFrame:
    manual = (F.col("manually_identified_predicate") == F.col("big_predicate")) & (F.col("manually_identified_predicate") != "")
    cond = (F.col("review_level") == frm) & ~external() & worthy(full) & (full_spo() if full else manual)
    return update_where(df, cond, {"review_level": _level(to)})


def advance_external(df: DataFrame, frm: int, to: int) -> DataFrame:
    cond = (F.col("review_level") == frm) & external() & (F.col("check_worthy_auto") == "FR") & full_spo()
    return update_where(df, cond, {"review_level": _level(to)})


def fill_external(df: DataFrame, selector: Column) -> DataFrame:
    return update_where(df, selector, {
        "check_worthy": F.col("check_worthy_auto"), "health_terms": F.col("health_terms_auto") > 0})


def spo_pending(level: int, mode: str) -> Column:
    """Sentences still waiting for a predicate; mode is external, full or corpus."""
    at_level = (F.col("review_level") == level) & (F.col("predicate") == "")
    if mode == "external":
        return at_level & external() & (F.col("check_worthy_auto") == "FR") & ~F.col("predicate_not_found")
    return at_level & ~external() & worthy(mode == "full")


def shape_item(df: DataFrame, level: int) -> DataFrame:
    """A crawled record in item form: fixed defaults, level, and the sentinel for a missing date."""
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    date = F.coalesce(F.try_to_date(F.nullif(F.col("publication_date"), F.lit(""))), F.lit(fixed.MISSING_DATE).cast("date"))
    return df.select(
        *[text(c) for c in ["title", "type", "abstract"]], date.alias("publication_date"),
        *[text(c) for c in ["source_entity", "url", "text", "review_entity", "review_url", "claim", "original_rating",
                            "review_summary"]],
        "rating", F.col("class").alias("item_class"), "crawl_date", _level(level).alias("review_level"),
        F.lit(False).alias("url_ok"), F.lit(False).alias("no_health_useless"), F.lit(False).alias("needs_revision"),
        "skip_validations", F.lit(0.0).alias("item_class_auto"), F.lit("NA").alias("item_class_4_auto"), "item_class_4",
        F.lit("Other").alias("instance_type"), F.lit("").alias("revision_reason"),
        *[text(c) for c in ["review_url_2", "review_entity_2", "country", "lang"]],
        *[F.lit("").alias(c) for c in ["main_claim", "main_topic", "instance_type_2"]],
        F.lit(0).cast("long").alias("from_item_id"),
    )
