"""Article-level results rolled up from sentences: verdicts, levels, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators import updates


def with_sentences(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """Items left-joined to their sentences; items without sentences stay."""
    return items.join(sentences.withColumnRenamed("item_id", "id"), "id", "left")


def count_of(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _roll_up(items: DataFrame, sentences: DataFrame, **aggregates: Column) -> DataFrame:
    """Sentence aggregates are reduced map-side before the join, so a huge article costs one row per task."""
    per_item = sentences.groupBy(F.col("item_id").alias("id")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return items.join(per_item, "id", "left")


def verdicts(items: DataFrame, sentences: DataFrame, ground_truth: bool = False) -> DataFrame:
    """All article verdicts: 4-class, binary by class, binary by score, binary by mean score.

    ``ground_truth`` uses the manual sentence class (T scores 1, others 0) in place of the predictions;
    the mean verdict keeps the predicted score either way.
    """
    if ground_truth:
        cls = F.col("sentence_class")
        score = F.when(cls == "T", 1.0).otherwise(0.0)
    else:
        cls, score = F.col("sentence_class_auto"), F.col("sentence_class_score_auto")
    out = _roll_up(items, sentences, _f=count_of(cls == "F"), _pf=count_of(cls == "PF"), _t=count_of(cls == "T"),
                   _min=F.min(score), _mean=F.avg("sentence_class_score_auto"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    four = F.when(n("_f") > 0, "F").when(n("_pf") > 0, "PF").when(n("_t") > 0, "T").otherwise("NA")
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return out.withColumns({
        "verdict4": four,
        "verdict_bin_cls": flag((n("_f") == 0) & (n("_pf") == 0) & (n("_t") > 0)),
        "verdict_bin_score": flag(F.col("_min") > 0.5),
        "verdict_bin_mean": flag(F.col("_mean") > 0.5),
    }).drop("_f", "_pf", "_t", "_min", "_mean")


def naive_verdict(items: DataFrame, sentences: DataFrame, level: int, ground_truth: bool = False,
                  by_class: bool = False, which: Column | None = None) -> DataFrame:
    """Writes the verdict columns of (chosen) items at a level from their sentences at that level."""
    judged = verdicts(items, sentences.where(F.col("review_level") == level), ground_truth)
    at_level = F.col("review_level") == level
    if which is not None:
        at_level = at_level & which
    binary = F.col("verdict_bin_cls" if by_class else "verdict_bin_score").cast("double")
    done = updates.update_where(judged, at_level, {"item_class_4_auto": F.col("verdict4"), "item_class_auto": binary})
    return done.drop("verdict4", "verdict_bin_cls", "verdict_bin_score", "verdict_bin_mean")


FEATURES = [
    "f_count", "pf_count", "t_count", "na_count", "f_perc", "pf_perc", "t_perc", "na_perc",
    "t05_count", "t04_count", "t00_count", "t05_perc", "t04_perc", "t00_perc",
    "score_sum", "score_avg", "cw_sum", "cw_avg",
]


def item_features(items: DataFrame, sentences: DataFrame, level: int) -> DataFrame:
    """18 counts and shares per item. Shares divide by the labelled-sentence count, not by the row count."""
    cls, score, cw = F.col("sentence_class_auto"), F.col("sentence_class_score_auto"), F.col("check_worthy_score_auto")
    sums = dict(
        f_count=count_of(cls == "F"), pf_count=count_of(cls == "PF"), t_count=count_of(cls == "T"), na_count=count_of(cls == "NA"),
        t05_count=count_of(score > 0.5), t04_count=count_of(score > 0.4), t00_count=count_of(score <= 0.4),
        score_sum=F.sum(score), cw_sum=F.sum(cw),
    )
    out = _roll_up(items, sentences.where(F.col("review_level") == level), **sums)
    out = out.fillna(0, subset=list(sums))
    total = F.col("f_count") + F.col("pf_count") + F.col("t_count") + F.col("na_count")
    share = lambda c: F.when(total != 0, F.col(c) / total).otherwise(F.lit(0.0))
    shares = {f"{p}_perc": share(f"{p}_count") for p in ["f", "pf", "t", "na", "t05", "t04", "t00"]}
    return out.withColumns({**shares, "score_avg": share("score_sum"), "cw_avg": share("cw_sum")})


def roll_up_level(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """Item level = highest level of its sentences above 0; items without such sentences keep their level."""
    top = sentences.where(F.col("review_level") > 0).groupBy(F.col("item_id").alias("id")).agg(F.max("review_level").alias("_top"))
    moved = items.join(top, "id", "left")
    cond = (F.col("review_level") > 0) & F.col("_top").isNotNull()
    return updates.update_where(moved, cond, {"review_level": F.col("_top")}).drop("_top")


def workflow_step(items: DataFrame, sentences: DataFrame, step: int, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, sentences) after one workflow step, as one lazy plan; ``full`` goes by automatic scores instead of reviews."""
    if step == 5:
        sentences = updates.advance(sentences, 3, 4, 5)
    elif step == 7:
        sentences = updates.advance_to_check(sentences, 5, 6, full)
        sentences = updates.advance_external(sentences, 5, 7)
        sentences = updates.advance_completed(sentences, 6, 7, full)
    elif step == 9:
        sentences = updates.advance(sentences, 7, None, 8)
    elif step == 10:
        scored = (updates.external() & (F.col("instance_type") == "Other")) | (
            ~updates.external() & (F.col("instance_type") == "Dev"))
        items = naive_verdict(items, sentences, 8, which=scored)
        sentences = updates.advance(sentences, 8, 9, 9)
    else:
        raise ValueError(f"no workflow step {step}")
    items = roll_up_level(items, sentences)
    if step == 10:
        items = naive_verdict(items, sentences, 9, which=scored)
    return items, sentences


def extreme(df: DataFrame, field: str, cond: Column, ascending: bool = False, out: str = "value") -> DataFrame:
    """Largest (or smallest) value of a field among matching rows; nulls are ignored."""
    pick = F.min if ascending else F.max
    return df.where(cond).agg(pick(field).alias(out))


def latest_items(df: DataFrame, n: int = 15) -> DataFrame:
    return df.orderBy(F.desc("publication_date"), F.desc("id")).limit(n)
