"""Queries: article verdicts, features, levels and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import articles, counts
from claimlens.operators.selectors import item_selector, sentence_selector
from claimlens.plans import views
from claimlens.plans.registry import register
from claimlens.plans.views import with_views

VERDICT_SQL = with_views("item", "sentence") + """
SELECT i.id, {expr} AS {name} FROM item i LEFT JOIN sentence s ON s.item_id = i.id GROUP BY i.id"""
F_, PF_, T_ = [f"count(*) FILTER (s.sentence_class_auto = '{c}')" for c in ("F", "PF", "T")]
FOUR = f"CASE WHEN {F_} > 0 THEN 'F' WHEN {PF_} > 0 THEN 'PF' WHEN {T_} > 0 THEN 'T' ELSE 'NA' END"


def _verdict(spark, d, name, truth=False):
    items = views.item(spark, d).select("id")
    return articles.verdicts(items, views.sentence(spark, d), truth).select("id", name)


@register("A1", VERDICT_SQL.format(expr=FOUR, name="verdict4"))
def a1(spark, d):
    return _verdict(spark, d, "verdict4")


@register("A2", VERDICT_SQL.format(
    expr=f"CASE WHEN {F_} = 0 AND {PF_} = 0 AND {T_} > 0 THEN 1 ELSE 0 END", name="verdict_bin_cls"))
def a2(spark, d):
    return _verdict(spark, d, "verdict_bin_cls")


@register("A3", VERDICT_SQL.format(
    expr="CASE WHEN min(s.sentence_class_score_auto) > 0.5 THEN 1 ELSE 0 END", name="verdict_bin_score"))
def a3(spark, d):
    return _verdict(spark, d, "verdict_bin_score")


@register("A4", VERDICT_SQL.format(
    expr="CASE WHEN avg(s.sentence_class_score_auto) > 0.5 THEN 1 ELSE 0 END", name="verdict_bin_mean"))
def a4(spark, d):
    return _verdict(spark, d, "verdict_bin_mean")


@register("A5", VERDICT_SQL.format(
    expr=FOUR.replace("sentence_class_auto", "sentence_class"),
    name="verdict4, CASE WHEN min(CASE WHEN s.sentence_class = 'T' THEN 1 WHEN s.id IS NOT NULL THEN 0 END) > 0.5 THEN 1 ELSE 0 END AS verdict_bin_score"))
def a5(spark, d):
    items = views.item(spark, d).select("id")
    return articles.verdicts(items, views.sentence(spark, d), True).select("id", "verdict4", "verdict_bin_score")


_DEN = "nullif(count(*) FILTER (s.sentence_class_auto IN ('F','PF','T','NA')), 0)"


def _n(cond):
    return f"count(*) FILTER ({cond})"


_COUNTS = {
    "f_count": "s.sentence_class_auto = 'F'", "pf_count": "s.sentence_class_auto = 'PF'", "t_count": "s.sentence_class_auto = 'T'",
    "na_count": "s.sentence_class_auto = 'NA'", "t05_count": "s.sentence_class_score_auto > 0.5",
    "t04_count": "s.sentence_class_score_auto > 0.4", "t00_count": "s.sentence_class_score_auto <= 0.4",
}
A6_SELECT = ", ".join(
    [f"{_n(c)} AS {n}" for n, c in _COUNTS.items()]
    + [f"round(coalesce({_n(c)}::DOUBLE / {_DEN}, 0), 9) AS {n.replace('_count', '_perc')}" for n, c in _COUNTS.items()]
    + ["round(coalesce(sum(s.sentence_class_score_auto), 0), 9) AS score_sum",
       f"round(coalesce(sum(s.sentence_class_score_auto) / {_DEN}, 0), 9) AS score_avg",
       "round(coalesce(sum(s.check_worthy_score_auto), 0), 9) AS cw_sum",
       f"round(coalesce(sum(s.check_worthy_score_auto) / {_DEN}, 0), 9) AS cw_avg"])


def rounded(df, cols, digits=9):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


FEATURE_DOUBLES = [c for c in articles.FEATURES if not c.endswith("_count")]


@register("A6", with_views("item", "sentence") + f"""
SELECT i.id, {A6_SELECT} FROM item i LEFT JOIN sentence s ON s.item_id = i.id AND s.review_level = 9 GROUP BY i.id""")
def a6(spark, d):
    out = articles.item_features(views.item(spark, d).select("id"), views.sentence(spark, d), 9)
    return rounded(out.select("id", *articles.FEATURES), FEATURE_DOUBLES)


@register("A7", with_views("item", "sentence") + """
SELECT i.id, coalesce(max(CASE WHEN l > 0 THEN l END), max(i.review_level)) AS review_level
FROM item i LEFT JOIN (SELECT item_id, CASE WHEN pos % 3 = 0 THEN review_level ELSE review_level - 1 END AS l FROM sentence WHERE pos >= 1) s
  ON s.item_id = i.id GROUP BY i.id""")
def a7(spark, d):
    moved = views.sentence(spark, d).where("pos >= 1").withColumn(
        "review_level", F.when(F.col("pos") % 3 == 0, F.col("review_level")).otherwise(F.col("review_level") - 1))
    return articles.roll_up_level(views.item(spark, d).select("id", "review_level"), moved)


@register("A8", with_views("sentence") + """
SELECT max(new_sentence_id) AS value FROM sentence WHERE review_level = 8
UNION ALL SELECT min(new_sentence_id) FROM sentence WHERE review_level = 8""")
def a8(spark, d):
    s, at8 = views.sentence(spark, d), F.col("review_level") == 8
    return articles.extreme(s, "new_sentence_id", at8).unionByName(articles.extreme(s, "new_sentence_id", at8, ascending=True))


@register("A10", with_views("spo") + """
SELECT lower(predicate) AS predicate, count(*) AS n FROM spo WHERE predicate <> '' GROUP BY 1""")
def a10(spark, d):
    s = views.spo(spark, d).where("predicate <> ''").select(F.lower("predicate").alias("predicate"))
    return counts.predicate_counts(s, "predicate")


WORD_COUNTS_SQL = with_views("words", extra="""
tok AS (SELECT id, k, runs[k] AS word FROM words, LATERAL (SELECT unnest(range(1, len(runs) + 1)) AS k) WHERE length(runs[k]) >= 2),
wc AS (SELECT word, count(*) AS n, min(id * 100000 + k - 1) AS first_seen FROM tok GROUP BY word)""")


@register("A11", WORD_COUNTS_SQL + "SELECT word, n, first_seen FROM wc")
def a11(spark, d):
    wc = counts.word_counts(views.sentence(spark, d), "sentence", 2, ["id"], lower=False)
    first = F.col("first_seen.id") * 100000 + F.col("first_seen.at")
    return wc.select("word", "n", first.alias("first_seen"))


@register("A12", with_views("sentence") + """
, c AS (SELECT sentence_class AS label, count(*) AS n FROM sentence WHERE review_level = 9 GROUP BY 1)
SELECT label, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c""")
def a12(spark, d):
    w = counts.class_weights(views.sentence(spark, d).where("review_level = 9"), "sentence_class")
    return rounded(w.withColumnRenamed("sentence_class", "label"), ["weight"])


@register("A13", with_views("sentence") + """
SELECT least(40, max(len(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '')))) AS budget FROM sentence""")
def a13(spark, d):
    return counts.seq_budget(views.sentence(spark, d), "sentence", 40)


@register("A15", with_views("sentence") + """
SELECT CASE WHEN instance_type = 'Dev' THEN 'test' ELSE 'train' END AS split, check_worthy AS label, count(*) AS n
FROM sentence WHERE NOT skip_validations AND review_level > 4 AND instance_type IN ('Train','Other','Dev') GROUP BY 1, 2""")
def a15(spark, d):
    s = views.sentence(spark, d)
    split = F.when(sentence_selector("cw-train"), "train").when(sentence_selector("cw-test"), "test")
    return counts.dataset_sizes(s.withColumn("split", split).where("split is not null"), "split", "check_worthy").withColumnRenamed("check_worthy", "label")


@register("J6", with_views("item", "sentence") + """
SELECT i.id, s.id AS sentence_id FROM item i LEFT JOIN sentence s ON s.item_id = i.id AND s.review_level = 9""")
def j6(spark, d):
    s = views.sentence(spark, d).where("review_level = 9").select("item_id", F.col("id").alias("sentence_id"))
    return articles.with_sentences(views.item(spark, d).select("id"), s).select("id", "sentence_id")


@register("W2", with_views("item") + """
SELECT id, title, strftime(publication_date, '%Y-%m-%d') AS publication_date, rating, item_class FROM item
ORDER BY item.publication_date DESC, id DESC LIMIT 15""")
def w2(spark, d):
    return articles.latest_items(views.item(spark, d)).select(
        "id", "title", F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), "rating", "item_class")
