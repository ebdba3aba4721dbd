"""Queries: selectors, conditional updates, workflow, ingest joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import materialise
from claimlens.functions import text
from claimlens.operators import articles, ingest, selectors, updates
from claimlens.plans import views
from claimlens.plans.registry import register
from claimlens.plans.views import table, with_views

CORPUS, EXT = "NOT skip_validations", "skip_validations"
ITEM_WHERE = {
    "new": "review_level = 8 AND NOT needs_revision",
    "train": f"{CORPUS} AND review_level = 9 AND instance_type IN ('Train','Other')",
    "dev": f"{CORPUS} AND review_level = 9 AND instance_type = 'Dev'",
    "test": f"{CORPUS} AND review_level = 9 AND instance_type = 'Dev'",
    "skip_val": f"{EXT} AND review_level = 8 AND NOT needs_revision AND instance_type = 'Other'",
    "external": f"{EXT} AND review_level = 9",
    "ct21-test": f"{EXT} AND type = 'src3'",
    "ct21-fr": f"{EXT} AND review_level = 9 AND type = 'src3'",
    "ct21-health": f"{EXT} AND review_level = 9 AND instance_type = 'Health'",
    "corpus-verification": f"{CORPUS} AND review_level = 9 AND NOT needs_revision",
    "recovery": f"{EXT} AND review_level = 9 AND instance_type = 'ReCOVery'",
}
SENTENCE_WHERE = {
    "cw-train": f"{CORPUS} AND review_level > 4 AND instance_type IN ('Train','Other')",
    "cw-test": f"{CORPUS} AND review_level > 4 AND instance_type = 'Dev'",
    "cw-new": "review_level = 3",
    "cw-new-external": f"review_level = 3 AND {EXT}",
    "cw-external": "review_level > 0 AND instance_type = 'Health'",
    "fc-train": f"{CORPUS} AND review_level > 7 AND instance_type IN ('Train','Other')",
    "fc-test": f"{CORPUS} AND review_level > 7 AND instance_type = 'Dev'",
    "fc-new": "review_level = 7 AND instance_type = 'Other'",
    "fc-ct21-fr": "review_level > 7 AND instance_type = 'Health'",
    "fc-external": f"{EXT} AND review_level = 9 AND instance_type = 'Other'",
}


def _union(view, wheres, cols):
    return " UNION ALL ".join(f"SELECT {cols}, '{n}' AS selector FROM {view} WHERE {w}" for n, w in wheres.items())


@register("F1", with_views("item") + _union("item", ITEM_WHERE, "id"))
def f1(spark, d):
    conds = {n: selectors.item_selector(n, test_set="src3") for n in selectors.ITEM_SELECTORS}
    return selectors.matching_selectors(views.item(spark, d), conds).select("id", "selector")


@register("F2", with_views("sentence") + _union("sentence", SENTENCE_WHERE, "id"))
def f2(spark, d):
    conds = {n: selectors.sentence_selector(n) for n in selectors.SENTENCE_SELECTORS}
    return selectors.matching_selectors(views.sentence(spark, d), conds).select("id", "selector")


@register("F3", with_views("item") + """
SELECT id, CASE WHEN type = 'src1' THEN 'renamed' ELSE title END AS title, CASE WHEN type = 'src1' THEN 7 ELSE rating END AS rating FROM item""")
def f3(spark, d):
    out = updates.update_where(views.item(spark, d), F.col("type") == "src1", {"title": F.lit("renamed"), "rating": F.lit(7)})
    return out.select("id", "title", "rating")


@register("F4", with_views("sentence") + f"""
SELECT count(*) AS n, count(*) > 0 AS found FROM sentence WHERE ({SENTENCE_WHERE['cw-new']}) OR ({SENTENCE_WHERE['cw-new-external']})""")
def f4(spark, d):
    either = selectors.sentence_selector("cw-new") | selectors.sentence_selector("cw-new-external")
    return selectors.match_count(views.sentence(spark, d), either)


def _blocked(col, parts):
    return "NOT (" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


def _links(spark, d):
    hosts = ["https://www.facebook.com", "https://news.example.org", "https://cdc.gov", "http://who.int", "https://lab.example.org"]
    tails = ["/a.pdf", "/story", "/x.png", "/download/1", "/y"]
    pick = lambda v, i: F.element_at(F.array(*[F.lit(x) for x in v]), (i + 1).cast("int"))
    page = table(spark, d, "pages")
    n = F.col("page_id")
    return page.select("page_id", F.concat(pick(hosts, n % 5), F.lit("/"), F.col("url"), pick(tails, n % 7 % 5)).alias("link"))


LINKS_SQL = """WITH links AS (SELECT page_id,
  (['https://www.facebook.com','https://news.example.org','https://cdc.gov','http://who.int','https://lab.example.org'])[page_id % 5 + 1]
  || '/' || url || (['/a.pdf','/story','/x.png','/download/1','/y'])[page_id % 7 % 5 + 1] AS link FROM pages)
"""
DOMAINS, FILES = fixed.BLOCKED_DOMAINS, fixed.BLOCKED_FILES


@register("F5", LINKS_SQL + f"SELECT page_id, {_blocked('link', DOMAINS)} AS allowed FROM links")
def f5(spark, d):
    return _links(spark, d).select("page_id", text.url_allowed(F.col("link")).alias("allowed"))


@register("F6", LINKS_SQL + f"SELECT page_id, {_blocked('link', FILES)} AS ok FROM links")
def f6(spark, d):
    return _links(spark, d).select("page_id", text.url_ok(F.col("link")).alias("ok"))


SPO_COLS = ", ".join(updates.SPO_COLUMNS)


@register("F8", with_views("spo") + f"""
SELECT id, {', '.join(f"CASE WHEN review_level <= 8 AND NOT predicate_not_found THEN '' ELSE {c} END AS {c}" for c in updates.SPO_COLUMNS)} FROM spo""")
def f8(spark, d):
    return updates.clear_spos(views.spo(spark, d), 8).select("id", *updates.SPO_COLUMNS)


@register("F9", with_views("spo") + """
SELECT id, predicate_not_found OR (review_level <= 9 AND skip_validations AND check_worthy_auto = 'FR' AND NOT predicate_not_found
  AND (big_subject = '' OR big_predicate = '' OR big_object = '')) AS predicate_not_found FROM spo""")
def f9(spark, d):
    return updates.mark_no_predicate(views.spo(spark, d), 9).select("id", "predicate_not_found")


LEVELS = "CASE WHEN review_level = 9 THEN (pos % 5) + 3 ELSE review_level END"


def _levelled(df):
    """Level-9 sentences spread over levels 3 to 7, so that every transition has rows to move."""
    return df.withColumn("review_level", F.when(F.col("review_level") == 9, (F.col("pos") % 5 + 3).cast("int")).otherwise(F.col("review_level")))


LEVELLED = f", lev AS (SELECT * REPLACE ({LEVELS} AS review_level) FROM spo)\n"
PRELIM = "CASE WHEN review_level = 5 AND {src} = 'FR' AND {side} THEN CASE WHEN rating < 25 THEN 'F' WHEN rating <= 50 THEN 'PF' ELSE 'T' END ELSE sentence_class END"


@register("F10", with_views("rated", "spo") + LEVELLED + f"""
SELECT id, {PRELIM.format(src='check_worthy', side='NOT skip_validations')} AS corpus_class,
  {PRELIM.format(src='check_worthy_auto', side='skip_validations')} AS external_class FROM lev""")
def f10(spark, d):
    s = _levelled(views.spo(spark, d, rated=True)).withColumn("_manual", F.col("sentence_class"))
    s = updates.preliminary_class(s, False).withColumn("corpus_class", F.col("sentence_class")).withColumn("sentence_class", F.col("_manual"))
    return updates.preliminary_class(s, True).select("id", "corpus_class", F.col("sentence_class").alias("external_class"))


@register("F11", with_views("spo") + LEVELLED + """
SELECT id, CASE WHEN review_level = 3 THEN CASE WHEN skip_validations THEN 5 ELSE 4 END ELSE review_level END AS review_level FROM lev""")
def f11(spark, d):
    return updates.advance(_levelled(views.spo(spark, d)), 3, 4, 5).select("id", "review_level")


@register("F12", with_views("spo") + LEVELLED + """
SELECT id, CASE WHEN review_level = 5 AND NOT skip_validations AND check_worthy = 'FR' THEN 6 ELSE review_level END AS review_level,
  CASE WHEN review_level = 5 AND NOT skip_validations AND check_worthy_score_auto >= 0.5 THEN 6 ELSE review_level END AS full_level FROM lev""")
def f12(spark, d):
    s = _levelled(views.spo(spark, d)).withColumn("_l", F.col("review_level"))
    s = updates.advance_to_check(s, 5, 6, full=True).withColumn("full_level", F.col("review_level")).withColumn("review_level", F.col("_l"))
    return updates.advance_to_check(s, 5, 6).select("id", "review_level", "full_level")


FULL_SPO = "big_subject <> '' AND big_predicate <> '' AND big_object <> ''"


@register("F13", with_views("spo") + LEVELLED + f"""
SELECT id, CASE WHEN review_level = 6 AND NOT skip_validations AND check_worthy = 'FR' AND manually_identified_predicate = big_predicate
    AND manually_identified_predicate <> '' THEN 7 ELSE review_level END AS review_level,
  CASE WHEN review_level = 6 AND NOT skip_validations AND check_worthy_score_auto >= 0.5 AND {FULL_SPO} THEN 7 ELSE review_level END AS full_level FROM lev""")
def f13(spark, d):
    s = _levelled(views.spo(spark, d)).withColumn("_l", F.col("review_level"))
    s = updates.advance_completed(s, 6, 7, full=True).withColumn("full_level", F.col("review_level")).withColumn("review_level", F.col("_l"))
    return updates.advance_completed(s, 6, 7).select("id", "review_level", "full_level")


@register("F14", with_views("spo") + LEVELLED + f"""
SELECT id, CASE WHEN review_level = 5 AND skip_validations AND check_worthy_auto = 'FR' AND {FULL_SPO} THEN 7 ELSE review_level END AS review_level FROM lev""")
def f14(spark, d):
    return updates.advance_external(_levelled(views.spo(spark, d)), 5, 7).select("id", "review_level")


@register("F15", with_views("sentence") + """
SELECT id, CASE WHEN review_level = 3 AND skip_validations THEN check_worthy_auto ELSE check_worthy END AS check_worthy,
  CASE WHEN review_level = 3 AND skip_validations THEN health_terms_auto > 0 ELSE health_terms END AS health_terms FROM sentence""")
def f15(spark, d):
    out = updates.fill_external(views.sentence(spark, d), selectors.sentence_selector("cw-new-external"))
    return out.select("id", "check_worthy", "health_terms")


@register("F16", with_views("spo") + LEVELLED + """
SELECT id, 'external' AS mode FROM lev WHERE review_level = 5 AND predicate = '' AND skip_validations AND check_worthy_auto = 'FR' AND NOT predicate_not_found
UNION ALL SELECT id, 'full' FROM lev WHERE review_level = 5 AND predicate = '' AND NOT skip_validations AND check_worthy_score_auto >= 0.5
UNION ALL SELECT id, 'corpus' FROM lev WHERE review_level = 5 AND predicate = '' AND NOT skip_validations AND check_worthy = 'FR'""")
def f16(spark, d):
    conds = {m: updates.spo_pending(5, m) for m in ["external", "full", "corpus"]}
    return selectors.matching_selectors(_levelled(views.spo(spark, d)), conds, "mode").select("id", "mode")


@register("F17", """
SELECT url AS title, 'Claim Review' AS type, CASE WHEN page_id % 3 = 0 THEN '1753-01-01' ELSE '2024-02-01' END AS publication_date, url,
  page_id AS rating, CAST(page_id > 50 AS INTEGER) AS item_class, 0 AS review_level, false AS url_ok, page_id % 2 = 0 AS skip_validations,
  'NA' AS item_class_4_auto, 'Other' AS instance_type, '' AS abstract, CAST(0 AS BIGINT) AS from_item_id FROM pages""")
def f17(spark, d):
    n = F.col("page_id")
    none = F.lit(None).cast("string")
    crawled = table(spark, d, "pages").select(
        F.col("url").alias("title"), F.lit("Claim Review").alias("type"), none.alias("abstract"),
        F.when(n % 3 == 0, "").otherwise("2024-02-01").alias("publication_date"), none.alias("source_entity"), "url",
        *[none.alias(c) for c in ["text", "review_entity", "review_url", "claim", "original_rating", "review_summary"]],
        n.alias("rating"), text.rating_class(n).alias("class"), F.lit("2024-03-01").alias("crawl_date"), (n % 2 == 0).alias("skip_validations"),
        F.lit("F").alias("item_class_4"), *[none.alias(c) for c in ["review_url_2", "review_entity_2", "country", "lang"]])
    return updates.shape_item(crawled, 0).select(
        "title", "type", F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), "url", "rating", "item_class",
        "review_level", "url_ok", "skip_validations", "item_class_4_auto", "instance_type", "abstract", "from_item_id")


STEP_SQL = with_views("item", "spo") + LEVELLED + """
, s5 AS (SELECT * REPLACE (CASE WHEN review_level = 3 THEN CASE WHEN skip_validations THEN 5 ELSE 4 END ELSE review_level END AS review_level) FROM lev),
s7a AS (SELECT * REPLACE (CASE WHEN review_level = 5 AND NOT skip_validations AND check_worthy = 'FR' THEN 6 ELSE review_level END AS review_level) FROM s5),
s7b AS (SELECT * REPLACE (CASE WHEN review_level = 5 AND skip_validations AND check_worthy_auto = 'FR' AND big_subject <> '' AND big_predicate <> ''
  AND big_object <> '' THEN 7 ELSE review_level END AS review_level) FROM s7a),
s7 AS (SELECT * REPLACE (CASE WHEN review_level = 6 AND NOT skip_validations AND check_worthy = 'FR' AND manually_identified_predicate = big_predicate
  AND manually_identified_predicate <> '' THEN 7 ELSE review_level END AS review_level) FROM s7b),
s9 AS (SELECT * REPLACE (CASE WHEN review_level = 7 AND skip_validations THEN 8 ELSE review_level END AS review_level) FROM s7),
i9 AS (SELECT i.* REPLACE (coalesce(m, i.review_level) AS review_level) FROM item i
  LEFT JOIN (SELECT item_id, max(review_level) AS m FROM s9 WHERE review_level > 0 GROUP BY 1) x ON x.item_id = i.id),
v8 AS (SELECT item_id, CASE WHEN count(*) FILTER (sentence_class_auto = 'F') > 0 THEN 'F' WHEN count(*) FILTER (sentence_class_auto = 'PF') > 0 THEN 'PF'
  WHEN count(*) FILTER (sentence_class_auto = 'T') > 0 THEN 'T' ELSE 'NA' END AS v, CASE WHEN min(sentence_class_score_auto) > 0.5 THEN 1.0 ELSE 0.0 END AS b
  FROM s9 WHERE review_level = 8 GROUP BY 1),
i10a AS (SELECT i.* REPLACE (CASE WHEN hit THEN coalesce(v, 'NA') ELSE item_class_4_auto END AS item_class_4_auto,
    CASE WHEN hit THEN CAST(coalesce(b, 0) AS DOUBLE) ELSE item_class_auto END AS item_class_auto)
  FROM (SELECT *, review_level = 8 AND ((skip_validations AND instance_type = 'Other') OR (NOT skip_validations AND instance_type = 'Dev')) AS hit FROM i9) i
  LEFT JOIN v8 ON v8.item_id = i.id),
s10 AS (SELECT * REPLACE (CASE WHEN review_level = 8 THEN 9 ELSE review_level END AS review_level) FROM s9),
i10b AS (SELECT i.* REPLACE (coalesce(m, i.review_level) AS review_level) FROM i10a i
  LEFT JOIN (SELECT item_id, max(review_level) AS m FROM s10 WHERE review_level > 0 GROUP BY 1) x ON x.item_id = i.id),
v9 AS (SELECT item_id, CASE WHEN count(*) FILTER (sentence_class_auto = 'F') > 0 THEN 'F' WHEN count(*) FILTER (sentence_class_auto = 'PF') > 0 THEN 'PF'
  WHEN count(*) FILTER (sentence_class_auto = 'T') > 0 THEN 'T' ELSE 'NA' END AS v, CASE WHEN min(sentence_class_score_auto) > 0.5 THEN 1.0 ELSE 0.0 END AS b
  FROM s10 WHERE review_level = 9 GROUP BY 1)
SELECT i.id, i.review_level,
  CASE WHEN hit9 THEN coalesce(v9.v, 'NA') ELSE item_class_4_auto END AS item_class_4_auto,
  CASE WHEN hit9 THEN CAST(coalesce(v9.b, 0) AS DOUBLE) ELSE item_class_auto END AS item_class_auto
FROM (SELECT *, review_level = 9 AND ((skip_validations AND instance_type = 'Other') OR (NOT skip_validations AND instance_type = 'Dev')) AS hit9 FROM i10b) i
LEFT JOIN v9 ON v9.item_id = i.id"""


@register("F18", STEP_SQL)
def f18(spark, d):
    used = ["item_id", "review_level", "skip_validations", "check_worthy", "check_worthy_auto", "manually_identified_predicate", "big_subject",
            "big_predicate", "big_object", "sentence_class", "sentence_class_auto", "sentence_class_score_auto"]
    items, sentences = views.item(spark, d), materialise(_levelled(views.spo(spark, d)).select(*used), "sentences")
    for step in (5, 7, 9, 10):
        items, sentences = articles.workflow_step(items, sentences, step)
    return items.select("id", "review_level", "item_class_4_auto", "item_class_auto")


@register("J5", with_views("item") + """
SELECT title, review_entity, min(id) AS id FROM item WHERE id % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM item e WHERE e.id % 2 = 0 AND e.title = item.title AND e.review_entity = item.review_entity)
GROUP BY title, review_entity""")
def j5(spark, d):
    items = views.item(spark, d).select("title", "review_entity", "id")
    return ingest.new_rows(items.where("id % 2 = 1"), items.where("id % 2 = 0"), ["title", "review_entity"])


@register("J7", with_views("item", "sentence") + """
SELECT id FROM item WHERE id NOT IN (SELECT item_id FROM sentence WHERE pos >= 5)""")
def j7(spark, d):
    return ingest.pending_items(views.item(spark, d).select("id"), views.sentence(spark, d).where("pos >= 5")).select("id")


@register("J8", with_views("sentence") + """
SELECT id, CASE WHEN item_id % 3 = 0 THEN item_id + 1000000 ELSE item_id END AS item_id FROM sentence""")
def j8(spark, d):
    s = views.sentence(spark, d).select("id", "item_id", F.col("item_id").alias("from_item_id"))
    copies = views.documents(spark, d).where("doc_id % 3 = 0").select(
        (F.col("doc_id") + 1000000).alias("id"), F.col("doc_id").alias("from_item_id"))
    return ingest.relink(s.where("from_item_id > 0"), copies).unionByName(s.where("from_item_id = 0").withColumn(
        "item_id", F.lit(1000000).cast("long"))).select("id", "item_id")


@register("W1", with_views("sentence") + """
SELECT id, 10 + 10 * row_number() OVER (ORDER BY item_id, pos) AS new_sentence_id FROM sentence""")
def w1(spark, d):
    return ingest.number_sentences(views.sentence(spark, d).select("id", "item_id", "pos"), F.lit(10)).select("id", "new_sentence_id")


@register("W6", with_views("sentence") + "SELECT id, sentence FROM sentence ORDER BY item_id, new_sentence_id")
def w6(spark, d):
    return selectors.reading_order(views.sentence(spark, d)).select("id", "sentence")


@register("R2", """
SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id_str, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS in_reply_to_screen_name,
  CASE WHEN turn % 3 = 0 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS quoted_status_id_str, 'NF' AS check_worthy, 0 AS tweet_class,
  false AS needs_revision, 0 AS review_level FROM conversations""")
def r2(spark, d):
    turn = F.col("turn")
    raw = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + turn).cast("string").alias("id_str"), F.when(turn % 2 == 0, F.col("role")).alias("in_reply_to_screen_name"),
        (turn % 3 == 0).alias("is_quote_status"), F.col("conv_id").cast("string").alias("quoted_status_id_str"))
    return ingest.shape_post(raw).drop("is_quote_status")
