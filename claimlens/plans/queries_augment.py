"""Queries: training variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import augment
from claimlens.plans import views
from claimlens.plans.registry import register
from claimlens.plans.views import with_views

# A deterministic stand-in for a translation model: the text in reverse.
TRANSFORM = lambda c: F.reverse(c)
LEVEL = "CASE WHEN s.pos % 3 = 0 THEN 9 WHEN s.pos % 3 = 1 THEN 5 ELSE 3 END"
COPY_SQL = with_views("item", "spo") + f"""
, src AS (SELECT * FROM item WHERE NOT skip_validations AND review_level = 9 AND instance_type = 'Train'),
cp AS (SELECT s.*, {LEVEL} AS lv FROM spo s WHERE item_id IN (SELECT id FROM src)),
tr AS (SELECT *, CASE WHEN lv IN (9, 5) THEN reverse(trim(sentence)) ELSE '' END AS ts, CASE WHEN lv = 9 THEN reverse(trim(big_subject)) ELSE '' END AS tsub,
  CASE WHEN lv = 9 THEN reverse(trim(predicate)) ELSE '' END AS tp, CASE WHEN lv = 9 THEN reverse(trim(big_object)) ELSE '' END AS tob,
  CASE WHEN new_sentence_id = 0 THEN 0 ELSE (SELECT max(new_sentence_id) FROM spo) + 10 * sum(CASE WHEN new_sentence_id <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY new_sentence_id) END AS nid FROM cp),
it AS (SELECT *, (SELECT max(id) FROM item) + row_number() OVER (ORDER BY CASE WHEN id = 0 THEN 1 ELSE 0 END, id) AS new_id FROM src WHERE id <> 0)
"""


def variants(spark, d):
    pos = F.col("pos")
    s = views.spo(spark, d).withColumn("review_level", F.when(pos % 3 == 0, 9).when(pos % 3 == 1, 5).otherwise(3))
    return augment.augment(views.item(spark, d), s, TRANSFORM, "RV")


@register("B1", COPY_SQL + """
SELECT it.new_id AS item_id, tr.id AS from_sentence_id, tr.item_id AS from_item_id, CAST(nid AS BIGINT) AS new_sentence_id, ts AS sentence, tsub AS big_subject, tp AS predicate,
  tob AS big_object, CASE WHEN lv = 5 THEN 5 ELSE 7 END AS review_level, tr.instance_type || '_RV' AS instance_type FROM tr JOIN it ON it.id = tr.item_id""")
def b1(spark, d):
    _, s = variants(spark, d)
    return s.select("item_id", "from_sentence_id", "from_item_id", "new_sentence_id", "sentence", "big_subject", "predicate", "big_object",
                    "review_level", "instance_type")


@register("B1_items", COPY_SQL + r"""
, tx AS (SELECT item_id, regexp_replace(string_agg(ts, chr(10) ORDER BY pos), '^\n+', '') AS text FROM tr GROUP BY item_id)
SELECT it.new_id AS id, it.id AS from_item_id, coalesce(tx.text, '') AS text, 7 AS review_level, it.instance_type || '_RV' AS instance_type, it.item_class_4
FROM it LEFT JOIN tx ON tx.item_id = it.id""")
def b1_items(spark, d):
    items, _ = variants(spark, d)
    return items.select("id", "from_item_id", "text", "review_level", "instance_type", "item_class_4")
