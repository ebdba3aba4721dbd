"""Queries: page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.cluster import spread
from claimlens.functions import text
from claimlens.plans.queries_updates import DOMAINS, FILES, _blocked
from claimlens.plans.registry import register
from claimlens.plans.views import table


def pages(spark, d):
    return spread(table(spark, d, "pages"), "page_id")


SHOWN = rf"regexp_replace(html, '{text.HIDDEN}', '', 'g')"


def _visible_sql(e):
    for name, char in text.ENTITIES:
        quoted = char.replace("'", "''")
        e = f"replace({e}, '{name}', '{quoted}')"
    return e


@register("T1", rf"""
WITH p AS (SELECT page_id, string_split(regexp_replace({SHOWN}, '(?i)<({text.BLOCK_TAGS})(\s[^>]*)?>', chr(1), 'g'), chr(1))[2:] AS pieces FROM pages),
b AS (SELECT page_id, list_filter(list_transform(pieces, lambda x: trim(regexp_replace({_visible_sql(
    rf"regexp_replace(string_split_regex(x, '(?i)</({text.BLOCK_TAGS})\s*>')[1], '{text.ANY_TAG}', '', 'g')")}, '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM p)
SELECT page_id, array_to_string(blocks, '<annotate_paragraph>') AS blocks FROM b""")
def t1(spark, d):
    return pages(spark, d).select("page_id", F.array_join(text.page_blocks(F.col("html")), "<annotate_paragraph>").alias("blocks"))


@register("T2", f"SELECT page_id, {_visible_sql(f'''regexp_replace({SHOWN}, '{text.ANY_TAG}', '', 'g')''')} AS text FROM pages")
def t2(spark, d):
    return pages(spark, d).select("page_id", text.page_text(F.col("html")).alias("text"))


@register("W10", rf"""
SELECT page_id, coalesce(list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), lambda u: {_blocked('u', DOMAINS)} AND {_blocked('u', FILES)})[1], '') AS link
FROM pages""")
def w10(spark, d):
    return pages(spark, d).select("page_id", text.first_link(F.col("html")).alias("link"))
