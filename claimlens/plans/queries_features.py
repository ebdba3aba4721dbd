"""Queries: vocabularies, encodings, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import articles, counts, encoding
from claimlens.operators.selectors import item_selector, sentence_selector
from claimlens.plans import views
from claimlens.plans.queries_articles import A6_SELECT, FEATURE_DOUBLES, WORD_COUNTS_SQL, rounded
from claimlens.plans.queries_updates import ITEM_WHERE, SENTENCE_WHERE
from claimlens.plans.registry import register
from claimlens.plans.views import table, with_views

WORD = r"'[\p{L}\p{N}_]+'"


def vocabulary(spark, d):
    return counts.word_counts(views.sentence(spark, d), "sentence", 2, ["id"])


RANK = "row_number() OVER (ORDER BY n DESC, first_seen)"


@register("W3", WORD_COUNTS_SQL + "SELECT word, n FROM wc ORDER BY n DESC, first_seen LIMIT 500")
def w3(spark, d):
    return counts.top_vocab(vocabulary(spark, d), 500).select("word", "n")


@register("W4", WORD_COUNTS_SQL + f"SELECT '<UNK>' AS word, 1 AS word_id UNION ALL SELECT word, {RANK} + 1 FROM wc QUALIFY {RANK} < 1000")
def w4(spark, d):
    return counts.word_index(vocabulary(spark, d), 1000)


# General corpus = conversations; corpus = sentences of the training selection.
CHAT_SQL = f"""chat AS (SELECT word, count(*) AS n, min(o * 1000000 + k) AS first_seen FROM (SELECT conv_id * 1000 + turn AS o, k, r[k] AS word FROM (
  SELECT conv_id, turn, regexp_extract_all(text, {WORD}) AS r FROM conversations), LATERAL (SELECT unnest(range(1, len(r) + 1)) AS k) WHERE length(r[k]) >= 2) GROUP BY word),
common AS (SELECT word, {RANK} AS word_id FROM chat QUALIFY {RANK} <= 200),
tr AS (SELECT word, count(*) AS n, min(id * 100000 + k) AS first_seen FROM (SELECT id, k, r[k] AS word FROM (
  SELECT id, regexp_extract_all(sentence, {WORD}) AS r FROM sentence WHERE {SENTENCE_WHERE['fc-train']}), LATERAL (SELECT unnest(range(1, len(r) + 1)) AS k)
  WHERE length(r[k]) >= 2) GROUP BY word)"""


@register("V2", with_views("sentence", extra=CHAT_SQL) + f"""
SELECT 'common' AS kind, word, word_id AS n FROM common
UNION ALL (SELECT 'corpus', word, n FROM tr WHERE word NOT IN (SELECT word FROM common) ORDER BY n DESC, first_seen LIMIT 500)
UNION ALL SELECT 'posts', word, n FROM chat""")
def v2(spark, d):
    conv = table(spark, d, "conversations").withColumn("o", F.col("conv_id") * 1000 + F.col("turn"))
    chat = counts.word_counts(conv, "text", 2, ["o"])
    common = counts.common_vocab(chat, 200)
    train = counts.word_counts(views.sentence(spark, d).where(sentence_selector("fc-train")), "sentence", 2, ["id"])
    row = lambda df, kind, n: df.select(F.lit(kind).alias("kind"), "word", F.col(n).cast("long").alias("n"))
    return row(common, "common", "word_id").unionByName(row(counts.corpus_vocab(train, common, 500), "corpus", "n")).unionByName(row(chat, "posts", "n"))


@register("V1", with_views("sentence") + f"""
SELECT split, id, sentence AS text, list_position(['NA','F','PF','T'], sentence_class) - 1 AS label FROM (
  SELECT *, 'train' AS split FROM sentence WHERE {SENTENCE_WHERE['fc-train']} UNION ALL SELECT *, 'test' FROM sentence WHERE {SENTENCE_WHERE['fc-test']})""")
def v1(spark, d):
    return encoding.fc_dataset(views.sentence(spark, d))


_KNOWN_SQL = r"array_to_string(list_filter(string_split_regex({c}, '\s+'), lambda t: t <> '' AND t <> '[UNK]'), ' ')"
_CONCEPTS_SQL = " || ' [SEP] ' || ".join(_KNOWN_SQL.format(c=c) for c in ("subject || ' [UNK] ' || subject", "predicate", "object"))


@register("V1_concepts", with_views("spo") + f"""
SELECT split, id, {_CONCEPTS_SQL} AS text, list_position(['NA','F','PF','T'], sentence_class) - 1 AS label FROM (
  SELECT *, 'train' AS split FROM spo WHERE {SENTENCE_WHERE['fc-train']} UNION ALL SELECT *, 'test' FROM spo WHERE {SENTENCE_WHERE['fc-test']})""")
def v1_concepts(spark, d):
    """The same rows with concept text; the stand-in concepts are the SPO words, with an unknown one among the subject's."""
    s = views.spo(spark, d).withColumns({"subject_cuis": F.concat(F.col("subject"), F.lit(" [UNK] "), F.col("subject")), "predicate_cuis": F.col("predicate"), "object_cuis": F.col("object")})
    return encoding.fc_dataset(s, cuis=True)


@register("V3", with_views("item") + f"""
, r AS (SELECT 'train' AS split, id, text FROM item WHERE {ITEM_WHERE['train']} UNION ALL SELECT 'test', id, text FROM item WHERE {ITEM_WHERE['dev']}),
tok AS (SELECT split, id, unnest(regexp_extract_all(lower(text), {WORD})) AS term FROM r),
tf AS (SELECT split, id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY 1),
raw AS (SELECT split, id, term, tf * (ln((1 + (SELECT count(*) FROM r WHERE split = 'train'))::DOUBLE / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term))
SELECT split, id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY split, id)), 9) AS weight FROM raw""")
def v3(spark, d):
    items = views.item(spark, d).select("id", "text", "skip_validations", "review_level", "instance_type")
    return rounded(encoding.tfidf(items.where(item_selector("train")), items.where(item_selector("dev")), "id", "text"), ["weight"])


INDEX_SQL = WORD_COUNTS_SQL + f"""
, idx AS (SELECT word, CAST({RANK} + 1 AS INTEGER) AS word_id FROM wc QUALIFY {RANK} < 1000)
"""


def index(spark, d):
    return counts.word_index(vocabulary(spark, d), 1000)


def _ids_sql(name, source, col, limit, keys="id"):
    cut = f"[1:{limit}]" if limit else ""
    return f""", {name} AS (SELECT b.{keys}, coalesce(list(coalesce(i.word_id, 1) ORDER BY k) FILTER (k IS NOT NULL), []) AS ids FROM (SELECT id, regexp_extract_all({col}, {WORD}){cut} AS r FROM {source}) b
  LEFT JOIN LATERAL (SELECT unnest(range(1, len(b.r) + 1)) AS k) ON true LEFT JOIN idx i ON i.word = b.r[k] GROUP BY b.id)
"""


@register("V4", INDEX_SQL + _ids_sql("s", "sentence", "sentence", 40) + """
SELECT id, array_to_string(ids || list_transform(range(40 - len(ids)), lambda x: 0), ' ') AS ids FROM s""")
def v4(spark, d):
    return encoding.sequences(views.sentence(spark, d), ["id"], "sentence", index(spark, d), 40, lower=False).select(
        "id", F.array_join("ids", " ").alias("ids"))


@register("A14", INDEX_SQL + _ids_sql("s", "sentence", "sentence", 40) + "SELECT max(len(ids)) AS max_seq_len FROM s")
def a14(spark, d):
    return counts.max_seq_len(encoding.sequences(views.sentence(spark, d), ["id"], "sentence", index(spark, d), 40, lower=False))


START, SEP = 1001, 1002


def _show(df, c):
    return df.select("id", *[F.array_join(F.col(f"{c}.{f}"), " ").alias(f) for f in ("ids", "mask", "segments")])


def _frame_sql(parts, max_len):
    """SQL lists for ids, mask and segments of framed parts [(list expression, segment)]."""
    ids = " || ".join([f"[{START}]"] + [f"{p} || [{SEP}]" for p, _ in parts])
    seg = " || ".join(["[0]"] + [f"list_transform({p} || [{SEP}], lambda x: {s})" for p, s in parts])
    pad = lambda e: f"array_to_string(({e}) || list_transform(range({max_len} - len({ids})), lambda x: 0), ' ')"
    return f"{pad(ids)} AS ids, {pad(f'list_transform({ids}, lambda x: 1)')} AS mask, {pad(seg)} AS segments"


@register("V5", INDEX_SQL + _ids_sql("s", "sentence", "sentence", 24) + f"""
SELECT id, {_frame_sql([('t', 0)], 24)} FROM (SELECT id, ids[1:22] AS t FROM s)""")
def v5(spark, d):
    t = encoding.token_ids(views.sentence(spark, d), ["id"], "sentence", index(spark, d), 24, lower=False)
    return _show(t.withColumn("e", encoding.encode_text(F.col("ids"), 24, START, SEP)), "e")


SPO_IDS_SQL = INDEX_SQL.replace("WITH ", "WITH ", 1) + ", " + views.SPO_SQL + _ids_sql("si", "spo", "big_subject", None) + _ids_sql("pi", "spo", "big_predicate", None) + _ids_sql("oi", "spo", "big_object", None) + """
, parts AS (SELECT si.id, si.ids AS s, pi.ids AS p, oi.ids AS o FROM si JOIN pi USING (id) JOIN oi USING (id))
"""


def spo_ids(spark, d):
    """(id, s, p, o): word ids of the three SPO parts, from one pass over the sentences."""
    # no frame holds more than 24 ids, and lengths beyond that do not change how parts share it
    return encoding.part_ids(views.spo(spark, d), ["id"], {"s": "big_subject", "p": "big_predicate", "o": "big_object"}, index(spark, d), 24, lower=False)


@register("V6", SPO_IDS_SQL + f"""
, l AS (SELECT *, greatest(20 - len(p), 0) AS b FROM parts),
k AS (SELECT *, CASE WHEN len(s) + len(o) <= b OR len(s) <= ceil(b / 2) THEN len(s) WHEN len(o) <= floor(b / 2) THEN b - len(o) ELSE CAST(ceil(b / 2) AS BIGINT) END AS ks,
  CASE WHEN len(s) + len(o) <= b THEN len(o) WHEN len(s) <= ceil(b / 2) THEN b - len(s) WHEN len(o) <= floor(b / 2) THEN len(o) ELSE CAST(floor(b / 2) AS BIGINT) END AS ko FROM l)
SELECT id, {_frame_sql([('s1', 0), ('p1', 1), ('o1', 0)], 24)} FROM (SELECT id, s[1:ks] AS s1, p[1:20] AS p1, o[1:ko] AS o1 FROM k)""")
def v6(spark, d):
    e = encoding.encode_spo_variable(F.col("s"), F.col("p"), F.col("o"), 24, START, SEP)
    return _show(spo_ids(spark, d).withColumn("e", e), "e")


@register("V7", SPO_IDS_SQL + f"""
SELECT id, {_frame_sql([('s1', 0), ('p1', 1), ('o1', 0)], 24)} FROM (SELECT id, s[1:6] || list_transform(range(6 - len(s)), lambda x: 1) AS s1,
  p[1:8] || list_transform(range(8 - len(p)), lambda x: 1) AS p1, o[1:6] || list_transform(range(6 - len(o)), lambda x: 1) AS o1 FROM parts)""")
def v7(spark, d):
    e = encoding.encode_spo_fixed(F.col("s"), F.col("p"), F.col("o"), 24, START, SEP)
    return _show(spo_ids(spark, d).withColumn("e", e), "e")


TESTS = ["dev", "test", "external", "ct21-test", "ct21-fr", "ct21-health"]


@register("V8", with_views("item") + " UNION ALL ".join(
    f"SELECT '{t}' AS test_set, '{s}' AS split, id, text, CAST(item_class_4 = 'T' AS INTEGER) AS label FROM item WHERE {w}"
    for t in TESTS for s, w in (("train", ITEM_WHERE["train"]), ("test", ITEM_WHERE[t]))))
def v8(spark, d):
    items = views.item(spark, d)
    out = None
    for t in TESTS:
        one = encoding.fd_dataset(items, t, binary=True, test_set="src3").withColumn("test_set", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


PICKED_SQL = f""", pick AS (SELECT 'train' AS split, * FROM item WHERE {ITEM_WHERE['train']} UNION ALL SELECT 'test', * FROM item WHERE {ITEM_WHERE['dev']})
"""


@register("V9", with_views("item", "sentence") + PICKED_SQL + f"""
SELECT split, i.id, list_position(['NA','F','PF','T'], any_value(item_class_4)) - 1 AS label, {A6_SELECT} FROM pick i
LEFT JOIN sentence s ON s.item_id = i.id AND s.review_level = 9 GROUP BY split, i.id""")
def v9(spark, d):
    out = encoding.fd_feature_dataset(views.item(spark, d), views.sentence(spark, d), "dev")
    return rounded(out.select("split", "id", "label", *articles.FEATURES), FEATURE_DOUBLES)


@register("V17", with_views("item", "sentence") + PICKED_SQL + f"""
SELECT split, i.id, any_value(i.text) AS text, CAST(any_value(item_class_4) = 'T' AS INTEGER) AS label, {A6_SELECT} FROM pick i
LEFT JOIN sentence s ON s.item_id = i.id AND s.review_level = 9 GROUP BY split, i.id""")
def v17(spark, d):
    out = encoding.combined_dataset(views.item(spark, d), views.sentence(spark, d), "dev", binary=True)
    return rounded(out.select("split", "id", "text", "label", *articles.FEATURES), FEATURE_DOUBLES)
