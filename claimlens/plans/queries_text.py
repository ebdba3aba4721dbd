"""Queries: scalar text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.functions import tagged, text
from claimlens.operators import ingest, texts
from claimlens.plans import views
from claimlens.plans.queries_scans import TSV_CLEAN_SQL
from claimlens.plans.registry import register
from claimlens.plans.views import table, with_views

# Documents with paragraph marks, literal backslash pairs, quotes and symbols put in by rule.
MARKED = r"""concat('“', replace(replace(text, chr(10), '<annotate_paragraph>'), ', ', concat(',', r'\n', ' ')), '.” End ☂ of “x”. Won’t they''re & can''t')"""
MARKED_SQL = r"""'“' || replace(replace(text, chr(10), '<annotate_paragraph>'), ', ', ',\n ') || '.” End ☂ of “x”. Won’t they''re & can''t'"""


def marked(spark, d):
    return views.documents(spark, d).select("doc_id", F.expr(MARKED).alias("text"))


def _sql(expr: str, name: str) -> str:
    return f"SELECT doc_id, {expr.replace('TEXT', '(' + MARKED_SQL + ')')} AS {name} FROM documents"


def _paragraph_sql(p):
    p = rf"replace(replace({p}, '\n', ' '), '\t', ' ')"
    p = rf"regexp_replace({p}, '\s\s+', ' ', 'g')"
    return rf"regexp_replace({p}, '\.” ([A-Z])', '.”. \1', 'g')"


T3_LIST = rf"""flatten(list_transform(string_split({{text}}, '<annotate_paragraph>'), lambda p:
  list_transform(list_filter(list_transform(regexp_extract_all({_paragraph_sql('p')}, '[^.!?\n]+[.!?”]*'), lambda x: trim(x)), lambda x: x <> ''),
    lambda s: regexp_replace(s, '\.”.', '.”', 'g'))))"""


@register("T3", "SELECT doc_id, pos - 1 AS pos, s[pos] AS sentence FROM (SELECT doc_id, " + T3_LIST.format(text="(" + MARKED_SQL + ")") + """ AS s FROM documents),
LATERAL (SELECT unnest(range(1, len(s) + 1)) AS pos)""")
def t3(spark, d):
    return marked(spark, d).select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))


@register("T4", with_views("item", "sentence") + ", g AS (SELECT id AS item_id, skip_validations, rating, " + T3_LIST.format(text="text") + """ AS s FROM item
  WHERE review_level = 1),
n AS (SELECT item_id, skip_validations, rating, s[k] AS sentence, k - 1 AS pos FROM g, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k))
SELECT item_id, pos, sentence, rating, CASE WHEN skip_validations THEN 3 ELSE 2 END AS review_level, 'NA' AS check_worthy,
  (SELECT max(new_sentence_id) FROM sentence WHERE review_level = 9) + 10 * row_number() OVER (ORDER BY item_id, pos) AS new_sentence_id FROM n""")
def t4(spark, d):
    old = views.sentence(spark, d).where("review_level = 9")
    new, _ = ingest.generate_sentences(views.item(spark, d), old, 1)
    return new.select("item_id", "pos", "sentence", "rating", "review_level", "check_worthy", "new_sentence_id")


@register("T4_items", with_views("item") + """
SELECT id, CASE WHEN review_level = 1 THEN CASE WHEN skip_validations THEN 3 ELSE 2 END ELSE review_level END AS review_level FROM item""")
def t4_items(spark, d):
    old = views.sentence(spark, d).where("review_level = 9")
    return ingest.generate_sentences(views.item(spark, d), old, 1)[1].select("id", "review_level")


@register("T5", _sql(r"regexp_replace(TEXT, '\p{So}', '', 'g')", "t"))
def t5(spark, d):
    return marked(spark, d).select("doc_id", text.strip_symbols(F.col("text")).alias("t"))


@register("T6", _sql(TSV_CLEAN_SQL.format(c="TEXT"), "t"))
def t6(spark, d):
    return marked(spark, d).select("doc_id", text.tsv_clean(F.col("text")).alias("t"))


def _decontract_sql(e):
    for found, put in fixed.CONTRACTIONS:
        e = "replace({}, '{}', '{}')".format(e, found.replace("'", "''"), put.replace("'", "''"))
    return e


T7_SQL = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\n+', '. ', 'g'), '[^A-Za-z0-9?'' .,-]+', ' ', 'g'), ' +', ' ', 'g'))"


@register("T7", _sql(_decontract_sql("TEXT"), "decontracted, " + T7_SQL.format(_decontract_sql("(" + MARKED_SQL + ")")) + " AS cleaned"))
def t7(spark, d):
    return marked(spark, d).select("doc_id", text.decontract(F.col("text")).alias("decontracted"), text.clean_document(F.col("text")).alias("cleaned"))


STOPS = ", ".join(f"'{w}'" for w in views.STOP_WORDS)
WORD = r"'[\p{L}\p{N}_]+'"


@register("T8", _sql(f"array_to_string(list_filter(regexp_extract_all(TEXT, {WORD}), lambda w: lower(w) NOT IN ({STOPS})), ' ')", "t"))
def t8(spark, d):
    return marked(spark, d).select("doc_id", text.remove_stop_words(F.col("text"), views.STOP_WORDS).alias("t"))


@register("T9", with_views("sentence") + r"""
, q AS (SELECT id, CASE WHEN pos % 4 = 0 THEN 'He said "' || sentence || '" today' WHEN pos % 4 = 1 THEN '“' || sentence || '” “b”'
  WHEN pos % 4 = 2 THEN '“curly” and "" and "x"' || sentence ELSE sentence END AS t FROM sentence)
SELECT id, coalesce(regexp_extract_all(t, '"(.*?)"', 1)[1], regexp_extract_all(t, '“(.*?)”', 1)[1], '') AS quoted FROM q""")
def t9(spark, d):
    s, pos = F.col("sentence"), F.col("pos")
    t = (F.when(pos % 4 == 0, F.concat(F.lit('He said "'), s, F.lit('" today'))).when(pos % 4 == 1, F.concat(F.lit("“"), s, F.lit("” “b”")))
         .when(pos % 4 == 2, F.concat(F.lit('“curly” and "" and "x"'), s)).otherwise(s))
    return views.sentence(spark, d).select("id", text.quoted(t).alias("quoted"))


@register("T10", _sql(f"array_to_string(list_filter(regexp_extract_all(lower(TEXT), {WORD}), lambda w: length(w) >= 3), '|')", "words"))
def t10(spark, d):
    return marked(spark, d).select("doc_id", F.array_join(text.words(F.col("text"), True, 3), "|").alias("words"))


@register("T11", with_views("tagged") + """
, k AS (SELECT id, list_transform(list_filter(tokens, lambda t: (t.pos = 'NNP' OR t.dep = 'nsubj') AND NOT t.is_stop),
  lambda t: CASE WHEN t.pos = 'NNP' THEN t.token ELSE lower(t.token) END) AS w FROM tagged)
SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS key_terms FROM k""")
def t11(spark, d):
    return views.tagged(spark, d).select("id", text.key_terms(F.col("tokens")).alias("key_terms"))


CODES_SQL = """array_to_string(list_transform(tokens, lambda t: CASE WHEN t.pos IN ('DT','PP$') THEN 'D' WHEN t.pos LIKE 'JJ%' THEN 'J'
  WHEN t.pos LIKE 'NN%' THEN 'N' WHEN t.pos = 'IN' THEN 'P' ELSE 'O' END), '')"""


@register("T12", with_views("tagged") + f"""
, c AS (SELECT id, tokens, regexp_extract_all({CODES_SQL}, '{tagged.CHUNK}|.') AS pieces FROM tagged WHERE len(tokens) > 0),
p AS (SELECT id, tokens, pieces, k, length(array_to_string(pieces[:k - 1], '')) AS start FROM c, LATERAL (SELECT unnest(range(1, len(pieces) + 1)) AS k))
SELECT id, k - 1 AS chunk_id, contains(pieces[k], 'N') AS is_chunk, start, start + length(pieces[k]) - 1 AS "end",
  array_to_string(list_transform(tokens[start + 1:start + length(pieces[k])], lambda t: t.token), ' ') AS text FROM p""")
def t12(spark, d):
    return tagged.noun_chunks(views.tagged(spark, d, fields=("token", "pos"))).select("id", F.inline("chunks"))


@register("T13", with_views("tagged") + f"""
, c AS (SELECT id, tokens, regexp_extract_all(replace({CODES_SQL}, 'J', 'N'), 'N+|[^N]+') AS runs FROM tagged WHERE len(tokens) > 0),
p AS (SELECT id, list_transform(tokens[length(array_to_string(runs[:k - 1], '')) + 1:length(array_to_string(runs[:k], ''))], lambda t: t.token) AS w
  FROM c, LATERAL (SELECT unnest(range(1, len(runs) + 1)) AS k) WHERE runs[k] LIKE 'NN%'),
n AS (SELECT id, array_to_string(w, '_') AS name FROM p
  UNION ALL SELECT id, array_to_string(w[a:a + b - 1], '_') FROM p, LATERAL (SELECT unnest(range(1, len(w))) AS a), LATERAL (SELECT unnest(range(2, len(w))) AS b)
  WHERE a + b - 1 <= len(w))
SELECT id, name, count(*) AS n FROM n GROUP BY 1, 2""")
def t13(spark, d):
    names = tagged.multiword_names(views.tagged(spark, d), ["id"])
    return names.groupBy("id", "name").agg(F.count("*").alias("n"))


@register("T14", "SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages")
def t14(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@register("T15", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1753-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS bullet_date,
  CASE WHEN o_orderkey % 5 = 0 THEN '1753-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS lead_date FROM orders""")
def t15(spark, d):
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "MMMM d, yyyy")
    bullet = F.when(key % 3 == 0, "By someone • no date").otherwise(F.concat(F.lit("By a • b • "), day))
    lead = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Published "), F.date_format("o_orderdate", "d MMMM yyyy")))
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", show(text.pub_date(bullet, "bullet")).alias("bullet_date"),
                                            show(text.pub_date(lead, "lead")).alias("lead_date"))


@register("T16", with_views("item") + r"""
SELECT id, array_to_string(regexp_extract_all(main_claim, '\[([^\]]*)\]', 1), '|') AS claim_parts FROM item""")
def t16(spark, d):
    return views.item(spark, d).select("id", F.array_join(text.bracket_list(F.col("main_claim")), "|").alias("claim_parts"))


@register("T17", with_views("sentence") + r"""
SELECT item_id, string_agg(sentence || CASE WHEN regexp_matches(sentence, '[\p{L}\p{N}]$') THEN '.' ELSE '' END || chr(10), '' ORDER BY new_sentence_id) AS text
FROM sentence GROUP BY item_id""")
def t17(spark, d):
    return texts.item_text(views.sentence(spark, d))


# Markup chunks: the pages' HTML as the text element of a dump page; every fifth page is a redirect.
def _dump(spark, d):
    redirect = F.when(F.col("page_id") % 5 == 0, "#REDIRECT [[Other]] <br>").otherwise("[[File:x.png|thumb|20px|A [[link|word]]]] {{t|x}} ")
    return table(spark, d, "pages").select("page_id", F.concat(
        F.lit('<page><title>t</title><text xml:space="preserve">intro &lt;ref>'), redirect, F.col("html"), F.lit("</text></page>")).alias("dump"))


def _wiki_sql(e):
    for pattern, put in fixed.MARKUP_RULES:
        e = f"regexp_replace({e}, '{pattern}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return f"regexp_replace(' ' || {e} || ' ', '[^A-Za-z0-9]+', ' ', 'g')"


@register("T18", r"""WITH dump AS (SELECT page_id, '<page><title>t</title><text xml:space="preserve">intro &lt;ref>' ||
  CASE WHEN page_id % 5 = 0 THEN '#REDIRECT [[Other]] <br>' ELSE '[[File:x.png|thumb|20px|A [[link|word]]]] {{t|x}} ' END || html || '</text></page>' AS dump FROM pages),
el AS (SELECT page_id, unnest(regexp_extract_all(dump, '(?s)<text .*?</text>')) AS e FROM dump),
ch AS (SELECT page_id, regexp_extract_all(e, '[^>]*>') AS c FROM el),
cut AS (SELECT page_id, c, coalesce(list_position(list_transform(c, lambda x: contains(lower(x), '#redirect')), true), 0) AS r FROM ch)
SELECT page_id, array_to_string(list_transform(CASE WHEN r > 0 THEN c[:r - 1] ELSE c END, lambda x: """ + _wiki_sql("x") + """), '|') AS lines FROM cut""")
def t18(spark, d):
    return _dump(spark, d).select("page_id", F.array_join(text.wiki_text(F.col("dump")), "|").alias("lines"))


CUT = 250000


@register("T19", f"""
SELECT doc_id, CASE WHEN before + strlen(text) <= {CUT} THEN text
  ELSE left(text, list_max(list_filter(range(0, length(text) + 1), lambda k: strlen(left(text, k)) <= {CUT} - before))) END AS text FROM (
  SELECT doc_id, text, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM documents) WHERE before < {CUT}""")
def t19(spark, d):
    return texts.head_bytes(views.documents(spark, d).select("doc_id", "text"), "doc_id", "text", CUT)


@register("T20", _sql(r"regexp_replace(replace(replace(substring(TEXT, 1, 50), '\n', ' '), '\t', ' '), '\s\s+', ' ', 'g')", "t"))
def t20(spark, d):
    return marked(spark, d).select("doc_id", text.preview(F.col("text")).alias("t"))


METER, LABEL = list(fixed.METER_RATINGS) + ["unheard of"], list(fixed.LABEL_RATINGS) + ["Brand New"]
METER_NUM = [r for r, _ in fixed.METER_RATINGS.values()] + [-1]
LABEL_NUM = [r for r, _ in fixed.LABEL_RATINGS.values()] + [0]
METER_CLS = [c for _, c in fixed.METER_RATINGS.values()] + ["F"]
LABEL_CLS = [c for _, c in fixed.LABEL_RATINGS.values()] + ["F"]


def _rated(spark, d):
    pick = lambda v, i: F.element_at(F.array(*[F.lit(x) for x in v]), (i + 1).cast("int"))
    doc = F.col("doc_id")
    source = F.when(doc % 2 == 0, "meter").otherwise("label")
    label = F.when(doc % 2 == 0, pick(METER, (doc / 2).cast("long") % len(METER))).otherwise(pick(LABEL, (doc / 2).cast("long") % len(LABEL)))
    return views.documents(spark, d).select("doc_id", source.alias("source"), label.alias("label"))


def _pick_sql(meter, label):
    return f"CASE WHEN doc_id % 2 = 0 THEN ({meter})[(doc_id // 2) % {len(METER)} + 1] ELSE ({label})[(doc_id // 2) % {len(LABEL)} + 1] END"


@register("T21", f"SELECT doc_id, {_pick_sql(METER_NUM, LABEL_NUM)} AS rating, {_pick_sql(METER_CLS, LABEL_CLS)} AS class FROM documents")
def t21(spark, d):
    r = text.normalise_rating(F.col("label"), F.col("source"))
    return _rated(spark, d).select("doc_id", r["rating"].alias("rating"), r["class"].alias("class"))


@register("T22", f"SELECT doc_id, CAST({_pick_sql(METER_NUM, LABEL_NUM)} > 50 AS INTEGER) AS item_class FROM documents")
def t22(spark, d):
    r = text.normalise_rating(F.col("label"), F.col("source"))
    return _rated(spark, d).select("doc_id", text.rating_class(r["rating"]).alias("item_class"))


@register("T23", with_views("sentence") + """
SELECT id, list_position(['NA','NF','FNR','FRC','FR'], check_worthy) - 1 AS code, CAST(check_worthy = 'FR' AS INTEGER) AS binary_code,
  check_worthy AS label, 5 AS classes FROM sentence""")
def t23(spark, d):
    c = F.col("check_worthy")
    code = text.encode_class(c, fixed.CHECK_WORTHY_CLASSES)
    return views.sentence(spark, d).select(
        "id", code.alias("code"), text.encode_class(c, fixed.CHECK_WORTHY_CLASSES, True).alias("binary_code"),
        text.decode_class(code, fixed.CHECK_WORTHY_CLASSES).alias("label"), F.lit(text.class_count(fixed.CHECK_WORTHY_CLASSES)).alias("classes"))


@register("T24", with_views("sentence") + """
, s AS (SELECT id, [1 - sentence_class_score_auto, sentence_class_score_auto, check_worthy_score_auto] AS v FROM sentence)
SELECT id, round(exp(v[2]) / (exp(v[1]) + exp(v[2]) + exp(v[3])), 9) AS p1, list_position(v, list_max(v)) - 1 AS class FROM s""")
def t24(spark, d):
    v = F.array(1 - F.col("sentence_class_score_auto"), F.col("sentence_class_score_auto"), F.col("check_worthy_score_auto"))
    return views.sentence(spark, d).select("id", F.round(text.softmax_p1(v), 9).alias("p1"), text.argmax(v).alias("class"))


@register("T27", with_views("item") + """
SELECT id, replace(title || ' <50 & ' || type, '<50', 'Less Than 50') AS label, replace(title || ' <50 & ' || type, '&', 'and') AS xml_label FROM item""")
def t27(spark, d):
    c = F.concat(F.col("title"), F.lit(" <50 & "), F.col("type"))
    return views.item(spark, d).select("id", text.fix_label(c).alias("label"), text.xml_label(c).alias("xml_label"))


@register("T28", with_views("kg") + """
SELECT uri, string_split(uri, '/')[3] AS lang, string_split(uri, '/')[4] AS term FROM kg_nodes
UNION ALL SELECT DISTINCT r.uri, NULL, string_split(r.uri, '/')[3] FROM kg_edges e JOIN kg_relations r ON r.id = e.relation_id""")
def t28(spark, d):
    nodes, relations, edges = views.kg(spark, d)
    used = relations.join(edges.select(F.col("relation_id").alias("id")).distinct(), "id", "left_semi")
    p = text.kg_parts(F.col("uri"))
    return nodes.select("uri", p["lang"].alias("lang"), p["term"].alias("term")).unionByName(
        used.select("uri", F.lit(None).cast("string").alias("lang"), p["relation"].alias("term")))
