"""Queries: graphs and knowledge-graph joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import broadcast_if_small, materialise, settle, shared_path
from claimlens.operators import concepts, graphs, knowledge
from claimlens.operators.selectors import item_selector
from claimlens.plans import views
from claimlens.plans.queries_spo import ALIGN_SQL, enriched, q
from claimlens.plans.registry import register
from claimlens.plans.views import table, with_views
from claimlens.sources import sinks

TERMS_SQL = """, terms AS (SELECT DISTINCT replace(lower(p_name), ' ', '_') AS term FROM part UNION SELECT DISTINCT replace(lower(p_brand), ' ', '_') FROM part)
"""


def terms(spark, d):
    name = lambda c: F.regexp_replace(F.lower(c), " ", "_").alias("term")
    part = table(spark, d, "part")
    return part.select(name("p_name")).union(part.select(name("p_brand"))).distinct()


def _kg_sql(near, far, names, cols):
    allowed = ", ".join(q(n) for n in names)
    return with_views("kg") + TERMS_SQL + f"""SELECT {cols} FROM terms t JOIN kg_nodes a ON a.uri = '/c/en/' || t.term JOIN kg_edges e ON e.{near}_id = a.id
JOIN kg_relations r ON r.id = e.relation_id JOIN kg_nodes b ON b.id = e.{far}_id
WHERE a.uri <> b.uri AND string_split(r.uri, '/')[3] IN ({allowed}) AND string_split(b.uri, '/')[3] = 'en'"""


@register("J2", _kg_sql("start", "end", fixed.SUBJECT_RELATIONS, "t.term, string_split(r.uri, '/')[3] AS predicate, string_split(b.uri, '/')[4] AS object, e.weight"))
def j2(spark, d):
    nodes, relations, edges = views.kg(spark, d)
    return knowledge.kg_objects(terms(spark, d), nodes, edges, relations)


@register("J3", _kg_sql("end", "start", fixed.OBJECT_RELATIONS, "t.term, string_split(b.uri, '/')[4] AS subject, string_split(r.uri, '/')[3] AS predicate, e.weight"))
def j3(spark, d):
    nodes, relations, edges = views.kg(spark, d)
    return knowledge.kg_subjects(terms(spark, d), nodes, edges, relations)


@register("J4", with_views("kg", "sentence") + """
, w AS (SELECT id, lower(string_split(sentence, ' ')[1]) AS term FROM sentence UNION ALL SELECT p_partkey, replace(lower(p_brand), ' ', '_') FROM part)
SELECT id, term, EXISTS (SELECT 1 FROM kg_nodes n WHERE n.uri = '/c/en/' || term) AS known FROM w""")
def j4(spark, d):
    nodes, _, _ = views.kg(spark, d)
    first = views.sentence(spark, d).select("id", F.lower(F.get(F.split("sentence", " "), F.lit(0))).alias("term"))
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.lower("p_brand"), " ", "_").alias("term"))
    return knowledge.kg_exists(first.unionByName(brands), nodes).select("id", "term", "known")


def phrasal(spark, d):
    """Stand-in phrasal verbs: two-word part types, lower-cased."""
    return table(spark, d, "part").select(F.lower("p_type").alias("phrase")).distinct()


def predicate_tokens(df):
    """Tagged tokens of the lower-cased big predicate."""
    base = df.withColumn("_whole", F.col("sentence")).withColumn("sentence", F.lower("big_predicate"))
    return views.tagged(None, None, base).withColumnRenamed("tokens", "p_tokens").drop("sentence").withColumnRenamed("_whole", "sentence")


def tokened(spark, d):
    """SPO sentences whose big predicate is two words long for half of the rows (a negation for some), with its tokens."""
    s = views.spo(spark, d).where("big_predicate <> ''")
    lead = F.element_at(F.array(*[F.lit(w) for w in ["is", "not", "was causing", ""]]), (F.col("pos") % 4 + 1).cast("int"))
    s = s.withColumn("big_predicate", F.trim(F.concat_ws(" ", lead, "predicate")))
    return predicate_tokens(s)


def predicates(spark, d):
    return graphs.norm_predicate(tokened(spark, d), phrasal(spark, d))


def _lemma_sql():
    rows = {}
    for base, *forms in fixed.VERB_FORMS:
        for form in [base, *forms]:
            rows.setdefault(form, base)
    rows.update({f: "be" for f in graphs.BE_FORMS} | {f: "have" for f in graphs.HAVE_FORMS})
    return "lemmas(form, lemma) AS (VALUES " + ", ".join(f"({q(f)}, {q(b)})" for f, b in sorted(rows.items())) + ")"


LEMMAS_SQL = _lemma_sql()
_TAGS = ", ".join(f"list_filter(tokens, lambda t: t.pos = '{t}')[-1].token" for t in fixed.VERB_TAG_PRIORITY)
NORM_SQL = with_views("spo", extra=LEMMAS_SQL) + """
, bp AS (SELECT * EXCLUDE (sentence, big_predicate), sentence AS whole, lower(b) AS sentence, b AS big_predicate FROM (SELECT *,
    trim((['is','not','was causing',''])[pos % 4 + 1] || ' ' || predicate) AS b FROM spo WHERE big_predicate <> '')),
""" + views.TAGGED_SQL.replace("FROM sentence)", "FROM bp)").replace("tagged AS", "ptok AS") + f""",
v AS (SELECT *, coalesce({_TAGS}, '') AS verb0, len(list_filter(string_split_regex(predicate, '\\s+'), lambda w: w <> '')) = 1 AS single,
  len(tokens) > 1 OR len(list_filter(string_split_regex(sentence, '\\s+'), lambda w: w <> '')) > 1 AS several FROM ptok),
u AS (SELECT *, CASE WHEN spo_type IN ('manually id','sentence','clause','quoted text') AND single AND (length(verb0) < 2 OR verb0 <> lower(predicate))
  THEN lower(predicate) ELSE verb0 END AS verb FROM v),
pk AS (SELECT *, CASE WHEN several THEN CASE WHEN verb <> '' THEN verb ELSE coalesce(ph.phrase, list_filter(tokens, lambda t: t.pos = 'NN')[-1].token, '') END
  ELSE array_to_string(list_transform(list_filter(string_split_regex(sentence, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN w = '’re' THEN 'are' ELSE w END), ' ') END AS pick
  FROM u LEFT JOIN (SELECT DISTINCT lower(p_type) AS phrase FROM part) ph ON ph.phrase = lower(u.predicate)),
norm AS (SELECT pk.*, CASE WHEN several AND len(list_filter(tokens, lambda t: t.token IN ('n''t','no','not','t'))) > 0 THEN 'not ' ELSE '' END ||
  CASE WHEN coalesce(l.lemma, pick) = 'be' THEN 'is' ELSE coalesce(l.lemma, pick) END AS norm_p FROM pk LEFT JOIN lemmas l ON l.form = pk.pick)
"""


@register("L1", NORM_SQL + "SELECT id, norm_p FROM norm")
def l1(spark, d):
    return predicates(spark, d).select("id", "norm_p")


NODE_TYPES = ["sem_group", "sem_type", "sem_type_name", "cui", "text_cui", "sem_type_sem_group", "cui_all", "text_cui_all"]


def aligned_spo(spark, d, base=None):
    return concepts.align_concepts(enriched(spark, d, base if base is not None else views.spo(spark, d)))


_LABELS = {
    "sem_group": '"group"', "sem_type": "sem_type", "sem_type_name": "type_name", "cui": "cui", "text_cui": "preferred",
    "sem_type_sem_group": "'[' || sem_type || '][' || \"group\" || ']'", "cui_all": "'[' || cui || '][' || sem_type || '][' || \"group\" || ']'",
    "text_cui_all": "'[' || preferred || '][' || sem_type || '][' || \"group\" || ']'"}
_GROUPS = ", ".join(q(g) for g in fixed.DEFAULT_GROUPS)
KEPT_SQL = f"""
, kept AS (SELECT *, row_number() OVER (PARTITION BY id, part, cui ORDER BY k) AS rn FROM ext WHERE cui <> '[UNK]' AND "group" IN ({_GROUPS}))
"""


def _nodes_sql(kind):
    label = f"'[' || replace({_LABELS[kind]}, '<50', 'Less Than 50') || ']'"
    inner = f"SELECT id, {label} AS label, min(k) AS k FROM kept WHERE rn = 1 AND part = 'o' GROUP BY id, label" if kind in graphs.UNIQUE_TYPES else (
        f"SELECT id, {label} AS label, k FROM kept WHERE rn = 1 AND part = 'o'")
    return f"SELECT id, '{kind}' AS node_type, string_agg(label, ' ' ORDER BY k) AS nodes FROM ({inner}) GROUP BY id"


@register("L2", ALIGN_SQL.replace("{where}", "true") + KEPT_SQL + " UNION ALL ".join(_nodes_sql(k) for k in NODE_TYPES))
def l2(spark, d):
    groups = F.array(*[F.lit(g) for g in fixed.DEFAULT_GROUPS])
    first = settle(aligned_spo(spark, d).select("id", graphs.first_concepts(F.col("o_ext"), groups).alias("first")), "first")
    per_type = F.array(*[F.struct(F.lit(k).alias("node_type"), F.array_join(graphs.node_labels(F.col("first"), k), " ").alias("nodes")) for k in NODE_TYPES])
    return first.where(F.size("first") > 0).select("id", F.inline(per_type)).where("nodes <> ''")


@register("J10", NORM_SQL + """
, rules AS (SELECT DISTINCT predicate AS rp FROM spo WHERE pos = 0)
SELECT id, CASE WHEN rp IS NOT NULL AND norm_p NOT LIKE 'e%' THEN 'CHEM' ELSE '""" + ",".join(fixed.DEFAULT_GROUPS) + """' END AS subject_groups, subject_groups AS object_groups FROM norm
LEFT JOIN (SELECT DISTINCT lower(w) AS rp FROM (SELECT string_split(sentence, ' ')[1] AS w FROM sentence)) r ON r.rp = norm_p""")
def j10(spark, d):
    return graphs.with_valid_groups(predicates(spark, d), group_rules(spark, d)).select("id", *[F.array_join(c, ",").alias(c) for c in ("subject_groups", "object_groups")])


TRIPLE_WHERE = "review_level = 9 AND NOT skip_validations"
# Alignment and predicate names over the same views, and the concepts that the predicate's groups allow.
_VIEWS = with_views("spo", "concept", extra=LEMMAS_SQL)
GRAPH_SQL = (_VIEWS + ALIGN_SQL[len(with_views("spo", "concept")):].replace("{where}", TRIPLE_WHERE) + NORM_SQL[len(with_views("spo", extra=LEMMAS_SQL)):]
             + f"""
, ruled AS (SELECT n.id, n.norm_p, rp IS NOT NULL AND norm_p NOT LIKE 'e%' AS chem FROM norm n LEFT JOIN (SELECT DISTINCT lower(string_split(sentence, ' ')[1]) AS rp FROM sentence) ON rp = norm_p
  WHERE {TRIPLE_WHERE}),
kept AS (SELECT e.*, r.norm_p, chem, row_number() OVER (PARTITION BY e.id, part, cui ORDER BY k) AS rn FROM ext e JOIN ruled r ON r.id = e.id
  WHERE cui <> '[UNK]' AND CASE WHEN chem THEN "group" = 'CHEM' ELSE "group" IN ({_GROUPS}) END)
""")
TRIPLES_SQL = GRAPH_SQL + """
, side AS (SELECT id, item_id, new_sentence_id, sentence_class, norm_p, chem, part, '[' || cui || ']' AS label, k,
  row_number() OVER (PARTITION BY id, part ORDER BY k) - 1 AS n, count(*) OVER (PARTITION BY id, part) AS total FROM kept WHERE rn = 1),
tri AS (SELECT s.id, s.item_id, s.new_sentence_id, s.sentence_class, s.chem, s.label AS s, s.norm_p AS p, o.label AS o, s.n * o.total + o.n AS place
  FROM side s JOIN side o ON o.id = s.id AND o.part = 'o' WHERE s.part = 's')
"""


def group_rules(spark, d):
    """Stand-in predicate rules: the first words of the sentences."""
    first = F.lower(F.get(F.split("sentence", " "), F.lit(0)))
    chem = F.when(first.startswith("e"), F.array().cast("array<string>")).otherwise(F.array(F.lit("CHEM")))
    return views.sentence(spark, d).select(first.alias("predicate"), chem.alias("subject_groups"), chem.alias("object_groups")).distinct()


def graph(spark, d, node_type="cui", brackets=True, rules=None):
    """The sentence graph of finished corpus sentences."""
    s = tokened(spark, d).where("review_level = 9 and not skip_validations")
    return graphs.sentence_graph(aligned_spo(spark, d, s), phrasal(spark, d), group_rules(spark, d) if rules is None else rules, node_type, brackets)


def sentence_triples(spark, d):
    return graphs.triples(graph(spark, d).select("item_id", "new_sentence_id", "sentence_class", "norm_p", "norm_s", "norm_o"))


@register("L3", TRIPLES_SQL + "SELECT item_id, new_sentence_id, sentence_class, s, p, o, place FROM tri")
def l3(spark, d):
    return sentence_triples(spark, d)


MEMBER_SQL = TRIPLES_SQL + """
, mem AS (SELECT item_id, new_sentence_id, sentence_class, place * 4 + j AS place, ([s, s, p, o])[j + 1] AS src,
  CASE WHEN j = 0 THEN p ELSE 'included_in' END AS rel, CASE WHEN j = 0 THEN o ELSE 'item_' || item_id END AS dst FROM tri, range(4) t(j))
"""


@register("L4", MEMBER_SQL + "SELECT * FROM mem")
def l4(spark, d):
    return graphs.with_membership(sentence_triples(spark, d))


@register("L5", MEMBER_SQL + """
, ord AS (SELECT *, row_number() OVER (ORDER BY new_sentence_id, place) AS edge_id FROM mem)
SELECT 'edge' AS kind, edge_id, src AS a, rel AS b, dst AS c, CAST(new_sentence_id AS BIGINT) AS n FROM ord
UNION ALL SELECT 'predicate', NULL, norm_p, NULL, NULL, count(*) FROM norm WHERE review_level = 9 AND NOT skip_validations GROUP BY 3""")
def l5(spark, d):
    edges = graphs.number_edges(materialise(graphs.with_membership(sentence_triples(spark, d)), "edges"))
    none = F.lit(None).cast("string")
    report = graphs.predicate_report(graph(spark, d))
    return edges.select(F.lit("edge").alias("kind"), "edge_id", F.col("src").alias("a"), F.col("rel").alias("b"), F.col("dst").alias("c"),
                        F.col("new_sentence_id").alias("n")).unionByName(
        report.select(F.lit("predicate").alias("kind"), F.lit(None).cast("long").alias("edge_id"), F.col("norm_p").alias("a"), none.alias("b"), none.alias("c"), "n"))


def topic_edges(spark, d):
    topics = graphs.topic_graph(views.item(spark, d).where(item_selector("graph")))
    return topics.withColumn("key", F.col("src").cast("long"))


TOPIC_SQL = with_views("item") + r"""
, topic AS (SELECT id AS key, CAST(id AS VARCHAR) AS src, item_class_4 AS rel, t[k] AS dst, k - 1 AS place FROM (
  SELECT id, item_class_4, regexp_extract_all(main_topic, '\[([^\]]*)\]', 1) AS t FROM item WHERE NOT skip_validations AND review_level > 0),
  LATERAL (SELECT unnest(range(1, len(t) + 1)) AS k))
"""


@register("L6", TOPIC_SQL + """
SELECT node, min(o) AS first_seen FROM (SELECT src AS node, (key * 10 + place) * 2 AS o FROM topic UNION ALL SELECT dst, (key * 10 + place) * 2 + 1 FROM topic) GROUP BY node""")
def l6(spark, d):
    return graphs.nodes(topic_edges(spark, d), F.col("key") * 10 + F.col("place"))


@register("L7", TOPIC_SQL + "SELECT row_number() OVER (ORDER BY key, place) AS edge_id, src, rel, dst FROM topic")
def l7(spark, d):
    return graphs.number_edges(topic_edges(spark, d), key="key").select("edge_id", "src", "rel", "dst")


@register("L8", with_views("item", extra=LEMMAS_SQL) + r"""
, c AS (SELECT id, item_class_4, regexp_extract_all(main_claim, '\[([^\]]*)\]', 1) AS x FROM item WHERE NOT skip_validations AND review_level > 0)
SELECT id AS item_id, item_class_4, x[1] AS src, coalesce(lemma, x[2]) AS rel, x[3] AS dst FROM c LEFT JOIN lemmas ON form = x[2]""")
def l8(spark, d):
    return graphs.claim_graph(views.item(spark, d).where(item_selector("graph")))


@register("L9", TOPIC_SQL + "SELECT src, rel, dst FROM topic")
def l9(spark, d):
    return topic_edges(spark, d).select("src", "rel", "dst")


@register("L10", TOPIC_SQL + "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM topic UNION ALL SELECT dst FROM topic) GROUP BY node")
def l10(spark, d):
    return graphs.degree(topic_edges(spark, d))


@register("L11", with_views("kg") + f"""
, nm AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE 'o' END AS side,
  CASE WHEN p_partkey % 2 = 0 THEN replace(lower(p_name), ' ', '_') ELSE replace(lower(p_brand), ' ', '_') END AS term FROM part),
hit AS (SELECT e.*, string_split(r.uri, '/')[3] AS predicate FROM kg_edges e JOIN kg_relations r ON r.id = e.relation_id WHERE start_id <> end_id)
SELECT id, side, term, predicate, string_split(end_id, '/')[4] AS related, weight FROM nm JOIN hit ON side = 's' AND start_id = '/c/en/' || term
  WHERE predicate IN ({', '.join(q(n) for n in fixed.SUBJECT_RELATIONS)}) AND end_id LIKE '/c/en/%'
UNION ALL SELECT id, side, term, predicate, string_split(start_id, '/')[4], weight FROM nm JOIN hit ON side = 'o' AND end_id = '/c/en/' || term
  WHERE predicate IN ('IsA','Synonym') AND start_id LIKE '/c/en/%'""")
def l11(spark, d):
    nodes, relations, edges = views.kg(spark, d)
    key = F.col("p_partkey")
    part = table(spark, d, "part")
    words = F.split(F.when(key % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")), " ")
    whole = F.array_join(words, "_")
    names = part.select(key.alias("id"), F.when(key % 2 == 0, "s").otherwise("o").alias("side"), whole.alias("name"))
    return knowledge.related(names, ["id"], nodes, edges, relations)


@register("L12", with_views("spo", "item", "kg") + """
SELECT s.id, s.item_id, s.id AS sentence_id, strftime(i.publication_date, '%Y-%m-%d') AS publication_date, big_subject AS subject, predicate, big_object AS object,
  sentence_class, check_worthy AS sentence_check_worthy, i.item_class_4, s.instance_type, sentence_class_score_auto AS score,
  EXISTS (SELECT 1 FROM kg_nodes n WHERE n.uri = '/c/en/' || replace(lower(trim(big_subject)), ' ', '_'))
  AND EXISTS (SELECT 1 FROM kg_nodes n WHERE n.uri = '/c/en/' || replace(lower(trim(big_object)), ' ', '_')) AS exist_so_in_kb
FROM spo s JOIN item i ON i.id = s.item_id WHERE big_subject <> '' AND predicate <> '' AND big_object <> ''""")
def l12(spark, d):
    nodes, _, _ = views.kg(spark, d)
    out = knowledge.triple_table(views.spo(spark, d), views.item(spark, d), nodes)
    return out.withColumn("publication_date", F.date_format("publication_date", "yyyy-MM-dd"))


@register("W5", NORM_SQL + "SELECT norm_p, count(*) AS n, min(id) AS first_seen FROM norm GROUP BY 1 ORDER BY n DESC, first_seen")
def w5(spark, d):
    per = predicates(spark, d).groupBy("norm_p").agg(F.count("*").alias("n"), F.min("id").alias("first_seen"))
    return graphs.top_predicates(per)


@register("T26", TRIPLES_SQL + """
, st AS (SELECT id, string_agg(preferred, ' ' ORDER BY k) FILTER (part = 's') AS s, string_agg(preferred, ' ' ORDER BY k) FILTER (part = 'o') AS o FROM kept WHERE rn = 1 GROUP BY id)
SELECT p.id, coalesce(s, '') || ' [SEP] ' || norm_p || ' [SEP] ' || coalesce(o, '') AS t FROM norm p LEFT JOIN st ON st.id = p.id
WHERE review_level = 9 AND NOT skip_validations""")
def t26(spark, d):
    parts = [F.array_join("norm_s", " "), F.col("norm_p"), F.array_join("norm_o", " ")]
    return graph(spark, d, "text_cui", brackets=False).select("id", F.concat_ws(f" {fixed.SEPARATOR} ", *parts).alias("t"))


_GROUP_TEXT = f"CASE WHEN chem THEN 'CHEM' ELSE '{','.join(fixed.DEFAULT_GROUPS)}' END"
_TRIPLE_COLUMNS = ["layout", "item_id", "sentence_id", "subject", "predicate", "object", "subject_groups", "object_groups"]


@register("S15", TRIPLES_SQL + f"""
, lab AS (SELECT id, string_agg(label, ' ' ORDER BY k) FILTER (part = 's') AS s, string_agg(label, ' ' ORDER BY k) FILTER (part = 'o') AS o FROM side GROUP BY id)
SELECT 'by token' AS layout, item_id, id AS sentence_id, s AS subject, p AS predicate, o AS object, {_GROUP_TEXT} AS subject_groups, {_GROUP_TEXT} AS object_groups FROM tri
UNION ALL SELECT 'joined', item_id, n.id, coalesce(CASE WHEN j = 0 THEN big_subject ELSE s END, ''), norm_p, coalesce(CASE WHEN j = 0 THEN big_object ELSE o END, ''), '', ''
  FROM norm n LEFT JOIN lab USING (id), range(2) t(j) WHERE {TRIPLE_WHERE}""")
def s15(spark, d):
    """The triple file in both layouts, written and read back."""
    rules = broadcast_if_small(materialise(group_rules(spark, d), "rules"))
    both, path = graphs.triple_rows(graph(spark, d, rules=rules), by_token=None), shared_path(spark, "triples")
    names = _TRIPLE_COLUMNS
    sinks.export_triples(both.select(*[F.coalesce(c, F.lit("")).alias(c) if c in ("subject", "object") else F.col(c) for c in names]), path)
    cut = F.split("value", "\t", -1)
    lines = spark.read.text(path).where(F.col("value") != "\t".join(names))  # each file has the header
    return lines.select(*[cut[i].cast("long" if c.endswith("_id") else "string").alias(c) for i, c in enumerate(names)])
