"""Queries: predicate lexicon, claim extraction, concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.functions import text
from claimlens.operators import concepts, extraction, lexicon, parsed
from claimlens.plans import views
from claimlens.plans.registry import register
from claimlens.plans.views import with_views


def q(s):
    return "'" + s.replace("'", "''") + "'"


def sql_list(values):
    return "[" + ", ".join(q(v) for v in values) + "]"


def _lexicon_sql():
    """The lexicon by SQL: the same word lists unnested shape by shape."""
    forms = ", ".join(f"({no}, {q(b)}, {q(t)}, {q(i)}, {q(p)})" for no, (b, t, i, p) in enumerate(fixed.VERB_FORMS))
    parts, offset = [], 0
    for lead, modified, joint, form in fixed.PHRASE_SHAPES:
        leads, mods = fixed.LEADS[lead], fixed.MODIFIERS if modified else [""]
        parts.append(f"""SELECT no * {len(lexicon.phrase_patterns())} + {offset} + (l - 1) * {len(mods)} + m - 1 AS priority, 'given long' AS kind,
  concat_ws(' ', ({sql_list(leads)})[l], nullif(({sql_list(mods)})[m], ''){', ' + q(joint) if joint else ''}, "{form}") AS phrase
  FROM verbs, range(1, {len(leads) + 1}) a(l), range(1, {len(mods) + 1}) b(m)""")
        offset += len(leads) * len(mods)
    base = len(fixed.VERBS) * len(lexicon.phrase_patterns())
    for i, form in enumerate(fixed.SHORT_FORMS):
        parts.append(f"SELECT {base} + no * 4 + {i}, 'given short', \"{form}\" FROM verbs")
    parts.append(f"SELECT {base + 4 * len(fixed.VERBS)}, 'given short', 'became'")
    return f"""verbs(no, base, third, ing, past) AS (VALUES {forms}),
lexicon AS MATERIALIZED ({' UNION ALL '.join(parts)})"""


SIZE = len(fixed.VERBS) * len(lexicon.phrase_patterns()) + 4 * len(fixed.VERBS) + 1
LEXICON_SQL = _lexicon_sql()


def injected(spark, d, lex, rated=False):
    """Sentences; every third one gets a lexicon phrase (chosen by id) put between its two halves."""
    s = views.sentence(spark, d, rated).withColumn("_no", F.when(F.col("id") % 3 == 0, F.col("id") % SIZE))
    s = s.join(F.broadcast(lex.select(F.col("priority").alias("_no"), F.col("phrase").alias("_phrase"))), "_no", "left")
    half = F.floor(F.length("sentence") / 2).cast("int")
    left, right = F.substring(F.col("sentence"), F.lit(1), half), F.expr("substring(sentence, floor(length(sentence) / 2) + 1)")
    mixed = F.when(F.col("_phrase").isNotNull(), F.concat_ws(" ", left, F.col("_phrase"), right)).otherwise(F.col("sentence"))
    return s.withColumn("sentence", mixed).drop("_no", "_phrase")


INJECTED_SQL = f"""{LEXICON_SQL},
mixed AS (SELECT s.* REPLACE (CASE WHEN l.phrase IS NOT NULL THEN left(sentence, CAST(length(sentence) // 2 AS BIGINT)) || ' ' || l.phrase || ' ' || substring(sentence, length(sentence) // 2 + 1)
  ELSE sentence END AS sentence), l.phrase AS put, l.kind AS put_kind FROM sentence s LEFT JOIN lexicon l ON s.id % 3 = 0 AND l.priority = s.id % {SIZE})"""


@register("P1", with_views("sentence", extra=INJECTED_SQL) + """SELECT l.phrase, l.kind, l.priority, count(s.id) AS n FROM lexicon l
LEFT JOIN sentence s ON s.id % 3 = 0 AND l.priority = s.id % """ + str(SIZE) + " GROUP BY 1, 2, 3")
def p1(spark, d):
    """The whole lexicon, and how many sentences take each phrase."""
    s = views.sentence(spark, d).where("id % 3 = 0").groupBy((F.col("id") % SIZE).alias("priority")).agg(F.count("*").alias("n"))
    return lexicon.build_lexicon(spark).join(s, "priority", "left").select("phrase", "kind", "priority", F.coalesce("n", F.lit(0)).alias("n"))


def match_sql(source, lex, where="true"):
    """Best phrase per sentence of ``source`` against ``lex``: substrings over 1 to 6 word runs, leftmost place, then priority."""
    return rf"""ready AS (SELECT id, sentence, replace(lower(sentence), '’', '''') AS t FROM {source} WHERE {where}),
runs AS (SELECT id, sentence, t, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS r, string_split_regex(t, '[\p{{L}}\p{{N}}_]+') AS g FROM ready),
marks AS (SELECT id, sentence, t, len(r) AS n, k, length(array_to_string(g[:k], '')) + length(array_to_string(r[:k - 1], '')) AS at0, r[k] AS w,
  r, g FROM runs, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS k) WHERE r[k] IN ({', '.join(q(w) for w in lexicon.first_words())})),
grams AS (SELECT id, sentence, at0, substring(t, at0 + 1, length(array_to_string(g[k + 1:k + j - 1], '')) + length(array_to_string(r[k:k + j - 1], ''))) AS phrase
  FROM marks, LATERAL (SELECT unnest(range(1, {lexicon.longest_phrase() + 1})) AS j) WHERE k + j - 1 <= n),
hits AS (SELECT gr.id, gr.sentence, l.phrase, min_by(l.kind, l.priority) AS kind, min(l.priority) AS priority, min(at0) AS at0
  FROM grams gr JOIN {lex} l ON l.phrase = gr.phrase GROUP BY 1, 2, 3),
best AS (SELECT id, min_by(struct_pack(phrase := phrase, kind := kind, at0 := at0, sentence := sentence), priority) AS m FROM hits
  WHERE at0 > 0 AND at0 + length(phrase) < length(sentence) GROUP BY id)
SELECT id, m.kind AS spo_type, left(m.sentence, m.at0) AS big_subject, m.phrase AS predicate, substring(m.sentence, m.at0 + length(m.phrase) + 1) AS big_object FROM best"""


@register("J9", with_views("sentence", extra=INJECTED_SQL) + ", " + match_sql("mixed", "lexicon").replace(
    match_sql("mixed", "lexicon").split("\n")[-1], 'SELECT id, m.kind AS kind, m.phrase AS phrase, m.at0 AS "at" FROM best'))
def j9(spark, d):
    lex = lexicon.build_lexicon(spark)
    return lexicon.match_lexicon(injected(spark, d, lex), lex)


@register("P2", with_views("sentence", extra=INJECTED_SQL) + ", " + match_sql("mixed", "lexicon"))
def p2(spark, d):
    lex = lexicon.build_lexicon(spark)
    out = lexicon.spo_given(injected(spark, d, lex), lex)
    return out.where("predicate <> ''").select("id", "spo_type", "big_subject", "predicate", "big_object")


BE_HAVE = [f"{m} be" for m in fixed.MODAL_AUX] + fixed.CONTINUOUS_AUX + fixed.PERFECT_AUX
BE_HAVE_SQL = f"behave AS (SELECT ({sql_list(BE_HAVE)})[i] AS phrase, 'be-have' AS kind, i AS priority FROM range(1, {len(BE_HAVE) + 1}) t(i))"


@register("P6", with_views("sentence", extra=f"{INJECTED_SQL}, {BE_HAVE_SQL}") + ", " + match_sql(
    "mixed", "behave", r"len(list_filter(string_split_regex(sentence, '\s+'), lambda x: x <> '')) <= 40"))
def p6(spark, d):
    lex = lexicon.build_lexicon(spark)
    out = lexicon.spo_be_have(injected(spark, d, lex))
    return out.where("predicate <> ''").select("id", "spo_type", "big_subject", "predicate", "big_object")


@register("P7", with_views("spo") + r"""
, m AS (SELECT id, sentence, manually_identified_predicate AS p, lower(manually_identified_predicate) AS lp, replace(lower(sentence), '’', '''') AS t FROM spo
  WHERE review_level = 9 AND NOT skip_validations AND check_worthy = 'FR' AND manually_identified_predicate <> big_predicate),
b AS (SELECT *, CASE WHEN regexp_matches(lp, '^[\p{L}\p{N}_]') THEN '(|.*?[^\p{L}\p{N}_])' ELSE '(.*?[\p{L}\p{N}_])' END AS pre,
  CASE WHEN regexp_matches(lp, '[\p{L}\p{N}_]$') THEN '([^\p{L}\p{N}_]|$)' ELSE '[\p{L}\p{N}_]' END AS post FROM m),
f AS (SELECT *, '(?s)^' || pre || regexp_escape(lp) || post AS re FROM b),
r AS (SELECT *, CASE WHEN regexp_matches(t, re) THEN length(regexp_extract(t, re, 1)) ELSE -1 END AS at0 FROM f)
SELECT id, left(sentence, at0) AS big_subject, p AS predicate, substring(sentence, at0 + length(p) + 1) AS big_object FROM r
WHERE at0 > 0 AND at0 + length(p) < length(sentence)""")
def p7(spark, d):
    s = views.spo(spark, d)
    out = lexicon.spo_manual(s.withColumn("spo_type", F.lit("")), lexicon.manual_pending(9, "corpus"))
    return out.where("spo_type = 'manually id'").select("id", "big_subject", "predicate", "big_object")


UPOS_SQL = """CASE WHEN t.pos LIKE 'VB%' THEN 'VERB' WHEN t.pos = 'NNP' THEN 'PROPN' WHEN t.pos = 'NN' THEN 'NOUN' WHEN t.pos = 'JJ' THEN 'ADJ'
  WHEN t.pos = 'RB' THEN 'PART' WHEN t.pos = 'DT' THEN 'DET' ELSE 'ADP' END"""


def dep_sql(source, keep):
    """Dependency rows (keep, i, text, upos, is_root, head = root) of a tagged source."""
    return f"""dep AS (SELECT {keep}, i, tokens[i].token AS text, tokens[i].pos AS pos, root, i = root AS is_root
  FROM {source}, LATERAL (SELECT unnest(range(1, len(tokens) + 1)) AS i))"""


def parsed_sql(source, keep, clause=False):
    """Reading of one parsed text per ``keep``; the stand-in parse hangs every word on the root."""
    need = "AND bool_or(is_root AND pos LIKE 'VB%')" if clause else ""
    return f"""{dep_sql(source, keep)},
heads AS (SELECT {keep}, max(i) FILTER (NOT is_root AND pos LIKE 'NN%' AND i < root) AS s, max(root) AS p,
  max(i) FILTER (NOT is_root AND pos LIKE 'NN%' AND i > root) AS o,
  least(min(i) FILTER (pos = 'RB' AND NOT is_root), max(root)) AS low, greatest(max(i) FILTER (pos = 'RB' AND NOT is_root), max(root)) AS high
  FROM dep GROUP BY {keep} HAVING s IS NOT NULL AND o IS NOT NULL {need}),
read AS (SELECT {', '.join('h.' + k.strip() for k in keep.split(','))},
  max(text) FILTER (i = s) AS subject, max(text) FILTER (i = p) AS predicate, max(text) FILTER (i = o) AS object,
  CASE WHEN max(s) < max(low) AND max(high) < max(o) THEN coalesce(string_agg(text, ' ' ORDER BY i) FILTER (NOT is_root AND i < low), '') ELSE '' END AS big_subject,
  coalesce(string_agg(text, ' ' ORDER BY i) FILTER (is_root OR pos = 'RB'), '') AS big_predicate,
  CASE WHEN max(s) < max(low) AND max(high) < max(o) THEN coalesce(string_agg(text, ' ' ORDER BY i) FILTER (NOT is_root AND i > high), '') ELSE '' END AS big_object
  FROM dep d JOIN heads h ON {' AND '.join(f'd.{k.strip()} = h.{k.strip()}' for k in keep.split(','))} GROUP BY {', '.join('h.' + k.strip() for k in keep.split(','))})"""


@register("P3", with_views("parsed", extra=parsed_sql("parsed", "id")) + "SELECT * FROM read")
def p3(spark, d):
    return parsed.spo_parsed(views.parsed(spark, d)).where("spo is not null").select("id", "spo.*")


@register("P4", with_views("parsed", extra=parsed_sql("parsed", "id", clause=True)) + "SELECT * FROM read")
def p4(spark, d):
    return parsed.spo_clause(views.parsed(spark, d)).where("spo is not null").select("id", "spo.*")


def parse_parts(parts):
    """Stand-in parser: rule-based tags and heads for each part."""
    return views.parsed(None, None, parts.withColumnRenamed("part", "sentence"))


QUOTED_SQL = """q AS (SELECT id, CASE WHEN pos % 5 = 0 THEN 'He said "' || sentence || '" today' ELSE sentence END AS sentence FROM sentence),
parts AS (
  SELECT id, 0 AS part_no, CASE WHEN regexp_matches(sentence, '"') THEN 'quoted text' ELSE 'sentence' END AS kind,
    coalesce(regexp_extract_all(sentence, '"(.*?)"', 1)[1], sentence) AS part FROM q
  UNION ALL SELECT id, k, 'clause', c[k] FROM (SELECT id, string_split(sentence, ',') AS c FROM q), LATERAL (SELECT unnest(range(1, len(c) + 1)) AS k))"""


def _parts_tagged():
    tag = views.TAGGED_SQL.replace("FROM sentence)", "FROM (SELECT id, part_no, kind, part AS sentence FROM parts))")
    return tag + ",\n" + views.PARSED_SQL


P5_SQL = with_views("sentence", extra=f"{QUOTED_SQL},\n{_parts_tagged()},\n{parsed_sql('parsed', 'id, part_no, kind')}") + """
, usable AS (SELECT r.* FROM read r JOIN parsed p USING (id, part_no, kind) WHERE r.kind <> 'clause' OR p.root0_verb),
f AS (SELECT id, min_by(u, part_no) AS m FROM (SELECT id, part_no, struct_pack(kind := kind, subject := subject, predicate := predicate, object := object,
  big_subject := big_subject, big_predicate := big_predicate, big_object := big_object) AS u FROM usable) GROUP BY id)
SELECT id, m.kind AS spo_type, m.subject AS subject, m.predicate AS predicate, m.object AS object, m.big_subject AS big_subject,
  m.big_predicate AS big_predicate, m.big_object AS big_object FROM f"""
P5_SQL = P5_SQL.replace("SELECT * EXCLUDE (root0), CASE", "SELECT * EXCLUDE (root0), root0 > 0 AS root0_verb, CASE")


def quoted_sentences(spark, d):
    s = F.col("sentence")
    return views.sentence(spark, d).withColumn("sentence", F.when(F.col("pos") % 5 == 0, F.concat(F.lit('He said "'), s, F.lit('" today'))).otherwise(s))


@register("P5", P5_SQL)
def p5(spark, d):
    parts = parsed.reading_parts(quoted_sentences(spark, d).select("id", "sentence"))
    return parsed.spo_cascade(parse_parts(parts))


def enriched(spark, d, base=None, where=None):
    """Sentences with enriched ``candidates`` (stand-in semantic types)."""
    types = views.sem_types(spark)
    lookup = concepts.type_finder(types.select("abbr", "tui", "type_name"), types.select("tui", "group"))
    return concepts.enrich_nested(views.concept_spans(spark, d, base, where), "raw", lookup).withColumnRenamed("raw", "candidates")


@register("J1", with_views("concept") + 'SELECT id, candidate_no, cui, sem_type, tui, type_name, "group" FROM concept')
def j1(spark, d):
    flat = views.concept_spans(spark, d).select("id", F.inline("raw"))
    types = views.sem_types(spark)
    return concepts.enrich_concepts(flat, types.select("abbr", "tui", "type_name"), types.select("tui", "group")).select(
        "id", "candidate_no", "cui", "sem_type", "tui", "type_name", "group")


CLINICAL = f"""(tui IN ({', '.join(q(t) for t in fixed.CLINICAL_TUIS)}) OR "group" = 'DISO')"""


@register("F7", with_views("concept") + f"SELECT id, candidate_no, {CLINICAL} AS clinical FROM concept")
def f7(spark, d):
    c = enriched(spark, d).select("id", F.inline("candidates"))
    return c.select("id", "candidate_no", text.sem_ok(F.col("tui"), F.col("group")).alias("clinical"))


@register("A9", with_views("concept") + f"""
, t AS (SELECT id, "group" || ' ' || tui AS term, min(candidate_no) AS first FROM concept WHERE {CLINICAL} GROUP BY 1, 2)
SELECT s.id, coalesce(string_agg(term, chr(10) ORDER BY first), '') AS common_health_terms, CAST(count(term) AS INTEGER) AS health_terms_auto
FROM sentence s LEFT JOIN t ON t.id = s.id GROUP BY s.id""")
def a9(spark, d):
    out = concepts.health_terms(enriched(spark, d))
    return out.select("id", F.array_join("common_health_terms", "\n").alias("common_health_terms"), "health_terms_auto")


# Token k of the sentence covers characters [a, b); its concept is the last one that starts inside. This holds for
# sentences whose words are separated by single blanks, as all given ones are; other texts are tested by hand.
ALIGN_SQL = with_views("spo", "concept") + """
, tok AS (SELECT id, item_id, new_sentence_id, sentence_class, k, w[k] AS token, a, a + length(w[k]) AS b, len(string_split(big_subject, ' ')) AS ns FROM (
  SELECT id, item_id, new_sentence_id, sentence_class, w, k, big_subject, length(array_to_string(w[:k - 1], ' ')) + CASE WHEN k > 1 THEN 1 ELSE 0 END AS a
  FROM (SELECT id, item_id, new_sentence_id, sentence_class, string_split(sentence, ' ') AS w, big_subject FROM spo WHERE big_subject <> '' AND {where}
        AND id IN (SELECT id FROM concept)), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k))),
ext AS (SELECT t.id, any_value(item_id) AS item_id, any_value(new_sentence_id) AS new_sentence_id, any_value(sentence_class) AS sentence_class, t.k,
  CASE WHEN k = 1 THEN 's' WHEN k = 2 THEN 'p' ELSE 'o' END AS part, any_value(t.token) AS token,
  coalesce(max_by(c.cui, c.start_pos), '[UNK]') AS cui, coalesce(max_by(c.preferred, c.start_pos), '[UNK]') AS preferred,
  coalesce(max_by(c.sem_type, c.start_pos), '[UNK]') AS sem_type, coalesce(max_by(c.type_name, c.start_pos), '[UNK]') AS type_name,
  coalesce(max_by(c."group", c.start_pos), '[UNK]') AS "group"
  FROM tok t LEFT JOIN (SELECT id AS cid, start_pos, cui, preferred, sem_type, type_name, "group" FROM concept) c
    ON c.cid = t.id AND c.start_pos >= t.a AND c.start_pos < t.b GROUP BY t.id, t.k)
"""


@register("P8", ALIGN_SQL.replace("{where}", "true") + 'SELECT id, part, k - 1 AS token_id, token AS token_text, cui, "group" FROM ext')
def p8(spark, d):
    out = concepts.align_concepts(enriched(spark, d, views.spo(spark, d)))
    part = lambda name, ext: F.transform(ext, lambda t: t.withField("part", F.lit(name)))
    tokens = F.concat(part("s", "s_ext"), part("p", "p_ext"), part("o", "o_ext"))
    return out.select("id", F.inline(tokens)).select("id", "part", "token_id", "token_text", "cui", "group")


P9_SQL = ALIGN_SQL.replace("{where}", "review_level = 9 AND NOT skip_validations AND check_worthy = 'FR'") + """
SELECT s.id, {cols} FROM spo s LEFT JOIN ext e ON e.id = s.id GROUP BY s.id"""
P9_SQL = P9_SQL.replace("{cols}", ", ".join(
    f"coalesce(string_agg({f}, ' ' ORDER BY k) FILTER (part = '{p}'), CASE WHEN any_value(s.review_level) = 9 AND NOT any_value(s.skip_validations) THEN '' ELSE 'old' END) AS {n}"
    for n, f, p in [("subject_cuis", "cui", "s"), ("predicate_cuis", "cui", "p"), ("object_cuis", "cui", "o"),
                    ("subject_text_cuis", "preferred", "s"), ("predicate_text_cuis", "preferred", "p"), ("object_text_cuis", "preferred", "o")]))


@register("P9", P9_SQL)
def p9(spark, d):
    s = enriched(spark, d, views.spo(spark, d), concepts.wanted(9, "corpus")).withColumns({c: F.lit("old") for c in concepts.CONCEPT_COLUMNS})
    return concepts.assign_concepts(s, 9, "corpus").select("id", *concepts.CONCEPT_COLUMNS)


@register("P10", with_views("spo") + """
SELECT id FROM spo WHERE len(list_filter(string_split_regex(big_subject || ' ' || big_object, '\\s+'), lambda x: x <> ''))
  <> len(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> ''))""")
def p10(spark, d):
    s = views.spo(spark, d).withColumn("both", F.concat_ws(" ", "big_subject", "big_object"))
    return concepts.length_mismatches(s, "both", "sentence").select("id")


def at_extraction_levels(df):
    """Level-9 and level-8 sentences stand at levels 5 and 6, where extraction runs."""
    return df.withColumn("review_level", F.when(F.col("review_level") == 9, 5).when(F.col("review_level") == 8, 6).otherwise(F.col("review_level")))


def _extracted(spark, d, mode):
    lex = lexicon.build_lexicon(spark)
    s = at_extraction_levels(views.with_spo(injected(spark, d, lex, rated=True)))
    s = s.select("id", "sentence", "pos", "review_level", "skip_validations", "check_worthy", "check_worthy_auto", "check_worthy_score_auto", "rating",
                 "sentence_class", "predicate_not_found", "manually_identified_predicate", *_SPO, *[F.lit("").alias(c) for c in concepts.CONCEPT_COLUMNS])
    out = extraction.run_spo(s, lex, parse_parts, mode=mode, annotate=lambda df, where: enriched(spark, d, df, where))
    return out.select("id", "spo_type", "big_subject", "predicate", "big_object", "sentence_class", "predicate_not_found", *concepts.CONCEPT_COLUMNS)


_SPO = ["spo_type", "subject", "predicate", "object", "big_subject", "big_predicate", "big_object"]


def _tokens(text_sql):
    return rf"list_filter(string_split_regex({text_sql}, '\s+'), lambda x: x <> '')"


def _filled(name, before, found):
    """Table ``name``: ``before`` with the SPO columns of the rows that ``found`` has."""
    cols = ", ".join(f"CASE WHEN m.id IS NOT NULL THEN m.{c} ELSE b.{c} END AS {c}" for c in _SPO)
    return f"{name} AS MATERIALIZED (SELECT b.* REPLACE ({cols}) FROM {before} b LEFT JOIN ({found}) m ON m.id = b.id)"


def _split_sql(source, lex, where):
    """Best phrase of ``lex`` per row, as all seven columns."""
    return f"""SELECT id, spo_type, big_subject AS subject, predicate, big_object AS object, big_subject, predicate AS big_predicate, big_object
FROM (WITH {match_sql(source, lex, where)})"""


def _manual_sql(source, where):
    return rf"""WITH m AS (SELECT id, sentence, manually_identified_predicate AS p, lower(manually_identified_predicate) AS lp, replace(lower(sentence), '’', '''') AS t FROM {source}
  WHERE {where} AND manually_identified_predicate <> big_predicate AND manually_identified_predicate <> ''),
b AS (SELECT *, CASE WHEN regexp_matches(lp, '^[\p{{L}}\p{{N}}_]') THEN '(|.*?[^\p{{L}}\p{{N}}_])' ELSE '(.*?[\p{{L}}\p{{N}}_])' END AS pre,
  CASE WHEN regexp_matches(lp, '[\p{{L}}\p{{N}}_]$') THEN '([^\p{{L}}\p{{N}}_]|$)' ELSE '[\p{{L}}\p{{N}}_]' END AS post FROM m),
f AS (SELECT *, '(?s)^' || pre || regexp_escape(lp) || post AS re FROM b),
r AS (SELECT *, CASE WHEN regexp_matches(t, re) THEN length(regexp_extract(t, re, 1)) ELSE -1 END AS at0 FROM f)
SELECT id, 'manually id' AS spo_type, left(sentence, at0) AS subject, p AS predicate, substring(sentence, at0 + length(p) + 1) AS object, left(sentence, at0) AS big_subject,
  p AS big_predicate, substring(sentence, at0 + length(p) + 1) AS big_object FROM r WHERE at0 > 0 AND at0 + length(p) < length(sentence)"""


def _cascade_sql(source, where):
    """First reading of the quoted span or sentence, else of the clauses."""
    parts = f"""q AS (SELECT id, sentence, coalesce(regexp_extract_all(sentence, '"(.*?)"', 1)[1], regexp_extract_all(sentence, '“(.*?)”', 1)[1], '') AS x FROM {source} WHERE {where}),
parts AS (SELECT id, 0 AS part_no, CASE WHEN x <> '' THEN 'quoted text' ELSE 'sentence' END AS kind, CASE WHEN x <> '' THEN x ELSE sentence END AS part FROM q
  UNION ALL SELECT id, k, 'clause', c[k] FROM (SELECT id, string_split(sentence, ',') AS c FROM q), LATERAL (SELECT unnest(range(1, len(c) + 1)) AS k))"""
    tagged = _parts_tagged().replace("SELECT * EXCLUDE (root0), CASE", "SELECT * EXCLUDE (root0), root0 > 0 AS root0_verb, CASE")
    return f"""WITH {parts}, {tagged}, {parsed_sql('parsed', 'id, part_no, kind')},
usable AS (SELECT r.* FROM read r JOIN parsed p USING (id, part_no, kind) WHERE r.kind <> 'clause' OR p.root0_verb)
SELECT id, min_by(kind, part_no) AS spo_type, {', '.join(f'min_by({c}, part_no) AS {c}' for c in _SPO[1:])} FROM usable GROUP BY id"""


def _walk_sql(source, where):
    """Concepts of the tokens by the walk along the sentence, one character a step: ``cs`` has the six concept texts per id."""
    texts = [(x, y, f, n) for x, y in (("s", "subject"), ("p", "predicate"), ("o", "object")) for f, n in (("cui", f"{y}_cuis"), ("preferred", f"{y}_text_cuis"))]
    return f"""al AS MATERIALIZED (SELECT id, sentence AS s, length(sentence) AS n, array_to_string(toks, '') AS t, toks, ns, np FROM (
  SELECT *, {_tokens("big_subject || ' ' || predicate || ' ' || big_object")} AS toks, len({_tokens('big_subject')}) AS ns, len({_tokens('predicate')}) AS np
  FROM {source} WHERE ({where}) AND big_subject <> '' AND predicate <> '' AND big_object <> '' AND id IN (SELECT id FROM concept))),
wk(id, j, place) AS (
  SELECT id, 0, 0 FROM al
  UNION ALL
  SELECT id, j + 1, a + CASE WHEN a < n - 1 AND substr(s, a + 1, 1) = ' ' THEN 1 ELSE 0 END FROM (
    SELECT wk.id, j, s, n, place + CASE WHEN place < n - 1 AND substr(s, place + 1, 1) = substr(t, j + 1, 1) THEN 1 ELSE 0 END AS a FROM wk JOIN al ON al.id = wk.id WHERE j < length(t) - 1)
),
seen AS (SELECT wk.id, j, c.cui, c.preferred FROM wk JOIN concept c ON c.id = wk.id AND c.start_pos = wk.place),
tk AS (SELECT id, k, toks[k] AS token, length(array_to_string(toks[:k - 1], '')) AS o, CASE WHEN k <= ns THEN 's' WHEN k <= ns + np THEN 'p' ELSE 'o' END AS part
  FROM al, LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS k)),
tc AS (SELECT tk.id, k, any_value(part) AS part, coalesce(max_by(cui, j), '[UNK]') AS cui, coalesce(max_by(preferred, j), '[UNK]') AS preferred
  FROM tk LEFT JOIN seen ON seen.id = tk.id AND j >= o AND j < o + length(token) GROUP BY tk.id, k),
cs AS (SELECT id, {', '.join(f"string_agg({f}, ' ' ORDER BY k) FILTER (part = '{x}') AS {n}" for x, _, f, n in texts)} FROM tc GROUP BY id)"""


def extraction_sql(mode):
    """The cascade as stored steps: cleared, lexicon, readings, short forms, manual predicates at both levels, concepts, classes."""
    outside = "skip_validations AND check_worthy_auto = 'FR' AND NOT predicate_not_found"
    chosen = "NOT skip_validations AND check_worthy_score_auto >= 0.5" if mode == "full" else f"(({outside}) OR (NOT skip_validations AND check_worthy = 'FR'))"
    pending = f"review_level = 5 AND predicate = '' AND {chosen}"
    mixed = lambda sql: sql.replace("FROM sentence)", "FROM mixed)")
    empty = ", ".join(f"CASE WHEN review_level <= 5 AND NOT predicate_not_found THEN '' ELSE {c} END AS {c}" for c in _SPO)
    steps = [
        INJECTED_SQL, mixed(views.CONCEPT_SQL), BE_HAVE_SQL, mixed(views.SPO_SQL),
        "e0 AS (SELECT * REPLACE (CASE review_level WHEN 9 THEN 5 WHEN 8 THEN 6 ELSE review_level END AS review_level) FROM spo)",
        f"e1 AS MATERIALIZED (SELECT * REPLACE ({empty}) FROM e0)"]
    last = "e1"
    if mode != "augmented":
        short = f"len({_tokens('sentence')}) <= {fixed.BE_HAVE_MAX_TOKENS}"
        for name, found in (("e2", _split_sql("e1", "lexicon", pending)), ("e3", _cascade_sql("e2", pending)), ("e4", _split_sql("e3", "behave", f"{pending} AND {short}"))):
            steps.append(_filled(name, last, found))
            last = name
    if mode != "full":
        for name, level in (("e5", 5), ("e6", 6)):
            steps.append(_filled(name, last, _manual_sql(last, f"review_level = {level} AND {chosen}")))
            last = name
    steps.append(_walk_sql(last, f"review_level IN ({'5' if mode == 'full' else '5, 6'}) AND {chosen}"))
    label, missed = "sentence_class", "predicate_not_found"
    if mode != "full":
        worthy = "CASE WHEN skip_validations THEN check_worthy_auto ELSE check_worthy END = 'FR'"
        label = f"CASE WHEN review_level = 5 AND {worthy} AND rating IS NOT NULL THEN CASE WHEN rating < 25 THEN 'F' WHEN rating <= 50 THEN 'PF' ELSE 'T' END ELSE sentence_class END"
        missed = f"predicate_not_found OR (review_level <= 5 AND {outside} AND NOT (big_subject <> '' AND big_predicate <> '' AND big_object <> ''))"
    names = ", ".join(f"coalesce(cs.{c}, '') AS {c}" for c in concepts.CONCEPT_COLUMNS)
    return with_views("rated", "sem", extra=",\n".join(steps)).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT e.id, spo_type, big_subject, predicate, big_object, {label} AS sentence_class, {missed} AS predicate_not_found, {names}
FROM {last} e LEFT JOIN cs ON cs.id = e.id"""


@register("P11", extraction_sql("reviewed"))
def p11(spark, d):
    return _extracted(spark, d, "reviewed")


@register("P11_full", extraction_sql("full"))
def p11_full(spark, d):
    return _extracted(spark, d, "full")


@register("P11_augmented", extraction_sql("augmented"))
def p11_augmented(spark, d):
    return _extracted(spark, d, "augmented")


@register("T25", with_views("spo") + r"""
SELECT id, array_to_string(list_filter(list_filter(string_split_regex(coalesce(nullif(subject || ' [UNK] ' || subject, ''), ''), '\s+'), lambda t: t <> ''), lambda t: t <> '[UNK]'), ' ')
  || ' [SEP] ' || array_to_string(list_filter(string_split_regex(predicate, '\s+'), lambda t: t <> '' AND t <> '[UNK]'), ' ')
  || ' [SEP] ' || array_to_string(list_filter(string_split_regex(object, '\s+'), lambda t: t <> '' AND t <> '[UNK]'), ' ') AS cui_text,
  subject || ' [UNK] ' || subject || ' [SEP] ' || predicate || ' [SEP] ' || object AS raw_text FROM spo""")
def t25(spark, d):
    s = F.concat(F.col("subject"), F.lit(" [UNK] "), F.col("subject"))
    p, o = F.col("predicate"), F.col("object")
    return views.spo(spark, d).select("id", text.cui_text(s, p, o).alias("cui_text"), text.cui_text(s, p, o, True).alias("raw_text"))
