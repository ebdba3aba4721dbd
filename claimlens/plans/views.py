"""Derived views over the given tables that stand in for the crawl database, in Spark and in SQL.

Every view is a pure function of ``documents``, ``labels``, ``pages``, ``part``, ``nation``, ``events`` and
``conversations``. ``with_views`` gives the same views as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.cluster import settle, spread
from claimlens.functions.arrays import ARTICLES, DEPENDENCIES, PLACES, dependency_rows
from claimlens.functions.text import sentence_pieces, token_spans

STOP_WORDS = ["a", "an", "the", "of", "and", "in", "is", "to", "le", "la", "de", "et", "der", "die", "und", "el", "en", "que"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


def by_doc(df: DataFrame) -> DataFrame:
    """Workflow columns that follow from ``doc_id`` alone."""
    doc = F.col("doc_id")
    kind = (
        F.when(doc % 8 == 0, "Health").when(doc % 4 == 0, "Other").when(doc % 5 < 3, "Train")
        .when(doc % 5 == 3, "Dev").otherwise("Other")
    )
    level = F.when(doc % 10 < 7, 9).when(doc % 10 == 7, 8).when(doc % 10 == 8, 3).otherwise(1)
    return (
        df.withColumn("skip_validations", doc % 4 == 0)
        .withColumn("instance_type", kind)
        .withColumn("review_level", level)
        .withColumn("needs_revision", doc % 11 == 0)
    )


def _ratings(df: DataFrame, labels: DataFrame) -> DataFrame:
    rating = F.when(F.col("quality").isNull(), 50).when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 100).otherwise(25)
    return df.join(labels, "doc_id", "left").withColumn("rating", rating)


def item(spark, d):
    rated = _ratings(by_doc(documents(spark, d)), table(spark, d, "labels"))
    doc, rating = F.col("doc_id"), F.col("rating")
    word = lambda i: F.coalesce(F.get(F.split("text", " "), F.lit(i)), F.lit(""))
    bare = lambda i: F.regexp_replace(word(i), r"[\[\]\n\r\t]", "")
    verb = F.element_at(F.array(*[F.lit(v) for v in ["causes", "is", "had", "preventing"]]), (doc % 4 + 1).cast("int"))
    return rated.select(
        doc.alias("id"),
        F.concat(bare(0), F.lit(" "), bare(1)).alias("title"),
        F.col("source").alias("type"),
        F.date_sub(F.lit("2024-01-01").cast("date"), (doc % 1000).cast("int")).alias("publication_date"),
        F.col("source").alias("source_entity"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), doc.cast("string")).alias("url"),
        "text",
        "lang",
        F.element_at(F.array(F.lit("meter"), F.lit("label")), (doc % 2 + 1).cast("int")).alias("review_entity"),
        F.concat(F.lit("https://review.example.org/"), doc.cast("string")).alias("review_url"),
        rating.alias("rating"),
        (rating > 50).cast("int").alias("item_class"),
        F.when(F.col("quality").isNull(), "NA").when(rating > 50, "T").when(rating == 25, "PF").otherwise("F").alias("item_class_4"),
        F.lit(0.0).alias("item_class_auto"),
        F.lit("NA").alias("item_class_4_auto"),
        "skip_validations", "instance_type", "review_level", "needs_revision",
        F.concat(F.lit("["), bare(0), F.lit("]["), verb, F.lit("] ["), bare(2), F.lit("]")).alias("main_claim"),
        F.concat(F.lit("["), bare(1), F.lit("] ["), bare(3), F.lit("]")).alias("main_topic"),
        F.lit(0).cast("long").alias("from_item_id"),
    )


ITEM_SQL = r"""item AS (
  SELECT doc_id AS id, b0 || ' ' || b1 AS title, source AS type,
    CAST(DATE '2024-01-01' - CAST(doc_id % 1000 AS INTEGER) AS DATE) AS publication_date, source AS source_entity,
    'https://' || source || '.example.org/' || doc_id AS url, text, lang,
    CASE WHEN doc_id % 2 = 0 THEN 'meter' ELSE 'label' END AS review_entity,
    'https://review.example.org/' || doc_id AS review_url, rating, CAST(rating > 50 AS INTEGER) AS item_class,
    CASE WHEN quality IS NULL THEN 'NA' WHEN rating > 50 THEN 'T' WHEN rating = 25 THEN 'PF' ELSE 'F' END AS item_class_4,
    0.0::DOUBLE AS item_class_auto, 'NA' AS item_class_4_auto,
    skip_validations, instance_type, review_level, needs_revision,
    '[' || b0 || '][' || (['causes','is','had','preventing'])[doc_id % 4 + 1] || '] [' || b2 || ']' AS main_claim,
    '[' || b1 || '] [' || b3 || ']' AS main_topic, CAST(0 AS BIGINT) AS from_item_id
  FROM (SELECT d.*, l.quality, l.toxic,
      CASE WHEN l.quality IS NULL THEN 50 WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 100 ELSE 25 END AS rating,
      regexp_replace(coalesce(string_split(text, ' ')[1], ''), '[\[\]\n\r\t]', '', 'g') AS b0,
      regexp_replace(coalesce(string_split(text, ' ')[2], ''), '[\[\]\n\r\t]', '', 'g') AS b1,
      regexp_replace(coalesce(string_split(text, ' ')[3], ''), '[\[\]\n\r\t]', '', 'g') AS b2,
      regexp_replace(coalesce(string_split(text, ' ')[4], ''), '[\[\]\n\r\t]', '', 'g') AS b3
    FROM docs d LEFT JOIN labels l USING (doc_id)))"""

DOCS_SQL = """docs AS (
  SELECT *, doc_id % 4 = 0 AS skip_validations,
    CASE WHEN doc_id % 8 = 0 THEN 'Health' WHEN doc_id % 4 = 0 THEN 'Other' WHEN doc_id % 5 < 3 THEN 'Train'
         WHEN doc_id % 5 = 3 THEN 'Dev' ELSE 'Other' END AS instance_type,
    CASE WHEN doc_id % 10 < 7 THEN 9 WHEN doc_id % 10 = 7 THEN 8 WHEN doc_id % 10 = 8 THEN 3 ELSE 1 END AS review_level,
    doc_id % 11 = 0 AS needs_revision
  FROM documents)"""


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sentence(spark, d, rated: bool = False):
    """Sentences of all documents; ``rated=True`` also joins the labels for the item rating."""
    docs = by_doc(documents(spark, d))
    if rated:
        docs = _ratings(docs, table(spark, d, "labels"))
    keep = ["doc_id", "source", "skip_validations", "instance_type", "review_level", "needs_revision"] + (["rating"] if rated else [])
    cut = docs.select(*keep, F.posexplode(sentence_pieces(F.col("text"))).alias("pos", "sentence"))
    doc, pos = F.col("doc_id"), F.col("pos")
    truth, worth = ["NA", "F", "PF", "T"], ["NA", "NF", "FNR", "FRC", "FR"]
    empty = ["subject", "predicate", "object", "big_subject", "big_predicate", "big_object", "spo_type", "manually_identified_predicate"]
    return cut.select(
        (doc * 10_000_000 + pos).alias("id"),
        doc.alias("item_id"),
        pos.cast("long").alias("pos"),
        (doc * 10_000_000 + pos).alias("new_sentence_id"),
        "sentence",
        F.col("source").alias("title"),
        (((doc * 31 + pos * 17) % 101) / 100.0).alias("sentence_class_score_auto"),
        (((doc * 13 + pos * 7) % 101) / 100.0).alias("check_worthy_score_auto"),
        _pick(truth, (doc + pos) % 4).alias("sentence_class"),
        _pick(truth, (doc + pos * 3) % 4).alias("sentence_class_auto"),
        _pick(worth, (doc * 3 + pos) % 5).alias("check_worthy"),
        _pick(worth, (doc * 3 + pos * 2) % 5).alias("check_worthy_auto"),
        (pos % 3).cast("int").alias("health_terms_auto"),
        F.lit(False).alias("health_terms"),
        (pos % 7 == 0).alias("predicate_not_found"),
        "skip_validations", "instance_type", "review_level", "needs_revision",
        *(["rating"] if rated else []),
        *[F.lit("").alias(c) for c in empty],
    )


def _sentence_sql(rated: bool) -> str:
    rating = ", CASE WHEN l.quality IS NULL THEN 50 WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 100 ELSE 25 END AS rating" if rated else ""
    joined = "docs LEFT JOIN labels l USING (doc_id)" if rated else "docs"
    return rf"""sentence AS (
  SELECT doc_id * 10000000 + pos AS id, doc_id AS item_id, pos, doc_id * 10000000 + pos AS new_sentence_id, sentence, source AS title,
    ((doc_id * 31 + pos * 17) % 101) / 100.0::DOUBLE AS sentence_class_score_auto,
    ((doc_id * 13 + pos * 7) % 101) / 100.0::DOUBLE AS check_worthy_score_auto,
    (['NA','F','PF','T'])[(doc_id + pos) % 4 + 1] AS sentence_class,
    (['NA','F','PF','T'])[(doc_id + pos * 3) % 4 + 1] AS sentence_class_auto,
    (['NA','NF','FNR','FRC','FR'])[(doc_id * 3 + pos) % 5 + 1] AS check_worthy,
    (['NA','NF','FNR','FRC','FR'])[(doc_id * 3 + pos * 2) % 5 + 1] AS check_worthy_auto,
    CAST(pos % 3 AS INTEGER) AS health_terms_auto, false AS health_terms, pos % 7 = 0 AS predicate_not_found,
    skip_validations, instance_type, review_level, needs_revision{', rating' if rated else ''},
    '' AS subject, '' AS predicate, '' AS object, '' AS big_subject, '' AS big_predicate, '' AS big_object,
    '' AS spo_type, '' AS manually_identified_predicate
  FROM (SELECT * EXCLUDE (parts), unnest(parts) AS sentence, CAST(unnest(range(len(parts))) AS BIGINT) AS pos FROM (
    SELECT doc_id, source, skip_validations, instance_type, review_level, needs_revision{rating},
      list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS parts
    FROM {joined})))"""


def with_spo(df: DataFrame) -> DataFrame:
    """Fills the subject/predicate/object columns of two thirds of the sentences of three or more words."""
    words, pos = F.split("sentence", " "), F.col("pos")
    has = (F.size(words) >= 3) & (pos % 3 != 2)
    fill = lambda c: F.when(has, c).otherwise(F.lit(""))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    rest = F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), " ")
    return df.withColumns({
        "subject": fill(first), "predicate": fill(second), "object": fill(rest),
        "big_subject": fill(first), "big_predicate": fill(second), "big_object": fill(rest),
        "spo_type": fill(_pick(["given long", "sentence", "clause", "manually id"], pos % 4)),
        "manually_identified_predicate": fill(F.when(pos % 2 == 0, second).otherwise(F.get(words, F.lit(2)))),
    })


def spo(spark, d, rated: bool = False):
    return with_spo(sentence(spark, d, rated))


SPO_SQL = """spo AS (
  SELECT * REPLACE (CASE WHEN has THEN w[1] ELSE '' END AS subject, CASE WHEN has THEN w[2] ELSE '' END AS predicate,
    CASE WHEN has THEN array_to_string(w[3:], ' ') ELSE '' END AS object,
    CASE WHEN has THEN w[1] ELSE '' END AS big_subject, CASE WHEN has THEN w[2] ELSE '' END AS big_predicate,
    CASE WHEN has THEN array_to_string(w[3:], ' ') ELSE '' END AS big_object,
    CASE WHEN has THEN (['given long','sentence','clause','manually id'])[pos % 4 + 1] ELSE '' END AS spo_type,
    CASE WHEN has THEN (CASE WHEN pos % 2 = 0 THEN w[2] ELSE w[3] END) ELSE '' END AS manually_identified_predicate)
  FROM (SELECT *, len(w) >= 3 AND pos % 3 <> 2 AS has FROM (SELECT *, string_split(sentence, ' ') AS w FROM sentence)))"""


def words(spark, d):
    """Word runs of each sentence as an array of (text, start)."""
    return sentence(spark, d).withColumn("tokens", token_spans(F.col("sentence")))


def kg(spark, d):
    """(nodes, relations, edges) over part names, brands and nations."""
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    uri = lambda lang, c: F.concat(F.lit(f"/c/{lang}/"), F.regexp_replace(F.lower(c), " ", "_"))
    names = (
        part.select(uri("en", F.col("p_name")).alias("uri"))
        .union(part.select(uri("en", F.col("p_brand"))))
        .union(nation.select(uri("fr", F.col("n_name"))))
        .distinct()
    )
    nodes = names.select(F.col("uri").alias("id"), "uri")
    relation = ["IsA", "Synonym", "Causes", "HasProperty", "MadeOf", "PartOf", "RelatedTo", "Antonym"]
    key = F.col("p_partkey")
    number = (key % 8).cast("int")
    relations = (
        spark.range(8)
        .select(F.col("id").cast("int").alias("id"), F.concat(F.lit("/r/"), _pick(relation, F.col("id"))).alias("uri"))
    )
    start, end, brand = uri("en", F.col("p_name")), uri("en", F.col("p_brand")), F.col("p_size") / 10.0
    ends = F.array(F.struct(end.alias("end_id")), F.struct(F.when(key % 97 == 0, start).alias("end_id")))
    edges = (
        part.select(start.alias("start_id"), number.alias("relation_id"), brand.alias("weight"), F.inline(ends))
        .where("end_id is not null")
    )
    return nodes, relations, edges


KG_SQL = """kg_nodes AS (
  SELECT DISTINCT uri AS id, uri FROM (
    SELECT '/c/en/' || replace(lower(p_name), ' ', '_') AS uri FROM part UNION ALL
    SELECT '/c/en/' || replace(lower(p_brand), ' ', '_') FROM part UNION ALL
    SELECT '/c/fr/' || replace(lower(n_name), ' ', '_') FROM nation)),
kg_relations AS (
  SELECT i AS id, '/r/' || (['IsA','Synonym','Causes','HasProperty','MadeOf','PartOf','RelatedTo','Antonym'])[i + 1] AS uri FROM range(8) t(i)),
kg_edges AS (
  SELECT '/c/en/' || replace(lower(p_name), ' ', '_') AS start_id, p_partkey % 8 AS relation_id, p_size / 10.0::DOUBLE AS weight,
    '/c/en/' || replace(lower(p_brand), ' ', '_') AS end_id FROM part
  UNION ALL
  SELECT '/c/en/' || replace(lower(p_name), ' ', '_'), p_partkey % 8, p_size / 10.0::DOUBLE, '/c/en/' || replace(lower(p_name), ' ', '_')
  FROM part WHERE p_partkey % 97 = 0)"""


def results(spark, d):
    """Score log: one f1 per (model, seed)."""
    events = table(spark, d, "events")
    return events.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("seed")).agg(
        F.round(F.avg("value") / 500, 6).alias("f1"))


RESULTS_SQL = """results AS (
  SELECT event_type AS model, user_id % 10 AS seed, round(avg(value) / 500, 6) AS f1 FROM events GROUP BY 1, 2)"""


def posts(spark, d):
    conv = table(spark, d, "conversations")
    copies = F.explode(F.when(F.col("conv_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conv.withColumn("copy", copies).select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id_str"),
        (F.col("conv_id") % 50).cast("string").alias("user_id_str"),
        F.col("text").alias("full_text"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60).alias("created_at"),
        F.col("turn").alias("turn"),
        F.col("role").alias("role"),
    )


POSTS_SQL = """posts AS (
  SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id_str, CAST(conv_id % 50 AS VARCHAR) AS user_id_str, text AS full_text,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS created_at, turn, role
  FROM conversations, unnest(CASE WHEN conv_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS c(copy))"""

WORDS_SQL = r"""words AS (
  SELECT *, regexp_extract_all(sentence, '[\p{L}\p{N}_]+') AS runs FROM sentence)"""


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause for the named views and what they need."""
    text = {
        "docs": DOCS_SQL, "item": ITEM_SQL, "sentence": _sentence_sql(False), "rated": _sentence_sql(True), "spo": SPO_SQL,
        "kg": KG_SQL, "results": RESULTS_SQL, "posts": POSTS_SQL, "words": WORDS_SQL,
        "concept": CONCEPT_SQL, "sem": SEM_SQL, "tagged": TAGGED_SQL, "parsed": PARSED_SQL,
    }
    needs = {"item": ["docs"], "sentence": ["docs"], "rated": ["docs"], "spo": ["sentence"], "words": ["sentence"],
             "concept": ["sentence", "sem"], "tagged": ["sentence"], "parsed": ["tagged"]}
    order: list[str] = []

    def add(name):
        if "rated" in names and name == "sentence":
            name = "rated"
        for need in needs.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join([text[n] for n in order] + ([extra] if extra else [])) + "\n"


# --- concepts: one candidate per long word ---------------------------------------------------------

def sem_types(spark):
    """Stand-in semantic types, 204 rows by rule: abbr, tui, name, group (see sources/dimensions for real files)."""
    i = F.col("id")
    return spark.range(1, 205).select(
        F.format_string("st%03d", i).alias("abbr"),
        F.format_string("T%03d", i).alias("tui"),
        F.format_string("Type %d", i).alias("type_name"),
        _pick(GROUP_CODES, i % 15).alias("group"),
    )


# fixed values: the 15 group codes
GROUP_CODES = ["ACTI", "ANAT", "CHEM", "CONC", "DEVI", "DISO", "GENE", "GEOG", "LIVB", "OBJC", "OCCU", "ORGA", "PHEN", "PHYS", "PROC"]

SEM_SQL = f"""sem AS (
  SELECT printf('st%03d', i) AS abbr, printf('T%03d', i) AS tui, printf('Type %d', i) AS type_name,
    ({GROUP_CODES})[i % 15 + 1] AS "group" FROM range(1, 205) t(i))"""


def concept_spans(spark, d, base=None, where=None):
    """Sentences with an array of raw candidates (before enrichment) for words of six or more characters.

    ``where`` limits the reading to chosen rows; the others have no candidates.
    """
    read = F.col("sentence") if where is None else F.when(where, F.col("sentence")).otherwise("")
    toks = (base if base is not None else sentence(spark, d)).withColumn("tokens", token_spans(read))
    long = F.filter("tokens", lambda t: F.length(t["text"]) >= 6)
    cand = F.transform(long, lambda t, i: F.struct(
        i.cast("int").alias("candidate_no"),
        t["text"].alias("matched"),
        F.lower(t["text"]).alias("preferred"),
        F.concat(F.lit("C"), F.lpad((F.length(t["text"]) * 1000 + t["start"] % 1000).cast("string"), 7, "0")).alias("cui"),
        F.concat(F.lit("st"), F.lpad(((t["start"] + F.length(t["text"])) % 204 + 1).cast("string"), 3, "0")).alias("sem_type"),
        t["start"].alias("start_pos"),
        F.length(t["text"]).alias("length"),
    ))
    return settle(toks.withColumn("raw", cand).drop("tokens"), "raw")


CONCEPT_SQL = r"""concept AS (
  SELECT c.*, s.tui, s.type_name, s."group" FROM (
    SELECT id, item_id, pos, review_level, check_worthy, skip_validations, k - 1 AS candidate_no, word AS matched, lower(word) AS preferred,
      'C' || lpad(CAST(length(word) * 1000 + start_pos % 1000 AS VARCHAR), 7, '0') AS cui,
      printf('st%03d', (start_pos + length(word)) % 204 + 1) AS sem_type, start_pos, length(word) AS length
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ti) AS k FROM (
      SELECT id, item_id, pos, review_level, check_worthy, skip_validations, ti, runs[ti] AS word,
        length(array_to_string(gaps[:ti], '')) + length(array_to_string(runs[:ti - 1], '')) AS start_pos
      FROM (SELECT *, regexp_extract_all(sentence, '[\p{L}\p{N}_]+') AS runs,
              string_split_regex(sentence, '[\p{L}\p{N}_]+') AS gaps FROM sentence),
        LATERAL (SELECT unnest(range(1, len(runs) + 1)) AS ti))
      WHERE length(word) >= 6)) c
  JOIN sem s ON s.abbr = c.sem_type)"""


# --- tagged tokens and dependency rows by rule -------------------------------------------------------

def tag_of(text, low):
    """Rule tag of a word from its spelling and its lower-cased spelling; ``arrays.dependency_rows`` goes by the same rule."""
    articles, places = list(ARTICLES), list(PLACES)
    # one set for both: Spark hashes a list of more than ten values and goes through a shorter one for each word
    return (
        F.when(low.isin(*articles, *places), F.when(low.isin(*articles), "DT").otherwise("IN"))
        .when(low.endswith("ing"), "VBG").when(low.endswith("ed"), "VBN").when(low.endswith("es"), "VBZ").when(low.endswith("ly"), "RB")
        .when((text >= "A") & (text < "["), "NNP").when(low.endswith("al") | low.endswith("ble"), "JJ").otherwise("NN")
    )


def tagged(spark, d, base=None, fields=("token", "pos", "dep", "is_stop")):
    """Sentences with ``tokens``: array of (token, pos, dep, is_stop), or of the named ones only."""
    runs = F.regexp_extract_all(F.col("sentence"), F.lit(r"(?U)\w+"), F.lit(0))
    both = F.transform(runs, lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    made = {
        "token": lambda w, i: w["t"], "pos": lambda w, i: F.when(i % 5 == 4, "CC").otherwise(tag_of(w["t"], w["low"])),
        "dep": lambda w, i: F.when(i % 4 == 1, "nsubj").otherwise("dep"), "is_stop": lambda w, i: w["low"].isin(*STOP_WORDS)}
    tok = F.transform(both, lambda w, i: F.struct(*[made[f](w, i).alias(f) for f in fields]))
    return settle((base if base is not None else sentence(spark, d)).withColumn("tokens", tok), "tokens")


TAGGED_SQL = rf"""tagged AS (
  SELECT * EXCLUDE (runs), list_transform(runs, lambda t, i: {{'token': t, 'pos': CASE WHEN (i - 1) % 5 = 4 THEN 'CC'
      WHEN lower(t) IN ('a','an','the','le','la','der','die','el') THEN 'DT'
      WHEN lower(t) IN ('of','in','to','de','en') THEN 'IN'
      WHEN lower(t) LIKE '%ing' THEN 'VBG' WHEN lower(t) LIKE '%ed' THEN 'VBN' WHEN lower(t) LIKE '%es' THEN 'VBZ'
      WHEN lower(t) LIKE '%ly' THEN 'RB' WHEN regexp_matches(t, '^[A-Z]') THEN 'NNP'
      WHEN lower(t) LIKE '%al' OR lower(t) LIKE '%ble' THEN 'JJ' ELSE 'NN' END,
      'dep': CASE WHEN (i - 1) % 4 = 1 THEN 'nsubj' ELSE 'dep' END,
      'is_stop': lower(t) IN ({', '.join("'" + w + "'" for w in STOP_WORDS)})}}) AS tokens
  FROM (SELECT *, regexp_extract_all(sentence, '[\p{{L}}\p{{N}}_]+') AS runs FROM sentence))"""


def parsed(spark, d, base=None):
    """Sentences with ``words``: dependency rows by rule (first verb form is the root)."""
    df = base if base is not None else sentence(spark, d)
    runs = F.regexp_extract_all(F.col("sentence"), F.lit(r"(?U)\w+"), F.lit(0))
    t = settle(df.withColumn("words", runs), "words").where(F.size("words") > 0)
    t = t.withColumn("words", F.arrow_udf(dependency_rows, DEPENDENCIES)(F.col("words")))
    tokens = F.transform("words", lambda w: F.struct(w["text"].alias("token"), w["xpos"].alias("pos")))
    root = F.array_position(F.transform("words", lambda w: w["head"]), 0).cast("int")
    return t.select(*df.columns, tokens.alias("tokens"), root.alias("root"), "words")


PARSED_SQL = """parsed AS (
  SELECT * EXCLUDE (root0), CASE WHEN root0 > 0 THEN root0 ELSE 1 END AS root FROM (
    SELECT *, coalesce(list_position(list_transform(tokens, lambda x: x.pos LIKE 'VB%'), true), 0) AS root0
    FROM tagged WHERE len(tokens) > 0))"""
