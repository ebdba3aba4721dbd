"""Queries: sources and sinks. Files are derived from the given tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.cluster import materialise, shared_path
from claimlens.operators import articles, concepts, graphs
from claimlens.operators.selectors import item_selector
from claimlens.plans import views
from claimlens.plans.queries_articles import A6_SELECT, FEATURE_DOUBLES, rounded
from claimlens.plans.registry import register
from claimlens.plans.views import table, with_views
from claimlens.sources import sinks, tables


@register("S1", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber""")
def s1(spark, d):
    where = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")
    return tables.scan(spark, f"{d}/lineitem.parquet", where, ["l_orderkey", "l_linenumber", "l_quantity"], ["l_orderkey", "l_linenumber"])


@register("S2", "SELECT * FROM part WHERE p_size < 10")
def s2(spark, d):
    return tables.scan(spark, f"{d}/part.parquet", F.col("p_size") < 10)


def _dim_files(spark, d):
    """Dimension files in the public layouts, one line per part row."""
    part = table(spark, d, "part")
    types, groups = shared_path(spark, "types"), shared_path(spark, "groups")
    tui = F.concat(F.lit("T"), F.col("p_partkey"))
    part.select(F.concat_ws("|", F.concat(F.lit("t"), F.col("p_partkey")), tui, "p_name").alias("value")).write.text(types)
    part.select(F.concat_ws("|", "p_brand", F.lit("name"), tui, "p_type").alias("value")).write.text(groups)
    return types, groups


@register("S3", """
SELECT 't' || p_partkey AS abbr, 'T' || p_partkey AS tui, p_name AS type_name, p_brand AS "group" FROM part""")
def s3(spark, d):
    types, groups = _dim_files(spark, d)
    return tables.load_sem_types(spark, types).join(tables.load_sem_groups(spark, groups).select("tui", "group"), "tui").select(
        "abbr", "tui", "type_name", "group")


@register("S4", """SELECT p_brand AS "group", row_number() OVER (ORDER BY min(p_partkey)) AS place FROM part GROUP BY 1""")
def s4(spark, d):
    path = shared_path(spark, "groups")
    line = F.concat_ws("|", "p_brand", F.lit("name"), F.col("p_partkey").cast("string"), "p_type")
    table(spark, d, "part").orderBy("p_partkey").select(line.alias("value")).coalesce(1).write.text(path)
    groups = tables.sem_groups(tables.load_sem_groups(spark, path))  # a few rows
    return groups.select("group", F.row_number().over(Window.orderBy("first_line")).alias("place"))


@register("S5", "SELECT DISTINCT lower(p_type) AS phrase FROM part")
def s5(spark, d):
    path = shared_path(spark, "lines")
    table(spark, d, "part").select(F.lower("p_type").alias("value")).write.text(path)
    return tables.load_lines(spark, path)


@register("S6", """
SELECT 'verb' || p_partkey AS predicate, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'DISO,CHEM' END AS subject_groups,
  'GENE' AS object_groups FROM part WHERE p_partkey % 5 <> 0""")
def s6(spark, d):
    path, key = shared_path(spark, "rules"), F.col("p_partkey")
    subject = F.when(key % 3 == 0, "[]").otherwise("['DISO', 'CHEM']")
    line = F.when(key % 5 == 0, F.concat_ws("\t", F.lit("verb"), key.cast("string"))).otherwise(
        F.concat_ws("\t", F.concat(F.lit("verb"), key.cast("string")), F.lit("1"), subject, F.lit("['GENE']")))
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return tables.load_valid_groups(spark, path).select(
        "predicate", F.array_join("subject_groups", ",").alias("subject_groups"), F.array_join("object_groups", ",").alias("object_groups"))


RATINGS = ["other", "FALSE", "Partially False", "true", "unheard of"]


@register("S7", f"""
SELECT text, (['NA','F','PF','T','F'])[doc_id % 5 + 1] AS item_class_4, ([0,1,2,3,1])[doc_id % 5 + 1] AS label,
  CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END AS binary_label FROM documents""")
def s7(spark, d):
    path = shared_path(spark, "articles")
    rating = F.element_at(F.array(*[F.lit(r) for r in RATINGS]), (F.col("doc_id") % 5 + 1).cast("int"))
    views.documents(spark, d).select("text", rating.alias("article_rating")).write.json(path)
    return tables.load_external(spark, path)


def concept_xml(spark, d):
    """Extraction documents, one per sentence: a phrase per long word plus a phrase without mappings."""
    s = views.concept_spans(spark, d)
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = (
        "<Phrase><PhraseText>%s</PhraseText><SyntaxUnits Count=\"1\"><SyntaxUnit><SyntaxType>head</SyntaxType><LexMatch>%s</LexMatch>"
        "<Tokens Count=\"1\"><Token>%s</Token></Tokens></SyntaxUnit></SyntaxUnits><Mappings Count=\"2\"><Mapping><MappingCandidates Total=\"1\"><Candidate>"
        "<CandidateCUI>%s</CandidateCUI><CandidateMatched>%s</CandidateMatched><CandidatePreferred>%s</CandidatePreferred>"
        "<MatchedWords Count=\"1\"><MatchedWord>%s</MatchedWord></MatchedWords><SemTypes Count=\"1\"><SemType>%s</SemType></SemTypes>"
        "<Negated>0</Negated><ConceptPIs Count=\"1\"><ConceptPI><StartPos>%s</StartPos><Length>%s</Length></ConceptPI></ConceptPIs>"
        "</Candidate></MappingCandidates></Mapping><Mapping><MappingCandidates Total=\"0\"></MappingCandidates></Mapping></Mappings></Phrase>").split("%s")

    def candidate(c):
        matched, preferred = esc(c["matched"]), esc(c["preferred"])
        values = [matched, matched, matched, c["cui"], matched, preferred, preferred, c["sem_type"], c["start_pos"].cast("string"), c["length"].cast("string")]
        return F.concat(*[x for part, value in zip(parts, values) for x in (F.lit(part), value)], F.lit(parts[-1]))

    bare = "<Phrase><PhraseText>none</PhraseText><SyntaxUnits Count=\"0\"/><Mappings Count=\"0\"/></Phrase>"
    body = F.concat(
        F.lit("<MMOs><MMO><Utterances Count=\"1\"><Utterance><Phrases>" + bare),
        F.array_join(F.transform("raw", candidate), ""), F.lit("</Phrases></Utterance></Utterances></MMO></MMOs>"))
    broken = F.when(F.col("pos") % 10 == 9, F.concat(F.lit("<MMOs><MMO>"), F.col("pos").cast("string"))).otherwise(body)
    return s.select("id", broken.alias("xml"))


@register("S8", with_views("concept") + """
SELECT id, candidate_no AS phrase_no, matched, preferred, cui, sem_type, start_pos, length FROM concept WHERE pos % 10 <> 9""")
def s8(spark, d):
    flat = concepts.flat_candidates(concepts.parse_concept_xml(concept_xml(spark, d), "xml"))
    return flat.select("id", "phrase_no", "matched", "preferred", "cui", "sem_type",
                       F.get("positions", F.lit(0))["start_pos"].alias("start_pos"), F.get("positions", F.lit(0))["length"].alias("length"))


@register("S9", """
SELECT CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END AS label, l_quantity AS posemo, l_discount AS negemo, CAST(l_linenumber AS DOUBLE) AS wc FROM lineitem""")
def s9(spark, d):
    path = shared_path(spark, "features")
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    table(spark, d, "lineitem").select(
        F.lit("text").alias("Source (A)"), F.when(F.col("l_returnflag") == "R", "T").otherwise("F").alias("Source (B)"),
        comma("l_quantity").alias("posemo"), comma("l_discount").alias("negemo"), F.col("l_linenumber").alias("wc"),
    ).write.option("sep", "\t").option("header", True).csv(path)
    return tables.load_liwc(spark, path, ["NA", "F", "PF", "T"])


@register("S10", with_views("results") + "SELECT model, CAST(seed AS DOUBLE) AS seed, f1 FROM results")
def s10(spark, d):
    path = shared_path(spark, "scores")
    views.results(spark, d).write.option("sep", "\t").option("header", True).csv(path)
    return tables.load_results(spark, path)


@register("S11", with_views("item") + """
SELECT skip_validations, id, title, type, item_class_4, rating FROM item""")
def s11(spark, d):
    path = shared_path(spark, "items")
    cols = ["id", "title", "type", "item_class_4", "rating", "skip_validations"]
    sinks.export_json(views.item(spark, d).select(*cols), path, "skip_validations")
    schema = "id long, title string, type string, item_class_4 string, rating int, skip_validations boolean"
    return spark.read.schema(schema).json(path).select(*cols)


@register("S12", with_views("item", "sentence") + """
SELECT i.id AS item_id, url AS item_url, item_class_4 AS item_class_mc, CASE WHEN item_class = 1 THEN 'T' ELSE 'F' END AS item_class,
  s.new_sentence_id AS sentence_id, s.sentence_class AS sentence_class_mc, CASE WHEN s.sentence_class = 'T' THEN 'T' WHEN s.id IS NOT NULL THEN 'F' END AS sentence_class,
  s.instance_type AS pipeline_instance_type, CASE WHEN s.instance_type IN ('Dev','Other') THEN 'Test' ELSE s.instance_type END AS instance_type,
  CASE WHEN s.id IS NOT NULL THEN row_number() OVER (PARTITION BY i.id ORDER BY s.new_sentence_id) - 1 END AS place
FROM item i LEFT JOIN sentence s ON s.item_id = i.id WHERE NOT i.skip_validations""")
def s12(spark, d):
    path = shared_path(spark, "dataset")
    sinks.export_dataset(views.item(spark, d), views.sentence(spark, d), path)
    entry = "array<struct<sentence_id:long,check_worthy:string,sentence_class_mc:string,sentence_class:string,pipeline_instance_type:string,instance_type:string>>"
    back = spark.read.schema(
        f"item_id long, item_url string, review_url string, item_class_mc string, item_class string, sentences {entry}").json(path)
    return back.select("item_id", "item_url", "item_class_mc", "item_class", F.posexplode_outer("sentences").alias("place", "s")).select(
        "item_id", "item_url", "item_class_mc", "item_class", "s.sentence_id", "s.sentence_class_mc", "s.sentence_class",
        "s.pipeline_instance_type", "s.instance_type", "place")


TSV_CLEAN_SQL = r"""replace(trim(regexp_replace(replace(replace({c}, chr(13), ' '), chr(10), ' '), '\s\s+', ' ', 'g')), chr(9), ' ')"""


@register("S13", with_views("item") + f"SELECT {TSV_CLEAN_SQL.format(c='text')} AS document, item_class_4 AS class FROM item")
def s13(spark, d):
    path = shared_path(spark, "text-class")
    sinks.export_text_class(views.item(spark, d), path, "text", "item_class_4")
    return spark.read.schema("document string, class string").option("sep", "\t").option("header", True).option("quote", "").option(
        "ignoreLeadingWhiteSpace", False).csv(path)


@register("S14", with_views("sentence") + """
SELECT id, sentence AS value FROM sentence WHERE review_level = 3""")
def s14(spark, d):
    path = shared_path(spark, "sentence-lines")
    sinks.export_sentences(views.sentence(spark, d), path, 3, clean=True)
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).select(cut[0].cast("long").alias("id"), cut[1].alias("value"))


@register("S16", with_views("kg") + """
, e AS (SELECT start_id AS src, end_id AS dst, relation_id AS rel, row_number() OVER (ORDER BY start_id, relation_id, end_id, weight) AS edge_id FROM kg_edges),
n AS (SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e))
SELECT 'node' AS kind, '            <node id = "' || node || '" label = "' || node || '"> <viz:color r="123" g="104" b="238" a="0.5" /> </node>' AS line FROM n
UNION ALL SELECT 'frame', unnest(['<?xml version="1.0" encoding="UTF-8"?>',
  '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2" xmlns:viz="http://www.gexf.net/1.2draft/viz" >', '    <graph mode="static" defaultedgetype="directed">',
  '        <nodes>', '        </nodes>', '        <edges>', '        </edges>', '    </graph>', '</gexf>'])
UNION ALL SELECT 'edge', '            <edge id = "' || edge_id || '" source = "' || src || '" target= "' || dst || '" label = "' || rel || '" />' FROM e""")
def s16(spark, d):
    _, _, edges = views.kg(spark, d)
    path = shared_path(spark, "graph")
    # sorted, so that the stored key grows in reading order
    listed = materialise(edges.orderBy("start_id", "relation_id", "end_id", "weight").withColumn("key", F.monotonically_increasing_id()), "edges")
    listed = listed.select("key", F.lit(0).alias("place"), F.col("start_id").alias("src"), F.col("end_id").alias("dst"), F.col("relation_id").cast("string").alias("rel"))
    sinks.export_gexf(graphs.nodes(listed, "key"), graphs.number_edges(listed, "key"), path)
    line = F.col("value")
    kind = F.when(line.contains("<node id"), "node").when(line.contains("<edge id"), "edge").otherwise("frame")
    return spark.read.option("lineSep", "\r\n").text(path).select(kind.alias("kind"), line.alias("line"))


@register("S17", with_views("results") + """
SELECT model, printf('%.3f', avg(f1)) AS f1, printf('%.3f', max(seed) / 10.0) AS accuracy FROM results GROUP BY model""")
def s17(spark, d):
    path = shared_path(spark, "log")
    per_model = views.results(spark, d).groupBy("model").agg(F.avg("f1").alias("f1"), (F.max("seed") / 10.0).alias("accuracy"))
    zero = F.lit(0.0)
    rows = per_model.select("accuracy", zero.alias("precision"), zero.alias("recall"), "f1", zero.alias("precision+"), zero.alias("recall+"), zero.alias("f1+"), "model")
    for part in (0, 1):  # two runs, one header
        sinks.append_results(rows.where(F.pmod(F.hash("model"), F.lit(2)) == part), path)
    return sinks.read_results(spark, path).select("model", "f1", "accuracy")


@register("S18", with_views("sentence") + "SELECT sentence_class AS truth, sentence_class_auto AS prediction FROM sentence")
def s18(spark, d):
    path = shared_path(spark, "predictions")
    sinks.export_predictions(views.sentence(spark, d), path, "sentence_class", "sentence_class_auto")
    return spark.read.schema("truth string, prediction string").option("sep", "\t").option("header", True).csv(path)


@register("S19", with_views("item", "sentence") + f"""
SELECT i.id, {A6_SELECT} FROM item i LEFT JOIN sentence s ON s.item_id = i.id AND s.review_level = 9
WHERE NOT i.skip_validations AND i.review_level = 9 AND i.instance_type = 'Dev' GROUP BY i.id""")
def s19(spark, d):
    build = lambda items, sentences: articles.item_features(items, sentences, 9).select("id", *articles.FEATURES)
    sources = views.item(spark, d).where(item_selector("dev")).select("id"), views.sentence(spark, d)
    folder = shared_path(spark, "cache")
    sinks.cached("dev", folder, build, *sources)
    return rounded(sinks.cached("dev", folder, build, *sources), FEATURE_DOUBLES)
