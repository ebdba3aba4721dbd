"""Steps that have to stay small: what travels, what is stored, and how the work is dealt."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimlens.functions import tagged, text
from claimlens.functions.arrays import last_inside
from claimlens.functions.text import lookup, running_sums
from claimlens.operators import concepts, counts, encoding, extraction, hidden, knowledge, lexicon, models


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hidden_layer_keeps_rows_sparse(spark, monkeypatch):
    """the blocks hold the non-zero entries, the gradient is right, and the network learns."""
    rows = spark.createDataFrame([(f"word{i % 5} other{i % 3}", int(i % 5 > 2)) for i in range(300)] + [("", 0)], "text string, label int")
    stored = []
    monkeypatch.setattr(hidden, "materialise", lambda df, name: stored.append(df.persist()) or stored[0])
    out = models.text_classifier(rows, 2, hidden=4, width=512, iterations=30).transform(rows)
    assert out.where("prediction <> label").count() == 0
    assert stored[0].agg(F.sum(F.length("entries"))).first()[0] == 300 * 2 * 8  # a dense block would have 301 * 512 * 8
    row = {"labels": np.array([1, 0], np.int32), "sizes": np.array([2, 0], np.int32), "places": np.array([0, 2], np.int32), "entries": np.array([0.5, 2.0])}
    w = np.random.default_rng(1).normal(size=3 * 4 + 4 + 4 * 2 + 2)
    loss = lambda v: hidden._add_block(row, hidden._layers(v, 3, 4, 2), hidden._layers(np.zeros(len(w)), 3, 4, 2))
    grad = np.zeros(len(w))
    hidden._add_block(row, hidden._layers(w, 3, 4, 2), hidden._layers(grad, 3, 4, 2))
    near = [(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6]
    assert np.allclose(grad, near, atol=1e-6)


def test_related_terms_leave_packed_lists_last(spark):
    """hits are packed and shared out; every name still meets every hit of its term, copies included."""
    nodes = spark.createDataFrame([(u, u) for u in ("/c/en/a", "/c/en/b", "/c/en/c")], "id string, uri string")
    relations = spark.createDataFrame([(1, "/r/IsA")], "id int, uri string")
    edges = spark.createDataFrame([("/c/en/a", 1, 1.0, "/c/en/b")] * 2 + [("/c/en/a", 1, 2.0, "/c/en/c")], "start_id string, relation_id int, weight double, end_id string")
    names = spark.createDataFrame([(i // 2, "s", "A") for i in range(100)] + [(200, "o", "b"), (None, "s", "a")], "id int, side string, name string")
    out = knowledge.related(names, ["id"], nodes, edges, relations)
    assert "inline" in plan(out)
    found = sorted((r["id"] or -1, r["related"], r["weight"]) for r in out.collect())
    one = [("b", 1.0), ("b", 1.0), ("c", 2.0)]
    assert found == sorted([(i // 2 or -1, *x) for i in range(100) for x in one] + [(200, "a", 1.0)] * 2 + [(-1, *x) for x in one])


def test_extraction_stores_waiting_rows_only(spark, data):
    """between the stages lie the rows that wait for a predicate, without their concepts."""
    from claimlens.plans import queries_spo, views

    lex, kept = lexicon.build_lexicon(spark), []
    s = queries_spo.at_extraction_levels(views.with_spo(queries_spo.injected(spark, data, lex, rated=True))).where("item_id < 10")
    s = s.withColumns({c: F.lit("") for c in concepts.CONCEPT_COLUMNS})
    seen = []

    def keep(df):
        kept.append(df.persist())
        return kept[-1]

    def annotate(df, where):
        seen.append(where)
        return queries_spo.enriched(spark, data, df, where)

    out = extraction.run_spo(s, lex, queries_spo.parse_parts, keep, "full", annotate)
    assert out.count() == s.count() and len(seen) == 1
    for df in kept:
        assert df.where("review_level <> 5 or skip_validations or check_worthy_score_auto < 0.5").count() == 0 < df.count() < s.count()
        assert "candidates" not in df.columns


def test_word_ids_are_looked_up_in_their_row(spark):
    """No word leaves its row; rows of one key are still put together place by place."""
    rows = spark.createDataFrame([(1, "a b zz"), (2, ""), (2, "b a"), (None, "a"), (None, "b"), (3, None)], "id int, t string")
    index = spark.createDataFrame([("<UNK>", 1), ("a", 2), ("b", 3)], "word string, word_id int")
    out = encoding.token_ids(rows, ["id"], "t", index, 2)
    assert "Generate" not in plan(out)
    assert {r["id"]: r["ids"] for r in out.collect()} == {1: [2, 3], 2: [3, 2], None: [2, 3], 3: []}
    both = spark.createDataFrame([(1, "a b"), (1, "b a x")], "id int, t string")
    assert encoding.token_ids(both, ["id"], "t", index).first()["ids"] == [2, 3, 2, 3, 1]


def test_word_counts_are_hashed(spark):
    """The first place is one number, so words are not sorted; missing and negative keys come in their order."""
    rows = spark.createDataFrame([(5, "aa bb"), (-3, "cc aa"), (None, "bb"), (9, "cc")], "id long, t string")
    out = counts.word_counts(rows, "t", 2, ["id"])
    assert "SortAggregate" not in plan(out)
    assert {r["word"]: (r["n"], tuple(r["first_seen"])) for r in out.collect()} == {"aa": (2, (-3, 1)), "bb": (2, (None, 0)), "cc": (2, (-3, 0))}


def test_lookup_and_sums(spark):
    """A type is found without carrying the dimension in every row."""
    of = lookup([(f"k{i}", F.lit(i)) for i in range(50)], "int")
    keys = spark.createDataFrame([("k0",), ("k49",), ("no",), (None,)], "k string")
    assert [r[0] for r in keys.select(of(F.col("k"))).collect()] == [0, 49, None, None]
    lists = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 8, 9, 100)] + [(None,)], "v array<int>")
    for r in lists.select("v", running_sums(F.col("v")).alias("s")).collect():
        assert r["s"] == (None if r["v"] is None else [int(x) for x in np.cumsum(r["v"])])
    types = spark.createDataFrame([("st1", "T1", "Type 1")], "abbr string, tui string, type_name string")
    groups = spark.createDataFrame([("T1", "DISO")], "tui string, group string")
    raw = spark.createDataFrame([(1, [("st1",), ("st2",)])], "id int, raw array<struct<sem_type:string>>")
    out = concepts.enrich_nested(raw, "raw", concepts.type_lookup(types, groups))
    assert "Subquery" not in plan(out) and "Generate" not in plan(out)
    assert [tuple(c) for c in out.first()["raw"]] == [("st1", "T1", "Type 1", "DISO"), ("st2", None, None, None)]


def test_parsed_rows_carry_only_the_tags_they_are_made_of(spark):
    from claimlens.plans import views

    text = "The Zeta causes [losses] quickly in École Alpha"
    rows = views.parsed(spark, None, spark.createDataFrame([(1, text), (2, ""), (3, "plain words")], "id long, sentence string"))
    assert [f.name for f in rows.schema["tokens"].dataType.elementType] == ["token", "pos"]
    found = {r["id"]: r for r in rows.collect()}
    assert sorted(found) == [1, 3] and found[1]["root"] == 3 and found[3]["root"] == 1
    assert [(w["text"], w["xpos"], w["upos"], w["deprel"]) for w in found[1]["words"]] == [
        ("The", "DT", "DET", "dep"), ("Zeta", "NNP", "PROPN", "nsubj"), ("causes", "VBZ", "VERB", "root"), ("losses", "VBZ", "VERB", "dep"),
        ("quickly", "CC", "ADP", "dep"), ("in", "IN", "ADP", "dep"), ("École", "NN", "NOUN", "obj"), ("Alpha", "NNP", "PROPN", "obj")]


def once(df, name):
    """Whether the plan calls a batch function in one place."""
    return plan(df).count(f"ArrowEvalPython [{name}(") == 1


def test_concept_xml_is_read_once_by_batches(spark):
    """no reading of elements one by one in Spark, and none twice; odd documents give what they gave."""
    cand = ("<Candidate><CandidateCUI> C{i} </CandidateCUI><CandidatePreferred/>{types}"
            "<ConceptPIs Count='2'><ConceptPI><StartPos>3</StartPos><Length>9</Length></ConceptPI><ConceptPI><StartPos>7</StartPos></ConceptPI></ConceptPIs></Candidate>")
    typed = "<SemTypes><SemType>a&amp;b</SemType><SemType>c</SemType></SemTypes>"
    phrase = "<Phrase><PhraseText>x</PhraseText>{units}<Mappings Count='{n}'><Mapping><MappingCandidates>{c}</MappingCandidates></Mapping></Mappings></Phrase>"
    unit = "<SyntaxUnits Count='1'><SyntaxUnit><LexMatch>l</LexMatch><Tokens><Token>t</Token><Token>u</Token></Tokens></SyntaxUnit></SyntaxUnits>"
    doc = lambda *phrases: f"<MMOs><MMO><Utterances><Utterance><Phrases>{''.join(phrases)}</Phrases></Utterance></Utterances></MMO></MMOs>"
    full = phrase.format(units=unit, n=1, c=cand.format(i=1, types=typed) + cand.format(i=2, types=""))
    rows = [(1, doc(full, phrase.format(units="", n=0, c=""))), (2, doc(phrase.format(units="", n=1, c=cand.format(i=3, types="")))), (3, "<MMOs><MMO>5"), (4, None),
            (5, doc(phrase.format(units="", n=2, c=""), full))]
    df = concepts.parse_concept_xml(spark.createDataFrame(rows, "id int, xml string"), "xml")
    flat = concepts.flat_candidates(df)
    assert once(flat, "read_phrases")
    found = {r["id"]: r["phrases"] for r in df.collect()}
    assert found[2] == found[3] == found[4] == [] and [len(found[1]), len(found[5])] == [1, 2]
    assert [tuple(u) for u in found[1][0]["syntax_units"]] == [(None, "l", None, None, "t u")]
    assert found[5][0]["candidates"] is None and found[5][0]["syntax_units"] is None
    one, two = [(r["cui"], r["preferred"], r["matched"], r["sem_type"], r["matched_words"], [tuple(p) for p in r["positions"]]) for r in flat.where("id = 1").collect()]
    assert one == ("C1", "", None, "a&b", None, [(3, 9), (7, None)]) and two[:4] == ("C2", "", None, None)


def test_chunks_are_made_once_by_batches(spark):
    """chunk texts and places come from one pass over the batch."""
    kind = "id int, tokens array<struct<token:string,pos:string>>"
    rows = [(1, [("the", "DT"), ("old", "JJ"), ("tea", "NN"), ("of", "IN"), ("Rome", "NNP"), ("helps", "VBZ"), ("of", "IN")]), (2, []), (3, None),
            (4, [("a", None), (None, "NNS"), ("b", "NN")]), (5, [("x", "NN")])]
    df = tagged.noun_chunks(spark.createDataFrame(rows, kind))
    assert once(df.select("id", F.inline("chunks")), "<lambda>")
    assert {r["id"]: r["chunks"] and [tuple(c) for c in r["chunks"]] for r in df.collect()} == {
        1: [(0, True, 0, 4, "the old tea of Rome"), (1, False, 5, 5, "helps"), (2, False, 6, 6, "of")], 2: [], 3: None,
        4: [(0, False, 0, 0, "a"), (1, True, 1, 2, "b")], 5: [(0, True, 0, 0, "x")]}


def test_words_and_concepts_are_placed_by_batches(spark):
    """Word places and the concepts inside tokens need no array function per word; rows do not touch each other."""
    texts = spark.createDataFrame([(1, "é, bb  ccc."), (2, ""), (3, None), (4, "--"), (5, "a")], "id int, t string")
    spans = texts.select("id", text.token_spans(F.col("t")).alias("s"))
    assert "zip_with" not in plan(spans)
    assert {r["id"]: r["s"] and [tuple(x) for x in r["s"]] for r in spans.collect()} == {
        1: [("é", 0, ""), ("bb", 3, ", "), ("ccc", 7, "  ")], 2: [], 3: None, 4: [], 5: [("a", 0, "")]}
    given = [(["aa", "b", "cccc"], [9, 0, 1, 5, 5, None, -4]), (["aa"], []), (None, [0]), (["x", "y"], [2]), ([], [0]), (["aa"], None)]
    found = last_inside(pa.array([g[0] for g in given], pa.list_(pa.string())), pa.array([g[1] for g in given], pa.list_(pa.int32())))
    assert found.to_pylist() == [[2, None, 4], [None], None, [None, 0], [], [None]]


def test_labels_of_all_kinds_share_their_concepts(spark, data):
    """the concepts of a sentence are chosen once for the eight kinds of labels."""
    from claimlens.plans import queries_graphs

    assert plan(queries_graphs.l2(spark, data)).count("array_position") < len(queries_graphs.NODE_TYPES)
