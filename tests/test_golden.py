"""Hand-written cases for behaviour the given tables do not reach."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import gather_ordered, running_total, shared_path, split_join
from claimlens.functions import pvalues, tagged, text
from claimlens.operators import articles, concepts, counts, encoding, evaluation, graphs, lexicon, models, parsed, texts
from claimlens.operators import ingest as posts_ingest
from claimlens.sources import sinks, tables
from claimlens.streaming import ingest, levels

WORD = "id int, text string, upos string, xpos string, head int, deprel string, feats string, start_char int, end_char int"


def words(*rows):
    """(text, upos, xpos, head, deprel[, feats]) rows; words are one blank apart unless the text starts with '+'."""
    out, at = [], 0
    for i, row in enumerate(rows, 1):
        t, upos, xpos, head, rel, *feats = row
        glue, t = t.startswith("+"), t.lstrip("+")
        at = at if glue or i == 1 else at + 1
        out.append((i, t, upos, xpos, head, rel, feats[0] if feats else "", at, at + len(t)))
        at += len(t)
    return out


def read(spark, fn, *rows):
    df = spark.createDataFrame([(1, words(*rows))], f"id int, words array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>")
    r = fn(df).first()["spo"]
    return tuple(r) if r else None


def test_sentence_reading(spark):
    subject = ("masks", "NOUN", "NNS", 4, "nsubj")
    assert read(spark, parsed.spo_parsed, subject, ("ca", "AUX", "MD", 4, "aux"), ("+n't", "PART", "RB", 4, "advmod"),
                ("stop", "VERB", "VB", 0, "root"), ("viruses", "NOUN", "NNS", 4, "obj"), ("today", "NOUN", "NN", 5, "obl")) == (
        "masks", "stop", "viruses", "masks", "can't stop", "viruses today")
    # pronoun subject only without a noun; adjective complement as object
    assert read(spark, parsed.spo_parsed, ("They", "PRON", "PRP", 2, "nsubj"), ("seem", "VERB", "VBP", 0, "root"),
                ("safe", "ADJ", "JJ", 2, "xcomp")) == ("They", "seem", "safe", "They", "seem", "safe")
    # no object: no result; object before the predicate: short parts only
    assert read(spark, parsed.spo_parsed, ("dogs", "NOUN", "NNS", 2, "nsubj"), ("bark", "VERB", "VBP", 0, "root")) is None
    assert read(spark, parsed.spo_parsed, ("pills", "NOUN", "NNS", 3, "obj"), ("people", "NOUN", "NNS", 3, "nsubj"),
                ("take", "VERB", "VBP", 0, "root")) == ("people", "take", "pills", "", "take", "")


def test_clause_reading(spark):
    # nominal root: the copula becomes the predicate, and only its own children count
    assert read(spark, parsed.spo_clause, ("which", "PRON", "WDT", 2, "nsubj", "PronType=Rel"), ("cures", "VERB", "VBZ", 0, "root"),
                ("flu", "NOUN", "NN", 2, "obl")) == ("which", "cures", "flu", "which", "cures", "flu")
    assert read(spark, parsed.spo_clause, ("tea", "NOUN", "NN", 2, "nsubj:pass"), ("made", "VERB", "VBN", 0, "root"), ("x", "NOUN", "NN", 2, "obj")) is None


def test_lexicon_size_and_order(spark):
    lex = lexicon.build_lexicon(spark)
    kinds = {r["kind"]: r["n"] for r in lex.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"given long": 148421, "given short": 365}
    assert lexicon.be_have_lexicon(spark).count() == 69
    first = [r["phrase"] for r in lex.orderBy("priority").limit(2).collect()]
    assert first == ["is causing", "are causing"]
    assert lexicon.longest_phrase() == 6


def test_lexicon_match_equals_ordered_regex_search(spark):
    """The equi-join gives what trying every phrase in order gives."""
    random.seed(3)
    phrases = ["is causing", "won't be causing", "can cause", "cause", "causes", "is", "have been", "has"]
    lex = spark.createDataFrame([(p, "k", i) for i, p in enumerate(phrases)], "phrase string, kind string, priority long")
    vocab = ["is", "causing", "Won’t", "be", "can", "cause", "causes", "have", "been", "has", "tea", "élan", "x-ray", "it's", ","]
    sentences = [(i, " ".join(random.choice(vocab) for _ in range(random.randint(1, 9)))) for i in range(400)]
    expected = {}
    for i, s in sentences:
        low = s.lower().replace("’", "'")
        for p in phrases:
            m = re.search(rf"\b{re.escape(p)}\b", low)
            if m and m.start() > 0 and len(s) > m.start() + len(p):
                expected[i] = (p, m.start())
                break
    df = spark.createDataFrame(sentences, "id long, sentence string")
    got = {r["id"]: (r["phrase"], r["at"]) for r in lexicon.match_lexicon(df, lex).collect()}
    assert got == expected


def brute_walk(tokens, sentence, starts):
    out, at = [], 0
    for tok in tokens:
        hit = None
        for ch in tok:
            for i, s in enumerate(starts):
                if s == at:
                    hit = i
            if sentence[at] == ch and at < len(sentence) - 1:
                at += 1
            if sentence[at] == " " and at < len(sentence) - 1:
                at += 1
        out.append(hit)
    return out


CAND = "cui:string,preferred:string,sem_type:string,tui:string,type_name:string,group:string,start_pos:int"


def test_alignment_on_irregular_text(spark):
    cases = [("green  tea cures flu", "green tea", "cures", "flu", [0, 7, 11, 17]), ("a b", "a", "x", "b", [0, 2]), ("tea, cures", "tea", "cures", "q", [0, 5])]
    rows = [(i, t, s, p, o, [(f"C{k}", f"p{k}", "st", "T1", "n", "DISO", k) for k in starts]) for i, (t, s, p, o, starts) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"id int, sentence string, big_subject string, predicate string, big_object string, candidates array<struct<{CAND}>>")
    for r, (t, s, p, o, starts) in zip(concepts.align_concepts(df).orderBy("id").collect(), cases):
        want = [fixed.UNKNOWN if h is None else f"C{starts[h]}" for h in brute_walk(f"{s} {p} {o}".split(), t, starts)]
        assert [x["cui"] for x in [*r["s_ext"], *r["p_ext"], *r["o_ext"]]] == want


def test_alignment_is_empty_without_input(spark):
    df = spark.createDataFrame([(1, "a b c", "a", "", "c", [])], f"id int, sentence string, big_subject string, predicate string, big_object string, candidates array<struct<{CAND}>>")
    r = concepts.align_concepts(df).first()
    assert r["s_ext"] == [] and r["o_ext"] == []


def test_concept_xml(spark):
    cand = ("<Candidate><CandidateCUI>C1</CandidateCUI><CandidateMatched>Tea</CandidateMatched><CandidatePreferred>Tea plant</CandidatePreferred>"
            "<MatchedWords Count='2'><MatchedWord>green</MatchedWord><MatchedWord>tea</MatchedWord></MatchedWords>"
            "<SemTypes Count='{n}'>{types}</SemTypes><Negated>0</Negated><ConceptPIs Count='1'><ConceptPI><StartPos>3</StartPos><Length>9</Length></ConceptPI></ConceptPIs></Candidate>")
    doc = ("<MMOs><MMO><Utterances Count='1'><Utterance><Phrases Count='2'><Phrase><PhraseText>x</PhraseText><SyntaxUnits Count='0'/><Mappings Count='0'/></Phrase>"
           "<Phrase><PhraseText>green tea</PhraseText><SyntaxUnits Count='0'/><Mappings Count='1'><Mapping><MappingCandidates Total='1'>{c}</MappingCandidates></Mapping></Mappings>"
           "</Phrase></Phrases></Utterance></Utterances></MMO></MMOs>")
    rows = [(1, doc.format(c=cand.format(n=2, types="<SemType>food</SemType><SemType>plnt</SemType>"))), (2, doc.format(c=cand.format(n=0, types=""))), (3, "<MMOs><broken")]
    df = concepts.parse_concept_xml(spark.createDataFrame(rows, "id int, xml string"), "xml")
    assert {r["id"]: len(r["phrases"] or []) for r in df.collect()} == {1: 1, 2: 0, 3: 0}
    flat = concepts.flat_candidates(df).collect()
    assert [(f["sem_type"], f["matched_words"], f["positions"][0]["start_pos"]) for f in flat] == [("food", "green tea", 3)]


def test_dimension_and_rule_files(spark):
    base = shared_path(spark, "files")
    write = lambda name, lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{base}/{name}")
    write("types", ["food|T168|Food", "plnt|T002|Plant"])
    write("groups", ["OBJC|Objects|T168|Food", "LIVB|Living Beings|T002|Plant"])
    write("rules", ["cause\t3\t['DISO', 'CHEM']\t[]", "cause\t3\t['GENE']\t[]", "broken line", "help\t1\t[]\t['ANAT']"])
    lookup = concepts.type_lookup(tables.load_sem_types(spark, f"{base}/types"), tables.load_sem_groups(spark, f"{base}/groups"))
    r = spark.range(1).select(F.try_element_at(lookup, F.lit("plnt")).alias("x")).first()["x"]
    assert (r["tui"], r["group"]) == ("T002", "LIVB")
    rules = {r["predicate"]: (r["subject_groups"], r["object_groups"]) for r in tables.load_valid_groups(spark, f"{base}/rules").collect()}
    assert rules == {"cause": (["GENE"], []), "help": ([], ["ANAT"])}


def test_sentence_split_keeps_closing_quotes(spark):
    doc = "He said “go.” Then left.<annotate_paragraph>Two\\nparts.  End"
    got = spark.range(1).select(text.split_sentences(F.lit(doc)).alias("s")).first()["s"]
    assert got == ["He said “go.”", "Then left.", "Two parts.", "End"]


def test_multiword_names(spark):
    toks = [("green", "JJ", "", False), ("tea", "NN", "", False), ("leaf", "NN", "", False), ("cures", "VBZ", "", False), ("flu", "NN", "", False)]
    df = spark.createDataFrame([(1, toks)], "id int, tokens array<struct<token:string,pos:string,dep:string,is_stop:boolean>>")
    assert sorted(r["name"] for r in tagged.multiword_names(df, ["id"]).collect()) == ["green_tea", "green_tea_leaf", "tea_leaf"]


def test_variable_encoding_equals_popping(spark):
    random.seed(5)
    rows = [(i, *[[9] * random.randint(0, n) for n in (14, 6, 14)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, s array<int>, p array<int>, o array<int>")
    got = {r["id"]: r["e"] for r in df.select("id", encoding.encode_spo_variable(F.col("s"), F.col("p"), F.col("o"), 16, 1, 2).alias("e")).collect()}
    for i, s, p, o in rows:
        ns, no = len(s), len(o)
        while ns + len(p) + no + 4 > 16:
            if ns > no:
                ns -= 1
            else:
                no -= 1
        want = [1] + [9] * ns + [2] + [9] * len(p) + [2] + [9] * no + [2]
        e = got[i]
        assert e["ids"] == want + [0] * (16 - len(want)) and len(e["mask"]) == len(e["segments"]) == 16


def test_p_values():
    assert pvalues.t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert pvalues.signed_rank_p(0, 5, 0, 0, "two-sided") == pytest.approx(2 / 32)
    assert pvalues.signed_rank_p(15, 5, 0, 0, "greater") == pytest.approx(1 / 32)
    # published example of the normality test (11 body weights)
    x = sorted([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    a, mean = pvalues.order_weights(11), sum(x) / 11
    w = sum(c * v for c, v in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    assert w == pytest.approx(0.79, abs=0.005) and pvalues.normality_p(w, 11) == pytest.approx(0.0067, abs=5e-4)


def test_fleiss_published_example(spark):
    rows = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    df = spark.createDataFrame([(r,) for r in rows], "counts array<int>")
    assert evaluation.fleiss_kappa(df, "counts", 5).first()["kappa"] == pytest.approx(0.210, abs=1e-3)


def test_hot_key_helpers_keep_every_row(spark):
    """One key owns most rows: nothing is lost, and order is kept."""
    big = spark.range(20000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert split_join(big, small, "k", F.col("id")).count() == 20000
    gathered = gather_ordered(big.withColumn("k", F.expr("if(k = 3, null, k)")), ["k"], "id", F.struct("id", F.col("id").cast("string").alias("t")), "ids")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # groups over many batches
    try:
        lists = {r["k"]: [x["id"] for x in r["ids"]] for r in gathered.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(20000):
        k = 7 if i % 3 else i % 50
        want.setdefault(None if k == 3 else k, []).append(i)
    assert lists == want and len(lists[7]) > 13000


def test_running_total_over_blocks(spark):
    keys = [0, 1, 65535, 65536, 70000, 2 ** 32, 2 ** 32 + 1, 2 ** 40]
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "k long, n long")
    got = {r["k"]: r["before"] for r in running_total(df, "k", "n", "before").collect()}
    total = 0
    for i, k in enumerate(keys):
        assert got[k] == total
        total += i + 1


def test_new_rows_keeps_one_copy_per_key(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, v int")
    old = spark.createDataFrame([("b",)], "key string")
    assert [(r["key"], r["v"]) for r in posts_ingest.new_rows(new, old, ["key"]).collect()] == [("a", 1)]


def test_padded_class_weights():
    assert counts.padded_weights([1.0, 2.0], 4) == [0.0, 0.0, 1.0, 2.0]


def test_shares_divide_by_labelled_sentences(spark):
    items = spark.createDataFrame([(1,), (2,)], "id long")
    s = spark.createDataFrame([(1, 9, "F", 0.9, 0.2), (1, 9, "", 0.7, 0.2)], "item_id long, review_level int, sentence_class_auto string, sentence_class_score_auto double, check_worthy_score_auto double")
    got = {r["id"]: r for r in articles.item_features(items, s, 9).collect()}
    assert got[1]["t05_perc"] == 2.0 and got[1]["score_avg"] == pytest.approx(1.6) and got[2]["f_perc"] == 0.0


def test_short_claims_give_nulls(spark):
    items = spark.createDataFrame([(1, "T", "[a][causes][b]"), (2, "F", "[a]")], "id long, item_class_4 string, main_claim string")
    got = {r["item_id"]: (r["src"], r["rel"], r["dst"]) for r in graphs.claim_graph(items).collect()}
    assert got == {1: ("a", "cause", "b"), 2: ("a", None, None)}


def test_byte_cut_splits_the_boundary_row(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "defg"), (3, "h")], "id long, t string")
    assert [(r["id"], r["t"]) for r in texts.head_bytes(df, "id", "t", 5).orderBy("id").collect()] == [(1, "abc"), (2, "de")]


def test_byte_cut_keeps_whole_characters(spark):
    rows = spark.createDataFrame([(1, "aé"), (-5, "x\U0001f600y"), (7, "later")], "k long, t string")
    for limit, want in ((1, ["x"]), (4, ["x"]), (5, ["x\U0001f600"]), (6, ["x\U0001f600y"]), (8, ["x\U0001f600y", "a"]), (9, ["x\U0001f600y", "aé"]), (99, ["x\U0001f600y", "aé", "later"])):
        assert [r["t"] for r in texts.head_bytes(rows, "k", "t", limit).orderBy("k").collect()] == want


def test_old_posts_are_stored_too_and_replays_add_none(spark):
    source, posts, offsets = (shared_path(spark, x) for x in ("in", "posts", "offsets"))
    schema = "id_str string, created_at timestamp, user_id_str string"

    def run():
        ingest.ingest_posts(ingest.read_posts(spark, source, spark.read.schema(schema).parquet(source).schema), posts, offsets, crawl_date="x").awaitTermination()
        return sorted((r["id_str"], r["created_at"].year) for r in spark.read.parquet(posts).collect())

    for rows in ([("a", "2024-03-01"), ("b", "2024-03-02")], [("c", "1999-01-01"), ("a", "2025-03-01"), ("c", "1999-01-01")]):
        spark.createDataFrame([(i, t, "u") for i, t in rows], "id_str string, t string, user_id_str string").select("id_str", F.to_timestamp("t").alias("created_at"), "user_id_str").write.mode("append").parquet(source)
        found = run()
    assert found == [("a", 2024), ("b", 2024), ("c", 1999)]
    commits = f"{offsets.removeprefix('file:')}/commits"
    last = max(n for n in os.listdir(commits) if n.isdigit())
    for name in (last, f".{last}.crc"):
        os.remove(f"{commits}/{name}")  # as if the last batch had failed after writing: it is run again
    assert run() == found and os.path.exists(f"{commits}/{last}")


def test_stages_move_rows_between_levels(spark):
    path, offsets = shared_path(spark, "levels"), shared_path(spark, "offsets")
    levels.create(spark.createDataFrame([(i, i % 4) for i in range(40)], "id int, review_level int"), path)
    first = levels.version(spark, path)

    def up(df):
        return df.withColumn("review_level", F.when(F.col("id") < 20, F.col("review_level") + 1).otherwise(F.col("review_level")))

    def failing(df):
        return df.select("id", F.expr("cast(assert_true(id < 5) is null as int)").alias("review_level"))

    with pytest.raises(Exception):
        levels.move(spark, path, failing, 2)
    assert levels.version(spark, path) == first  # a failed stage changes nothing
    levels.run_stage(spark, path, up, 2, offsets).awaitTermination()
    assert levels.move(spark, path, up, 3) and not levels.move(spark, path, up, 9)
    levels.run_stage(spark, path, lambda df: df.where("false"), 7, shared_path(spark, "offsets")).awaitTermination()
    found = {r["id"]: r["review_level"] for r in levels.read(spark, path).collect()}
    assert found == {i: (4 if i < 20 else i % 4) if i % 4 >= 2 else i % 4 for i in range(40)}
    assert levels.read(spark, path, 2).count() == 5 and levels.read(spark, path, 9).count() == 0
    untouched = {f for f, n in first[1] if n < 2}
    assert untouched <= {f for f, _ in levels.version(spark, path)[1]}  # other levels are not rewritten


def test_text_features_keep_every_term(spark):
    rows = spark.createDataFrame([(i, f"common word{i} only{i * 7}") for i in range(300)], "id int, text string")
    terms, columns = models.shared_columns(rows, models.LINEAR_WIDTH)
    assert terms == 601 and columns >= 600
    assert models.shared_columns(rows, 64) == (601, 64)
    first = models.tfidf_stages(rows).transform(rows).select("features").first()["features"]
    assert first.size == models.LINEAR_WIDTH and first.numNonzeros() == 3 and first.norm(2) == pytest.approx(1)


def test_sweep_equals_single_runs(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 7 > 3)) for i in range(120)], "id int, a double, b double, label double")
    ready = models.assemble(rows, ["a", "b"])
    train, test = ready.where("id % 3 > 0"), ready.where("id % 3 = 0")
    fit = lambda seed, trees: models.tree_model(train, "forest", trees, seed)
    found = {r["model"]: r for r in models.sweep([{"trees": 1}, {"trees": 3}], [5, 6], fit, test, ["1.0"]).collect()}
    assert sorted(found) == ["trees_1_seed_5", "trees_1_seed_6", "trees_3_seed_5", "trees_3_seed_6"]
    one = evaluation.evaluate(models.tree_job(train, test, "forest", 3, 6), "label", "prediction", ["1.0"]).first()
    assert [found["trees_3_seed_6"][c] for c in one.__fields__] == pytest.approx(list(one))


def test_cache_follows_its_data(spark):
    folder, built = shared_path(spark, "cache"), []

    def build(df):
        built.append(1)
        return df.groupBy("k").count()

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, None)], "k int, v string")
    mixed = rows.select("v", "k").orderBy(F.desc("k")).repartition(3)
    for source, times in ((rows, 1), (mixed, 1), (rows.distinct(), 2), (rows.where("v = 'b'"), 3), (rows, 3), (rows.withColumn("k", F.col("k").cast("long")), 4), (rows.where("false"), 5)):
        found = sinks.cached("x", folder, build, source)
        assert len(built) == times and found.count() == source.select("k").distinct().count()


def test_extraction_modes(spark, data):
    """Each mode touches its own sentences: full by automatic score, augmented by manual predicates only."""
    from claimlens.plans import queries_spo, views

    before = {r["id"]: r for r in queries_spo.at_extraction_levels(views.with_spo(queries_spo.injected(spark, data, lexicon.build_lexicon(spark), rated=True))).collect()}
    full = queries_spo.p11_full(spark, data).collect()
    assert len(full) == len(before)
    for r in full:
        b = before[r["id"]]
        chosen = b["review_level"] == 5 and not b["skip_validations"] and b["check_worthy_score_auto"] >= 0.5
        cleared = b["review_level"] <= 5 and not b["predicate_not_found"]
        if cleared and not chosen:
            assert r["predicate"] == ""
        assert chosen or not any(r[c] for c in ("subject_cuis", "predicate_cuis", "object_cuis"))
    assert any(r["predicate"] for r in full if before[r["id"]]["review_level"] == 5)
    for r in queries_spo.p11_augmented(spark, data).collect():
        b = before[r["id"]]
        if r["predicate"] and b["review_level"] == 5 and not b["predicate_not_found"]:
            assert r["predicate"].lower() == b["manually_identified_predicate"].lower()

