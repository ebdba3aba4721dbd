"""Claim and topic graphs: predicate and node normalisation, triples, nodes, edges, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import broadcast_if_small, running_total, settle
from claimlens.functions.text import bracket_list, fix_label, let

BE_FORMS = ["am", "are", "is", "was", "were", "been", "being"]
HAVE_FORMS = ["has", "had", "having"]


def lemma_table(spark: SparkSession) -> DataFrame:
    """(form, lemma) of the fixed verb list and of be/have; its size is fixed (under 400 rows)."""
    rows = {}
    for base, *forms in fixed.VERB_FORMS:
        for form in [base, *forms]:
            rows.setdefault(form, base)
    rows.update({f: "be" for f in BE_FORMS} | {f: "have" for f in HAVE_FORMS})
    return spark.createDataFrame(sorted(rows.items()), "form string, lemma string")


def with_lemma(df: DataFrame, col: str, out: str) -> DataFrame:
    """Verb lemma of a column by table lookup; unknown forms stay as they are."""
    lemmas = F.broadcast(lemma_table(df.sparkSession).withColumnRenamed("form", "_form"))
    return df.join(lemmas, F.col(col) == F.col("_form"), "left").withColumn(out, F.coalesce("lemma", col)).drop("_form", "lemma")


def _last(tokens: str, tag: str) -> Column:
    return F.try_element_at(F.filter(tokens, lambda t: t["pos"] == tag), F.lit(-1))["token"]


def norm_predicate(df: DataFrame, phrasal: DataFrame, tokens: str = "p_tokens") -> DataFrame:
    """Adds ``norm_p``: one normalised verb per sentence from the tagged tokens of its predicate.

    ``tokens`` are the tagged tokens of the lower-cased big predicate; ``phrasal`` has one phrase per row.
    """
    big, single = F.lower("big_predicate"), F.lower("predicate")
    verb = F.coalesce(*[_last(tokens, tag) for tag in fixed.VERB_TAG_PRIORITY], F.lit(""))
    free = F.col("spo_type").isin(*fixed.FREE_FORM_TYPES) & (F.size(F.filter(F.split("predicate", r"\s+"), lambda w: w != "")) == 1)
    verb = F.when(free & ((F.length(verb) < 2) | (verb != single)), single).otherwise(verb)
    several = (F.size(tokens) > 1) | (F.size(F.filter(F.split(big, r"\s+"), lambda w: w != "")) > 1)
    whole = F.array_join(F.transform(F.filter(F.split(big, r"\s+"), lambda w: w != ""), lambda w: F.when(w == "’re", "are").otherwise(w)), " ")
    negated = several & F.exists(tokens, lambda t: t["token"].isin(*fixed.NEGATIONS))
    known = broadcast_if_small(phrasal.select(F.col("phrase").alias("_phrase")).distinct())
    # what the tokens are needed for is taken from them first, so that a row that has to travel does so without them
    parts = {"_single": single, "_verb": verb, "_several": several, "_noun": _last(tokens, "NN"), "_whole": whole, "_negated": negated}
    out = df.withColumns(parts).join(known, F.col("_single") == F.col("_phrase"), "left")
    fallback = F.coalesce("_phrase", "_noun", F.lit(""))
    out = out.withColumn("_pick", F.when(F.col("_several"), F.when(F.col("_verb") != "", F.col("_verb")).otherwise(fallback)).otherwise(F.col("_whole")))
    out = with_lemma(out, "_pick", "_lemma")
    name = F.when(F.col("_lemma") == "be", "is").otherwise(F.col("_lemma"))
    norm = F.when(F.col("_negated"), F.concat(F.lit("not "), name)).otherwise(name)
    return out.withColumn("norm_p", norm).drop(*parts, "_phrase", "_pick", "_lemma")


UNIQUE_TYPES = ["sem_group", "sem_type", "sem_type_name"]


def first_concepts(tokens: Column, groups: Column) -> Column:
    """Aligned tokens with a known concept in allowed groups, the first token per concept."""
    usable = let(groups, lambda g: F.filter(tokens, lambda t: (t["cui"] != fixed.UNKNOWN) & F.array_contains(g, t["group"])))
    first_per_cui = lambda kept: let(F.transform(kept, lambda t: t["cui"]), lambda ids: F.filter(
        kept, lambda t, i: F.array_position(ids, t["cui"]) == i + 1))
    return let(usable, first_per_cui)


def norm_nodes(tokens: Column, groups: Column, node_type: str, brackets: bool = True) -> Column:
    """Node labels of aligned tokens: known concepts in allowed groups, first token per concept."""
    return node_labels(first_concepts(tokens, groups), node_type, brackets)


def node_labels(first: Column, node_type: str, brackets: bool = True) -> Column:
    """Labels of the tokens that ``first_concepts`` leaves."""
    box = lambda *cols: F.concat(*[x for c in cols for x in (F.lit("["), c, F.lit("]"))])
    label = {
        "sem_group": lambda t: t["group"], "sem_type": lambda t: t["sem_type"], "sem_type_name": lambda t: t["type_name"],
        "cui": lambda t: t["cui"], "text_cui": lambda t: t["preferred"], "sem_type_sem_group": lambda t: box(t["sem_type"], t["group"]),
        "cui_all": lambda t: box(t["cui"], t["sem_type"], t["group"]), "text_cui_all": lambda t: box(t["preferred"], t["sem_type"], t["group"]),
    }[node_type]
    out = F.transform(first, lambda t: box(fix_label(label(t))) if brackets else fix_label(label(t)))
    return F.array_distinct(out) if node_type in UNIQUE_TYPES else out


def _read(tokens: Column, node_type: str) -> Column:
    """Known concepts of aligned tokens with no more fields than their labels are made of: what travels to the rules."""
    fields = {"sem_type_name": ["type_name"], "text_cui": ["preferred"], "sem_type_sem_group": ["sem_type"], "cui_all": ["sem_type"],
              "text_cui_all": ["preferred", "sem_type"], "sem_type": ["sem_type"]}.get(node_type, [])
    known = F.filter(tokens, lambda t: t["cui"] != fixed.UNKNOWN)
    return F.transform(known, lambda t: F.struct(*[t[f].alias(f) for f in ["cui", "group", *fields]]))


def with_valid_groups(df: DataFrame, rules: DataFrame, default: list[str] = fixed.DEFAULT_GROUPS) -> DataFrame:
    """Adds the allowed subject and object groups of ``norm_p``; the default where a rule is missing or empty."""
    out = df.join(rules.withColumnRenamed("predicate", "norm_p"), "norm_p", "left")
    fill = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(*[F.lit(g) for g in default]))
    return out.withColumns({"subject_groups": fill("subject_groups"), "object_groups": fill("object_groups")})


def sentence_graph(df: DataFrame, phrasal: DataFrame, rules: DataFrame, node_type: str = "cui", brackets: bool = True) -> DataFrame:
    """Adds what a sentence gives the graph: ``norm_p``, the groups its predicate allows, and the labels ``norm_s`` and ``norm_o``.

    ``df`` has tagged predicate tokens ``p_tokens`` and aligned concepts ``s_ext`` and ``o_ext``; ``triples`` makes edges of the
    result, by token or joined, and ``predicate_report`` its predicate counts.
    """
    named = with_valid_groups(norm_predicate(df.withColumns({"_s": _read(F.col("s_ext"), node_type), "_o": _read(F.col("o_ext"), node_type)}), phrasal), rules)
    return named.withColumns({
        "norm_s": norm_nodes(F.col("_s"), F.col("subject_groups"), node_type, brackets),
        "norm_o": norm_nodes(F.col("_o"), F.col("object_groups"), node_type, brackets)}).drop("_s", "_o")


def predicate_report(df: DataFrame, order: str = "new_sentence_id") -> DataFrame:
    """(norm_p, n, first_seen) of a sentence graph."""
    return df.groupBy("norm_p").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def triple_rows(df: DataFrame, by_token: bool | None = True) -> DataFrame:
    """Rows of the triple file: item_id, sentence_id, subject, predicate, object and both group lists.

    By token every subject label stands with every object label; joined, a sentence gives its own words and its labels.
    ``None`` gives the rows of both, with their ``layout``, in one pass over the sentences.
    """
    rows = settle(df.select("item_id", F.col("id").alias("sentence_id"), "big_subject", "big_object", "norm_p", "norm_s", "norm_o",
                            *[F.array_join(c, ",").alias(c) for c in ("subject_groups", "object_groups")]), "norm_s", "norm_o")
    # each entry has a subject and the objects that it stands with; an entry's triples leave one by one
    entry = lambda layout, s, o, x, y: F.struct(
        F.lit(layout).alias("layout"), s.alias("subject"), o.alias("_objects"), x.alias("subject_groups"), y.alias("object_groups"))
    groups, blank = (F.col("subject_groups"), F.col("object_groups")), (F.lit(""), F.lit(""))
    tokens = F.transform("norm_s", lambda s: entry("by token", s, F.col("norm_o"), *groups))
    joined = F.array(entry("joined", F.col("big_subject"), F.array("big_object"), *blank),
                     entry("joined", F.array_join("norm_s", " "), F.array(F.array_join("norm_o", " ")), *blank))
    entries = joined if by_token is False else tokens if by_token else F.when(F.col("norm_s").isNull(), joined).otherwise(F.concat(tokens, joined))
    keep = ["item_id", "sentence_id", F.col("norm_p").alias("predicate")]
    one = rows.select(*keep, F.inline(entries)).select("item_id", "sentence_id", "layout", "subject", "predicate", F.explode("_objects").alias("object"), "subject_groups", "object_groups")
    return one if by_token is None else one.drop("layout")


def triples(df: DataFrame, by_token: bool = True) -> DataFrame:
    """(s, p, o) rows of a sentence in order: every subject label with every object label, or one joined triple.

    ``place`` numbers the triples of a sentence from 0.
    """
    keep = ["item_id", "new_sentence_id", "sentence_class"]
    both = (F.size("norm_s") > 0) & (F.size("norm_o") > 0)
    if by_token:
        n = F.size("norm_o")
        s = df.where(both).select(*keep, "norm_p", "norm_o", F.posexplode("norm_s").alias("_i", "s"))
        return s.select(*keep, "s", F.col("norm_p").alias("p"), n.alias("_n"), "_i", F.posexplode("norm_o").alias("_j", "o")).select(
            *keep, "s", "p", "o", (F.col("_i") * F.col("_n") + F.col("_j")).alias("place"))
    return df.where(both).select(*keep, F.array_join("norm_s", " ").alias("s"), F.col("norm_p").alias("p"),
                                 F.array_join("norm_o", " ").alias("o"), F.lit(0).alias("place"))


def with_membership(t: DataFrame) -> DataFrame:
    """Each triple followed by the three "included in the item" edges of its parts; ``place`` renumbered."""
    item = F.concat(F.lit("item_"), F.col("item_id").cast("string"))
    edge = lambda s, p, o: F.struct(s.alias("src"), p.alias("rel"), o.alias("dst"))
    inside = F.lit("included_in")
    edges = F.array(edge(F.col("s"), F.col("p"), F.col("o")), *[edge(F.col(c), inside, item) for c in ("s", "p", "o")])
    return t.select("item_id", "new_sentence_id", "sentence_class", "place", F.posexplode(edges).alias("_k", "e")).select(
        "item_id", "new_sentence_id", "sentence_class", (F.col("place") * 4 + F.col("_k")).alias("place"), "e.*")


def nodes(edges: DataFrame, order: str | Column) -> DataFrame:
    """Distinct endpoints with the place of their first appearance (source before target)."""
    at = F.col(order) if isinstance(order, str) else order
    ends = edges.select(at.alias("_at"), F.posexplode(F.array("src", "dst")).alias("_side", "node"))
    first = ends.groupBy("node").agg((F.min(F.col("_at") * 2 + F.col("_side"))).alias("first_seen"))
    return first


def number_edges(edges: DataFrame, key: str = "new_sentence_id", place: str = "place") -> DataFrame:
    """Edge ids 1..n in reading order; equal edges are kept.

    ``key`` grows in reading order (``number_sentences`` makes it so) and ``place`` counts from 0 within a key.
    """
    per_key = edges.groupBy(key).agg(F.count("*").alias("_n"))
    offsets = running_total(per_key, key, "_n", "_before").select(key, "_before")
    return edges.join(offsets, key).withColumn("edge_id", F.col("_before") + F.col(place) + 1).drop("_before")


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_predicates(counts: DataFrame) -> DataFrame:
    """(norm_p, n) by frequency, ties by first appearance."""
    return counts.orderBy(F.desc("n"), F.asc("first_seen"))


def claim_graph(items: DataFrame) -> DataFrame:
    """One edge per corpus item from its bracketed main claim; the predicate is lemmatised. Short claims give nulls."""
    parts = bracket_list(F.col("main_claim"))
    part = lambda i: F.get(parts, F.lit(i))
    rows = items.select(F.col("id").alias("item_id"), "item_class_4", part(0).alias("src"), part(1).alias("_rel"), part(2).alias("dst"))
    return with_lemma(rows, "_rel", "rel").select("item_id", "item_class_4", "src", "rel", "dst")


def topic_graph(items: DataFrame) -> DataFrame:
    """(item, class, topic) edges from the bracketed topics."""
    return items.select(F.col("id").cast("string").alias("src"), F.col("item_class_4").alias("rel"),
                        F.posexplode(bracket_list(F.col("main_topic"))).alias("place", "dst"))
