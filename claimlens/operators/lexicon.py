"""Predicate phrase lexicon and its match against sentences by probing a broadcast trie."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import settle
from claimlens.functions.text import RUN, let, white_tokens
from claimlens.operators.updates import external, worthy


def phrase_patterns() -> list[tuple[int, str, str]]:
    """(pattern_no, words before the verb, verb form) for one verb, in priority order."""
    rows = []
    for lead, modified, joint, form in fixed.PHRASE_SHAPES:
        for head in fixed.LEADS[lead]:
            for modifier in fixed.MODIFIERS if modified else [""]:
                rows.append((len(rows), " ".join(w for w in (head, modifier, joint) if w), form))
    return rows


def first_words() -> list[str]:
    """Every word run a lexicon phrase can start with."""
    starts = [lead for leads in fixed.LEADS.values() for lead in leads]
    starts += [form for row in fixed.VERB_FORMS for form in row] + fixed.EXTRA_SHORT
    return sorted({re.match(r"\w+", s).group(0) for s in starts})


def longest_phrase() -> int:
    """Most word runs in any phrase (an apostrophe splits a run), from the fixed lists."""
    runs = lambda s: len(re.findall(r"\w+", s))
    return max(runs(lead) for _, lead, _ in phrase_patterns()) + 1


def _verbs(spark: SparkSession) -> DataFrame:
    rows = [(no, form, word) for no, words in enumerate(fixed.VERB_FORMS) for form, word in zip(fixed.SHORT_FORMS, words)]
    return spark.createDataFrame(rows, "verb_no int, form string, verb string")


def build_lexicon(spark: SparkSession) -> DataFrame:
    """(phrase, kind, priority): every long phrase by verb and pattern, then the short forms.

    The size is fixed by the word lists (148,786 phrases, about 5 MB), so it may always be broadcast.
    """
    patterns = spark.createDataFrame(phrase_patterns(), "pattern_no int, lead string, form string")
    per_verb, verbs = len(phrase_patterns()), len(fixed.VERBS)
    number = spark.range(per_verb * verbs).select(
        F.col("id").alias("priority"),
        F.floor(F.col("id") / per_verb).cast("int").alias("verb_no"),
        (F.col("id") % per_verb).cast("int").alias("pattern_no"))
    long = (
        number.join(F.broadcast(patterns), "pattern_no").join(F.broadcast(_verbs(spark)), ["verb_no", "form"])
        .select(F.concat_ws(" ", "lead", "verb").alias("phrase"), F.lit("given long").alias("kind"), "priority")
    )
    order = F.array_position(F.array(*[F.lit(f) for f in fixed.SHORT_FORMS]), F.col("form")) - 1
    short = _verbs(spark).select(
        F.col("verb").alias("phrase"), F.lit("given short").alias("kind"),
        (F.lit(per_verb * verbs) + F.col("verb_no") * 4 + order).alias("priority"))
    extra = spark.createDataFrame(
        [(p, "given short", per_verb * verbs + 4 * verbs + i) for i, p in enumerate(fixed.EXTRA_SHORT)],
        "phrase string, kind string, priority long")
    return long.unionByName(short).unionByName(extra)


def be_have_lexicon(spark: SparkSession) -> DataFrame:
    phrases = [f"{m} be" for m in fixed.MODAL_AUX] + fixed.CONTINUOUS_AUX + fixed.PERFECT_AUX
    return spark.createDataFrame(
        [(p, "be-have", i) for i, p in enumerate(phrases)], "phrase string, kind string, priority long")


def best_per_phrase(lexicon: DataFrame) -> DataFrame:
    """A phrase listed twice keeps its first place."""
    return lexicon.groupBy("phrase").agg(F.min_by("kind", "priority").alias("kind"), F.min("priority").alias("priority"))


def match_text(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("’"), F.lit("'"))


def prefixes(lexicon: DataFrame) -> DataFrame:
    """The lexicon as a trie: every start of a phrase that ends with a word run; kind and priority where a phrase ends there."""
    phrases = settle(best_per_phrase(lexicon).withColumns({"_w": F.regexp_extract_all("phrase", F.lit(RUN), F.lit(0)), "_g": F.split("phrase", RUN)}), "_w", "_g")
    joined = F.zip_with("_g", "_w", lambda g, w: F.concat(g, w))
    ends = phrases.select("phrase", "kind", "priority", joined.alias("_r"), F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("_n"))
    nodes = ends.select(F.array_join(F.slice("_r", F.lit(1), F.col("_n")), "").alias("prefix"), "phrase", "kind", "priority")
    own = F.col("prefix") == F.col("phrase")
    return nodes.groupBy("prefix").agg(F.max(F.when(own, F.col("kind"))).alias("kind"), F.max(F.when(own, F.col("priority"))).alias("priority"))


def place(low: Column, phrase: Column) -> Column:
    """Zero-based start of the leftmost word-bounded place of a phrase, taken literally, in ``low``; null without one."""
    before = F.regexp_extract_all(low, F.concat(F.lit(r"(?sU)^(.*?)\b\Q"), phrase, F.lit(r"\E\b")), F.lit(1))
    return F.length(F.get(before, F.lit(0)))


def lexicon_hits(sent: DataFrame, lexicon: DataFrame, text: str = "sentence", key: str = "id") -> DataFrame:
    """(key, hits): the distinct phrases that occur in a sentence as (priority, kind, phrase), best first; no row without one.

    The lexicon's trie is fixed in size and broadcast. It is probed one word run further at a time, from every run that can
    start a phrase, so the work is linear in the text. Only hits are shuffled, once, by sentence.
    """
    trie, longest = F.broadcast(prefixes(lexicon)), longest_phrase()
    low = sent.select(key, match_text(F.col(text)).alias("_t"))
    runs = settle(low.select(key, F.regexp_extract_all("_t", F.lit(RUN), F.lit(0)).alias("_w"), F.split("_t", RUN).alias("_g")), "_w", "_g")
    first = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", i).isin(*first_words()))
    ahead = lambda i: F.array(*[F.concat(F.get("_g", i + n), F.get("_w", i + n)) for n in range(1, longest)])
    now = runs.select(key, F.inline(F.transform(first, lambda i: F.struct(F.get("_w", i).alias("_p0"), ahead(i).alias("_ahead")))))
    for n in range(longest):
        node = trie.select(F.col("prefix").alias(f"_p{n}"), F.col("kind").alias(f"_k{n}"), F.col("priority").alias(f"_r{n}"), F.lit(True).alias(f"_in{n}"))
        now = now.join(node, f"_p{n}", "left" if n else "inner")
        if n + 1 < longest:
            now = now.withColumn(f"_p{n + 1}", F.when(F.col(f"_in{n}"), F.concat(f"_p{n}", F.get("_ahead", F.lit(n)))))
    found = F.array(*[F.struct(F.col(f"_r{n}").alias("priority"), F.col(f"_k{n}").alias("kind"), F.col(f"_p{n}").alias("phrase")) for n in range(longest)])
    hits = now.select(key, F.explode(F.filter(found, lambda h: h["priority"].isNotNull())).alias("_h"))
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("_h")).alias("hits"))


def best_hit(text: Column, hits: Column) -> Column:
    """(kind, phrase, at) of the first hit whose leftmost place has text on both sides; a place is looked for only for hits."""
    def placed(t):
        at = F.transform(hits, lambda h: F.struct(h["kind"].alias("kind"), h["phrase"].alias("phrase"), place(t, h["phrase"]).alias("at")))
        return F.get(F.filter(at, lambda h: (h["at"] > 0) & (h["at"] + F.length(h["phrase"]) < F.length(t))), F.lit(0))

    return let(match_text(text), placed)


def match_lexicon(sent: DataFrame, lexicon: DataFrame, text: str = "sentence", key: str = "id") -> DataFrame:
    """Best match per sentence: (key, kind, phrase, at) with ``at`` the zero-based start.

    A phrase counts at its leftmost word-bounded place, and only if text remains on both sides; among
    those the lexicon order decides.
    """
    both = sent.select(key, text).join(lexicon_hits(sent, lexicon, text, key), key)
    return both.select(key, best_hit(F.col(text), F.col("hits")).alias("_m")).where("_m is not null").select(key, "_m.*")


def split_at(df: DataFrame, text: str, phrase: Column, at: Column, found: Column, kind: Column) -> DataFrame:
    """Writes the seven SPO columns of found rows from the phrase place."""
    subject = F.substring(F.col(text), F.lit(1), at.cast("int"))
    rest = F.substring(F.col(text), (at + F.length(phrase) + 1).cast("int"), F.length(F.col(text)))
    values = {"spo_type": kind, "subject": subject, "predicate": phrase, "object": rest,
              "big_subject": subject, "big_predicate": phrase, "big_object": rest}
    return df.withColumns({n: F.when(found, v).otherwise(F.col(n)) for n, v in values.items()})


def spo_given(sent: DataFrame, lexicon: DataFrame, where: Column | None = None) -> DataFrame:
    """All sentences, with SPO columns filled for (chosen) rows that a lexicon phrase splits."""
    pending = sent if where is None else sent.where(where)
    out = sent.join(lexicon_hits(pending, lexicon).withColumnRenamed("hits", "_hits"), "id", "left")
    out = settle(out.withColumn("_m", best_hit(F.col("sentence"), F.col("_hits"))).drop("_hits"), "_m")
    done = split_at(out, "sentence", F.col("_m.phrase"), F.col("_m.at"), F.col("_m").isNotNull(), F.col("_m.kind"))
    return done.drop("_m")


def spo_be_have(sent: DataFrame, where: Column | None = None) -> DataFrame:
    short = F.size(white_tokens(F.col("sentence"))) <= fixed.BE_HAVE_MAX_TOKENS
    return spo_given(sent, be_have_lexicon(sent.sparkSession), short if where is None else where & short)


def spo_manual(sent: DataFrame, where: Column) -> DataFrame:
    """Per-row predicate text as the phrase, at its leftmost word-bounded place. Literal, no shuffle."""
    phrase = F.col("manually_identified_predicate")
    at = place(match_text(F.col("sentence")), F.lower(phrase))
    found = where & (phrase != "") & (at > 0) & (at + F.length(phrase) < F.length("sentence"))
    return split_at(sent, "sentence", phrase, at, F.coalesce(found, F.lit(False)), F.lit("manually id"))


def manual_pending(level: int, mode: str) -> Column:
    """Sentences whose manual predicate differs from the extracted one."""
    at_level = (F.col("review_level") == level) & (F.col("manually_identified_predicate") != F.col("big_predicate"))
    if mode == "external":
        return at_level & external() & (F.col("check_worthy_auto") == "FR") & ~F.col("predicate_not_found")
    return at_level & ~external() & worthy(mode == "full")
