"""Biomedical concepts: reading extraction XML, enrichment, clinical terms, alignment with SPO tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.cluster import broadcast_if_small, settle
from claimlens.functions.arrays import last_inside
from claimlens.functions.metamap import PHRASES, read_phrases
from claimlens.functions.text import let, lookup, sem_ok, white_tokens
from claimlens.operators import updates


def parse_concept_xml(df: DataFrame, col: str, out: str = "phrases") -> DataFrame:
    """Array of phrases with at least one mapping, with the candidates of the first mapping only.

    Malformed XML gives an empty array, as does a document without any semantic type. Documents are read by Python's XML
    parser a batch at a time, and the batch's nested columns are put together flat. They are settled, or a later ``explode``'s filter would read them twice.
    """
    read = F.arrow_udf(read_phrases, PHRASES)
    return settle(df.withColumn(out, read(F.col(col))), out)


def flat_candidates(df: DataFrame, key: str = "id", phrases: str = "phrases") -> DataFrame:
    """One row per candidate with its phrase and candidate numbers."""
    p = df.select(key, F.posexplode(phrases).alias("phrase_no", "_p"))
    c = p.select(key, "phrase_no", F.col("_p.phrase_text"), F.posexplode("_p.candidates").alias("candidate_no", "_c"))
    return c.select(key, "phrase_no", "phrase_text", "candidate_no", "_c.*")


def _kinds(types: DataFrame, groups: DataFrame) -> DataFrame:
    return types.join(groups.select("tui", "group"), "tui", "left").withColumnRenamed("abbr", "sem_type")


def enrich_concepts(flat: DataFrame, types: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds tui, type name and group to candidates; the dimension has a row per semantic type and is sent to all tasks if it is small."""
    return flat.join(broadcast_if_small(_kinds(types, groups)), "sem_type", "left")


_KIND = ["tui", "type_name", "group"]


def _kind_pairs(types: DataFrame, groups: DataFrame) -> list[tuple[str, Column]]:
    """(sem_type, its literal struct) of the semantic types, one row each."""
    rows = _kinds(types, groups).where("sem_type is not null").collect()
    return [(r["sem_type"], F.struct(*[F.lit(r[n]).cast("string").alias(n) for n in _KIND])) for r in rows]


def type_lookup(types: DataFrame, groups: DataFrame) -> Column:
    """The semantic-type dimension as one map value, for looking up a few types."""
    pairs = _kind_pairs(types, groups)
    return F.create_map(*[x for key, kind in pairs for x in (F.lit(key), kind)]).cast("map<string,struct<tui:string,type_name:string,group:string>>")


def type_finder(types: DataFrame, groups: DataFrame) -> Callable[[Column], Column]:
    """The same as a function from a type to its (tui, type_name, group), for enriching many nested candidates.

    The dimension has a row per semantic type; it becomes part of the plan, so that no row carries it.
    """
    return lookup(_kind_pairs(types, groups), "struct<tui:string,type_name:string,group:string>")


def enrich_nested(df: DataFrame, candidates: str, kind_of: Column | Callable[[Column], Column]) -> DataFrame:
    """Candidates (array of structs with ``sem_type``) with tui, type_name and group added."""
    fields = [f.name for f in df.schema[candidates].dataType.elementType]

    def one(c):
        added = lambda kind: F.struct(*[c[f].alias(f) for f in fields], *[kind[n].alias(n) for n in ("tui", "type_name", "group")])
        return let(F.try_element_at(kind_of, c["sem_type"]) if isinstance(kind_of, Column) else kind_of(c["sem_type"]), added)

    return df.withColumn(candidates, F.transform(candidates, one))


def health_terms(df: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Distinct clinical "group tui" terms per sentence in first-seen order, and their number."""
    clinical = F.filter(candidates, lambda c: F.coalesce(sem_ok(c["tui"], c["group"]), F.lit(False)))
    terms = F.array_distinct(F.transform(clinical, lambda c: F.concat_ws(" ", c["group"], c["tui"])))
    return df.withColumn("common_health_terms", terms).withColumn("health_terms_auto", F.size("common_health_terms"))


#: Tokens whose results are put together at once in ``_walk``: a longer result would be copied for each of them.
_TOGETHER = 256
_FOUND = "array<int>"


def _walk(tokens: Column, text: Column, starts: Column) -> Column:
    """Per token, the index of the last candidate whose start the walk along the text has reached (null if none).

    A character that does not match stays where it is, one blank is skipped after each step, and the last character is
    never passed.
    """
    def over(given):
        chars, latest, last = given["chars"], given["latest"], F.size(given["chars"]) - 1

        def step(now, char):
            place = F.array_position(latest, now["at"])
            found = F.when(place > 0, F.size(latest) - place.cast("int")).otherwise(now["found"])
            on = lambda at, c: at + F.when((at < last) & (F.get(chars, at) == c), 1).otherwise(0)
            return F.struct(let(on(now["at"], char), lambda at: on(at, F.lit(" "))).alias("at"), found.alias("found"))

        def word(now, token):
            reached = F.aggregate(F.split(token, ""), F.struct(now["at"].alias("at"), F.lit(None).cast("int").alias("found")), step)
            return let(reached, lambda r: F.struct(r["at"].alias("at"), F.concat(now["found"], F.array(r["found"])).alias("found")))

        def part(now, first):
            some = F.slice(given["tokens"], first, F.lit(_TOGETHER))
            reached = F.aggregate(some, F.struct(now["at"].alias("at"), F.array().cast(_FOUND).alias("found")), word)
            return let(reached, lambda r: F.struct(r["at"].alias("at"), F.concat(now["found"], r["found"]).alias("found")))

        firsts = F.sequence(F.lit(1), F.greatest(F.size(given["tokens"]), F.lit(1)), F.lit(_TOGETHER))
        return F.aggregate(firsts, F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found")), part)["found"]

    return let(F.struct(tokens.alias("tokens"), F.split(text, "").alias("chars"), F.reverse(starts).alias("latest")), over)


ALIGNED = "array<struct<token_id:int,token_text:string,cui:string,preferred:string,sem_type:string,tui:string,type_name:string,group:string>>"


def align_concepts(df: DataFrame, text: str = "sentence", subject: str = "big_subject", predicate: str = "predicate",
                   obj: str = "big_object", candidates: str = "candidates", where: Column | None = None) -> DataFrame:
    """Pairs every token of "subject predicate object" with the last concept passed while walking the sentence.

    Adds ``s_ext``, ``p_ext``, ``o_ext`` arrays; all empty when any input is empty. Tokens that make up the sentence's
    start, one blank apart, are joined to candidate starts as of their last characters; other rows are walked character
    by character. ``where`` limits the walk to chosen rows; the others get empty arrays.
    """
    empty = F.expr(f"cast(array() as {ALIGNED})")
    usable = (F.size(candidates) > 0) & (F.col(subject) != "") & (F.col(predicate) != "") & (F.col(obj) != "")
    if where is not None:
        usable = usable & where
    unknown = F.lit(fixed.UNKNOWN)
    work = settle(df, candidates).withColumns({
        "_tokens": white_tokens(F.concat_ws(" ", subject, predicate, obj)),
        "_ns": F.size(white_tokens(F.col(subject))),
        "_np": F.size(white_tokens(F.col(predicate))),
    })
    work = settle(work, "_tokens", "_ns", "_np")
    starts = F.transform(candidates, lambda c: c["start_pos"])
    plain = F.col(text).startswith(F.array_join("_tokens", " "))
    inside = F.arrow_udf(last_inside, "array<int>")
    work = work.withColumn("_as_of", inside(F.when(usable & plain, F.col("_tokens")), F.when(usable & plain, starts)))
    work = work.withColumn("_found", F.when(plain, F.col("_as_of")).when(usable, _walk(F.col("_tokens"), F.col(text), starts)))
    pairs = F.zip_with("_tokens", "_found", lambda t, f: F.struct(t.alias("token"), f.alias("found")))

    def aligned(cands):
        def one(x, i):
            c = F.get(cands, x["found"])
            field = lambda name: F.coalesce(c[name], unknown).alias(name)
            return F.struct(i.cast("int").alias("token_id"), x["token"].alias("token_text"),
                            *[field(n) for n in ["cui", "preferred", "sem_type", "tui", "type_name", "group"]])
        return F.transform(pairs, one)

    work = settle(work.withColumn("_all", F.when(usable, let(F.col(candidates), aligned)).otherwise(empty)), "_all")
    rest = F.greatest(F.size("_all") - F.col("_ns") - F.col("_np"), F.lit(0))
    return work.withColumns({
        "s_ext": F.slice("_all", F.lit(1), F.col("_ns")),
        "p_ext": F.slice("_all", F.col("_ns") + 1, F.col("_np")),
        "o_ext": F.slice("_all", F.col("_ns") + F.col("_np") + 1, rest),
    }).drop("_tokens", "_ns", "_np", "_as_of", "_found", "_all")


CONCEPT_COLUMNS = ["subject_cuis", "predicate_cuis", "object_cuis", "subject_text_cuis", "predicate_text_cuis", "object_text_cuis"]


def _here(level: int, mode: str) -> Column:
    return (F.col("review_level") == level) & (F.col("skip_validations") == (mode == "external"))


def wanted(level: int, *modes: str) -> Column:
    """The sentences whose concepts ``assign_concepts`` writes."""
    chosen = F.lit(False)
    for mode in modes:
        one = (F.col("check_worthy_auto") == "FR") & ~F.col("predicate_not_found") if mode == "external" else updates.worthy(mode == "full")
        chosen = chosen | (_here(level, mode) & one)
    return chosen


def assign_concepts(df: DataFrame, level: int, *modes: str) -> DataFrame:
    """Resets and writes the six concept text columns of sentences at a level; modes as in ``spo_pending``."""
    at_level, chosen = F.lit(False), wanted(level, *modes)
    for mode in modes:
        at_level = at_level | _here(level, mode)
    joined = lambda ext, field: F.array_join(F.transform(ext, lambda t: t[field]), " ")
    values = {}
    for part, ext in [("subject", "s_ext"), ("predicate", "p_ext"), ("object", "o_ext")]:
        values[f"{part}_cuis"] = joined(ext, "cui")
        values[f"{part}_text_cuis"] = joined(ext, "preferred")
    out = align_concepts(df, where=chosen)
    return out.withColumns({
        name: F.when(chosen, value).when(at_level, F.lit("")).otherwise(F.col(name)) for name, value in values.items()
    }).drop("s_ext", "p_ext", "o_ext")


def length_mismatches(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two token texts differ in token count; must be empty for consistent alignments."""
    return df.where(F.size(white_tokens(F.col(left))) != F.size(white_tokens(F.col(right))))
