"""The claim-extraction cascade: each stage fills only sentences without a predicate yet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise
from claimlens.operators import concepts, lexicon, parsed, updates


def _fill(sent: DataFrame, found: DataFrame) -> DataFrame:
    """Writes SPO columns found by a stage (key ``id``)."""
    names = ["spo_type", *parsed.RESULT]
    renamed = found.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    hit = F.col("_predicate").isNotNull()
    out = sent.join(renamed, "id", "left").withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in names})
    return out.drop(*[f"_{c}" for c in names])


#: How the cascade is run: on reviewed corpus sentences and external ones; on corpus sentences by their automatic score
#: only; or with the manual predicates of augmented sentences only.
MODES = ("reviewed", "full", "augmented")


def run_spo(sent: DataFrame, phrases: DataFrame, parse: Callable[[DataFrame], DataFrame], between: Callable[[DataFrame], DataFrame] | None = None,
            mode: str = "reviewed", annotate: Callable[[DataFrame, Column], DataFrame] | None = None) -> DataFrame:
    """Clears and fills the SPO columns, concepts and, where sentences are reviewed, the preliminary class.

    ``parse`` turns (id, part_no, kind, part) rows into rows with dependency ``words``; ``annotate`` adds the concept
    ``candidates`` of the chosen rows, if ``sent`` has none yet, just before they are read, so that they are neither stored nor
    shuffled. Corpus and external rows never meet, so both pass through each stage together.

    Only the rows that wait for a predicate go through the stages, and only they are stored between them (``between``, by
    default a table in the shared folder), as each stage reads its input twice; a lost executor then costs one re-read. All
    other rows pass by in one projection.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    keep = between or (lambda df: materialise(df, "extraction"))
    kinds = ("full",) if mode == "full" else ("corpus", "external")

    def any_of(pending, level):
        first, *rest = [pending(level, kind) for kind in kinds]
        return reduce(lambda a, b: a | b, rest, first)

    out = updates.clear_spos(sent, 5)
    if mode != "augmented":
        waiting = F.coalesce(any_of(updates.spo_pending, 5), F.lit(False))
        rest, todo = out.where(~waiting), keep(out.where(waiting))
        todo = keep(lexicon.spo_given(todo, phrases))
        parts = parsed.reading_parts(todo.where(waiting).select("id", "sentence"))
        todo = keep(_fill(todo, parsed.spo_cascade(parse(parts))))
        out = rest.unionByName(lexicon.spo_be_have(todo, waiting))
    if annotate:
        out = annotate(out, reduce(lambda a, b: a | b, [concepts.wanted(level, *kinds) for level in ((5,) if mode == "full" else (5, 6))]))
    if mode == "full":
        return concepts.assign_concepts(out, 5, *kinds)
    out = lexicon.spo_manual(out, any_of(lexicon.manual_pending, 5))
    out = concepts.assign_concepts(out, 5, *kinds)
    out = updates.preliminary_class(updates.preliminary_class(out, False), True)
    out = lexicon.spo_manual(out, any_of(lexicon.manual_pending, 6))
    out = concepts.assign_concepts(out, 6, *kinds)
    return updates.mark_no_predicate(out, 5)
