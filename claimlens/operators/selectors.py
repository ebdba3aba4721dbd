"""Named item and sentence selectors: boolean columns, pushed down to the scan by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.fixed import TEST_SET_TYPE

READING_ORDER = ["item_id", "new_sentence_id"]


def _rows(external=None, level=None, above=None, kinds=None, unrevised=False, type_=None) -> Column:
    cond = F.lit(True)
    if external is not None:
        cond = cond & (F.col("skip_validations") == external)
    if level is not None:
        cond = cond & (F.col("review_level") == level)
    if above is not None:
        cond = cond & (F.col("review_level") > above)
    if kinds is not None:
        cond = cond & F.col("instance_type").isin(*kinds)
    if unrevised:
        cond = cond & ~F.col("needs_revision")
    if type_ is not None:
        cond = cond & (F.col("type") == type_)
    return cond


def item_selector(name: str, test_set: str = TEST_SET_TYPE) -> Column:
    return _rows(**{
        "new": dict(level=8, unrevised=True),
        "train": dict(external=False, level=9, kinds=["Train", "Other"]),
        "dev": dict(external=False, level=9, kinds=["Dev"]),
        "test": dict(external=False, level=9, kinds=["Dev"]),
        "skip_val": dict(external=True, level=8, unrevised=True, kinds=["Other"]),
        "external": dict(external=True, level=9),
        "ct21-test": dict(external=True, type_=test_set),
        "ct21-fr": dict(external=True, level=9, type_=test_set),
        "ct21-health": dict(external=True, level=9, kinds=["Health"]),
        "corpus-verification": dict(external=False, level=9, unrevised=True),
        "recovery": dict(external=True, level=9, kinds=["ReCOVery"]),
        "graph": dict(external=False, above=0),
        "augment": dict(external=False, level=9, kinds=["Train"]),
    }[name])


def naive_selector(external: bool, level: int, kind: str) -> Column:
    return _rows(external=external, level=level, kinds=[kind])


def sentence_selector(name: str) -> Column:
    return _rows(**{
        "cw-train": dict(external=False, above=4, kinds=["Train", "Other"]),
        "cw-test": dict(external=False, above=4, kinds=["Dev"]),
        "cw-new": dict(level=3),
        "cw-new-external": dict(level=3, external=True),
        "cw-external": dict(above=0, kinds=["Health"]),
        "fc-train": dict(external=False, above=7, kinds=["Train", "Other"]),
        "fc-test": dict(external=False, above=7, kinds=["Dev"]),
        "fc-new": dict(level=7, kinds=["Other"]),
        "fc-ct21-fr": dict(above=7, kinds=["Health"]),
        "fc-external": dict(external=True, level=9, kinds=["Other"]),
    }[name])


ITEM_SELECTORS = ["new", "train", "dev", "test", "skip_val", "external", "ct21-test", "ct21-fr", "ct21-health",
                  "corpus-verification", "recovery"]
SENTENCE_SELECTORS = ["cw-train", "cw-test", "cw-new", "cw-new-external", "cw-external",
                      "fc-train", "fc-test", "fc-new", "fc-ct21-fr", "fc-external"]


def matching_selectors(df: DataFrame, selectors: dict[str, Column], out: str = "selector") -> DataFrame:
    """One row per (row, selector that accepts it), from a single scan."""
    hits = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in selectors.items()]), lambda x: x.isNotNull())
    return df.withColumn(out, F.explode(hits))


def reading_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*READING_ORDER)


def exists_where(df: DataFrame, cond: Column) -> bool:
    return not df.where(cond).limit(1).isEmpty()


def match_count(df: DataFrame, cond: Column) -> DataFrame:
    """Number of matching rows and the gate derived from it, as data."""
    n = F.count(F.when(cond, 1))
    return df.agg(n.alias("n"), (n > 0).alias("found"))
