"""Subject/predicate/object from dependency rows: sentence reading, clause reading, and the cascade of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import settle
from claimlens.functions.readings import BOTH, SPO, both_readings, clause_reading, whole_reading
from claimlens.functions.text import quoted

RESULT = ["subject", "predicate", "object", "big_subject", "big_predicate", "big_object"]


def spo_parsed(df: DataFrame, words: str = "words", out: str = "spo") -> DataFrame:
    """Whole-sentence reading: root predicate, its last noun subject and object (else pronoun, else adjective complement)."""
    return settle(df.withColumn(out, F.arrow_udf(whole_reading, SPO)(F.col(words))), out)


def spo_clause(df: DataFrame, words: str = "words", out: str = "spo") -> DataFrame:
    """Clause reading: verbal root, else copula, else last verb; subject ``nsubj`` only; object ``obj``, else ``obl``."""
    return settle(df.withColumn(out, F.arrow_udf(clause_reading, SPO)(F.col(words))), out)


def reading_parts(df: DataFrame, key: str = "id", text: str = "sentence") -> DataFrame:
    """(key, part_no, kind, text) rows to parse: the quoted span or the sentence first, then the comma clauses."""
    df, q = settle(df.select(key, text, quoted(F.col(text)).alias("_q")), "_q"), F.col("_q")
    head = F.when(q != "", F.struct(F.lit("quoted text").alias("kind"), q.alias("part"))).otherwise(
        F.struct(F.lit("sentence").alias("kind"), F.col(text).alias("part")))
    clauses = F.transform(F.split(text, ","), lambda c: F.struct(F.lit("clause").alias("kind"), c.alias("part")))
    return df.select(key, F.posexplode(F.concat(F.array(head), clauses)).alias("part_no", "_x")).select(
        key, "part_no", F.col("_x.kind").alias("kind"), F.col("_x.part").alias("part"))


def spo_cascade(parts: DataFrame, key: str = "id") -> DataFrame:
    """First part with a result per sentence. ``parts`` has (key, part_no, kind, words)."""
    # the words go from the parser to both readings inside one Python worker if nothing else asks for them
    both = F.arrow_udf(both_readings, BOTH)(F.col("words"))
    read = settle(parts.select(key, "part_no", "kind", both.alias("_both")), "_both")
    best = F.when(F.col("kind") == "clause", F.col("_both.clause")).otherwise(F.col("_both.whole"))
    hits = read.select(key, "part_no", "kind", best.alias("_spo")).where("_spo is not null")
    first = hits.groupBy(key).agg(F.min_by(F.struct("kind", "_spo"), "part_no").alias("_m"))
    return first.select(key, F.col("_m.kind").alias("spo_type"), "_m._spo.*")
