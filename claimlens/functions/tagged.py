"""Functions over part-of-speech tagged tokens: noun chunks and multi-word names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import settle
from claimlens.functions.arrays import CHUNKS, chunk_spans
from claimlens.functions.text import let, running_sums

# Fixed pattern of a noun chunk over one-letter tag codes (D determiner, J adjective, N noun, P preposition).
_PHRASE = "D?J*N*J*N+"
CHUNK = f"{_PHRASE}P{_PHRASE}P{_PHRASE}|{_PHRASE}P{_PHRASE}|{_PHRASE}"


def tag_codes(tokens: Column) -> Column:
    """One letter per token, so that a chunk grammar is a plain regular expression."""
    code = lambda t: (
        F.when(t["pos"].isin("DT", "PP$"), "D").when(t["pos"].startswith("JJ"), "J").when(t["pos"].startswith("NN"), "N")
        .when(t["pos"] == "IN", "P").otherwise("O"))
    return F.array_join(F.transform(tokens, code), "")


def _cut(tokens: Column, pieces: Column) -> Column:
    """Array of (piece, start, words): the tokens under consecutive pieces of the tag-code text."""
    names = F.transform(tokens, lambda t: t["token"])
    ends = running_sums(F.transform(pieces, lambda p: F.length(p)))
    marked = F.zip_with(pieces, ends, lambda p, e: F.struct(p.alias("piece"), (e - F.length(p)).alias("start")))
    both = F.struct(names.alias("names"), marked.alias("marked"))
    return let(both, lambda x: F.transform(x["marked"], lambda m: F.struct(
        m["piece"].alias("piece"), m["start"].alias("start"), F.slice(x["names"], m["start"] + 1, F.length(m["piece"])).alias("words"))))


def noun_chunks(df: DataFrame, tokens: str = "tokens", out: str = "chunks") -> DataFrame:
    """Array of (chunk_id, is_chunk, start, end, text): chunks and the single tokens between them."""
    field = lambda name: F.transform(tokens, lambda t: t[name])
    spans = F.arrow_udf(lambda names, tags: chunk_spans(names, tags, CHUNK), CHUNKS)
    return settle(df.withColumn(out, spans(field("token"), field("pos"))), out)


def name_runs(tokens: Column) -> Column:
    """Word arrays of the noun/adjective runs of two or more tokens."""
    runs = F.regexp_extract_all(F.replace(tag_codes(tokens), F.lit("J"), F.lit("N")), F.lit("N+|[^N]+"), F.lit(0))
    named = F.filter(_cut(tokens, runs), lambda c: c["piece"].startswith("NN"))
    return F.transform(named, lambda c: c["words"])


def multiword_names(df: DataFrame, keep: list[str], tokens: str = "tokens") -> DataFrame:
    """(keep, name) rows: each noun/adjective run joined by ``_`` and its shorter consecutive parts (width 2 to n-1).

    Parts leave as rows one at a time; no row holds all parts of a long run.
    """
    runs = df.select(*keep, F.explode(name_runs(F.col(tokens))).alias("_run"))
    n = F.size("_run")
    widths = runs.select(*keep, "_run", F.explode(F.sequence(F.lit(2), n)).alias("_w"))
    places = widths.select(*keep, "_run", "_w", F.explode(F.sequence(F.lit(1), F.size("_run") - F.col("_w") + 1)).alias("_p"))
    return places.select(*keep, F.array_join(F.slice("_run", F.col("_p"), F.col("_w")), "_").alias("name"))
