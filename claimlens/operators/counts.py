"""Counting operators: words, predicates, classes, sizes, vocabularies and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimlens.functions.text import white_tokens, words


def predicate_counts(df: DataFrame, col: str = "norm_p") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


#: Stands for a missing order value, before all long ones; places within a row are below the shift.
_BEFORE, _SHIFT = "-9223372036854775809", 1 << 32


def word_counts(df: DataFrame, col: str, min_len: int, order: list[str], lower: bool = False) -> DataFrame:
    """(word, n, first_seen): counts are summed map-side, so a frequent word costs one row per task.

    The least (order, place) of one whole-number order column is kept as one decimal number: for a struct, Spark would sort all
    words instead of hashing them.
    """
    tokens = df.select(*order, F.posexplode(words(F.col(col), lower)).alias("at", "word")).where(F.length("word") >= min_len)
    kind = df.schema[order[0]].dataType
    if len(order) > 1 or not isinstance(kind, T.IntegralType):
        return tokens.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct(*order, "at")).alias("first_seen"))
    whole = "decimal(20,0)"
    place = F.coalesce(F.col(order[0]).cast(whole), F.lit(_BEFORE).cast(whole)) * F.lit(_SHIFT).cast("decimal(10,0)") + F.col("at")
    least = tokens.groupBy("word").agg(F.count("*").alias("n"), F.min(place).alias("_least"))
    at = F.pmod(F.col("_least"), F.lit(_SHIFT).cast("decimal(10,0)"))
    key = ((F.col("_least") - at) / F.lit(_SHIFT).cast("decimal(10,0)")).cast(whole)
    first = F.struct(F.when(key != F.lit(_BEFORE).cast(whole), key).cast(kind).alias(order[0]), at.cast("int").alias("at"))
    return least.select("word", "n", first.alias("first_seen"))


def top_vocab(word_counts_: DataFrame, k: int) -> DataFrame:
    """The k most frequent words, ties by first appearance."""
    return word_counts_.orderBy(F.desc("n"), F.asc("first_seen")).limit(k)


def ranked(top: DataFrame, first: int = 1) -> DataFrame:
    """Numbers an already limited top-k list; its size is the given k, so one small window is enough."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first_seen"))) + (first - 1)
    return top.withColumn("word_id", rank)


def word_index(word_counts_: DataFrame, max_words: int, oov: str = "<UNK>") -> DataFrame:
    """(word, word_id): the out-of-vocabulary word is 1, then the ``max_words - 1`` most frequent from 2 on."""
    known = ranked(top_vocab(word_counts_, max_words - 1), 2).select("word", "word_id")
    spark = word_counts_.sparkSession
    return spark.createDataFrame([(oov, 1)], "word string, word_id int").unionByName(known)


def common_vocab(word_counts_: DataFrame, max_words: int = 1000) -> DataFrame:
    """Index of the most frequent words of a general corpus, from 1."""
    return ranked(top_vocab(word_counts_, max_words)).select("word", "word_id")


def corpus_vocab(word_counts_: DataFrame, common: DataFrame, max_words: int = 500) -> DataFrame:
    """Most frequent corpus words that are not common words. Both sides have one row per word."""
    return top_vocab(word_counts_.join(common.select("word"), "word", "left_anti"), max_words)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) over the classes present."""
    per_class = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return per_class.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def padded_weights(weights: list[float], classes: int) -> list[float]:
    """Weights of the classes present, with zeros for absent leading classes."""
    return [0.0] * (classes - len(weights)) + list(weights)


def seq_budget(df: DataFrame, col: str, budget: int) -> DataFrame:
    return df.agg(F.least(F.lit(budget), F.max(F.size(white_tokens(F.col(col))))).alias("budget"))


def max_seq_len(df: DataFrame, col: str = "ids") -> DataFrame:
    return df.agg(F.max(F.size(F.filter(col, lambda x: x > 0))).alias("max_seq_len"))


def dataset_sizes(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"))
