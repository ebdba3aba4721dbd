"""Token ids, fixed-length sequences and encoder inputs; TF-IDF in long form; datasets for models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens import fixed
from claimlens.cluster import materialise, split_join
from claimlens.functions.text import cui_text, encode_class, lookup, words
from claimlens.operators import articles
from claimlens.operators.selectors import item_selector, sentence_selector


#: Words that an index may have to be looked up inside the rows; a longer one is joined word by word.
_LOOKED_UP = 10_000


def _ids_in_row(tokens: Column, known: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.transform(tokens, lambda w: F.coalesce(known(w), F.lit(1))), F.array().cast("array<int>"))


def _together(lists: Column) -> Column:
    """The id lists of a key's rows as one, place by place; nearly always there is one list."""
    placed = F.flatten(F.transform(lists, lambda ids: F.transform(ids, lambda x, i: F.struct(i.alias("at"), x.alias("id")))))
    return F.when(F.size(lists) == 1, F.get(lists, F.lit(0))).otherwise(F.transform(F.array_sort(placed), lambda e: e["id"]))


def part_ids(df: DataFrame, keys: list[str], parts: dict[str, str], index: DataFrame, max_len: int | None = None, lower: bool = True) -> DataFrame:
    """(keys, a column of word ids per part): ``parts`` names the text of each; ids in order, unknown words as 1.

    ``index`` is a top-k list. It is computed once and, up to 10,000 words, looked up where the words stand, so that a row is
    shuffled once with all its ids, to meet rows of the same key; a longer index is joined. Tokens over ``max_len`` are cut before they
    leave their row.
    """
    def tokens(c):
        given = words(F.col(c), lower)
        return given if max_len is None else F.slice(given, 1, max_len)

    index = index.select("word", "word_id")
    held = index.limit(_LOOKED_UP + 1).collect()
    if len(held) <= _LOOKED_UP and len({r["word"] for r in held} - {None}) == len(held):
        known = lookup([(r["word"], F.lit(r["word_id"])) for r in held], "int")
        rows = df.select(*keys, *[_ids_in_row(tokens(c), known).alias(out) for out, c in parts.items()])
        return rows.repartition(*keys).groupBy(*keys).agg(*[F.collect_list(out).alias(out) for out in parts]).select(*keys, *[_together(F.col(out)).alias(out) for out in parts])
    every = F.array(*[F.struct(F.lit(out).alias("_part"), tokens(c).alias("_t")) for out, c in parts.items()])
    rows = df.select(*keys, F.inline(every)).select(*keys, "_part", F.posexplode_outer("_t").alias("_at", "word"))
    entry = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("word_id", F.lit(1)).alias("_id")))
    of = lambda out: F.transform(F.array_sort(F.collect_list(F.when(F.col("_part") == out, entry))), lambda e: e["_id"]).alias(out)
    return rows.join(index, "word", "left").groupBy(*keys).agg(*[of(out) for out in parts])


def token_ids(df: DataFrame, keys: list[str], text: str, index: DataFrame, max_len: int | None = None, lower: bool = True) -> DataFrame:
    """(keys, ids): word ids in order, unknown words as 1."""
    return part_ids(df, keys, {"ids": text}, index, max_len, lower)


def padded(ids: Column, max_len: int) -> Column:
    return F.concat(F.slice(ids, 1, max_len), F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))))


def sequences(df: DataFrame, keys: list[str], text: str, index: DataFrame, max_len: int, lower: bool = True) -> DataFrame:
    """Fixed-length id sequences: cut, unknown words 1, padded with 0 on the right."""
    return token_ids(df, keys, text, index, max_len, lower).withColumn("ids", padded(F.col("ids"), max_len))


def _framed(parts: list[tuple[Column, int]], max_len: int, start: int, sep: int) -> Column:
    """struct(ids, mask, segments): start mark, then each part closed by a separator, padded to ``max_len``."""
    ids, segments = [F.array(F.lit(start))], [F.array(F.lit(0))]
    for part, segment in parts:
        closed = F.concat(part, F.array(F.lit(sep)))
        ids.append(closed)
        segments.append(F.array_repeat(F.lit(segment), F.size(closed)))
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(c), F.lit(0))))
    joined = F.concat(*ids)
    return F.struct(pad(joined).alias("ids"), pad(F.transform(joined, lambda x: F.lit(1))).alias("mask"), pad(F.concat(*segments)).alias("segments"))


def encode_text(ids: Column, max_len: int, start: int, sep: int) -> Column:
    return _framed([(F.slice(ids, 1, max_len - 2), 0)], max_len, start, sep)


def encode_spo_variable(s: Column, p: Column, o: Column, max_len: int, start: int, sep: int) -> Column:
    """Subject, predicate, object in segments 0, 1, 0; the longer of subject and object is cut (object on ties)."""
    room = F.greatest(F.lit(max_len - 4) - F.size(p), F.lit(0))
    upper, lower = F.ceil(room / 2).cast("int"), F.floor(room / 2).cast("int")
    ns, no = F.size(s), F.size(o)
    fits = ns + no <= room
    keep_s = F.when(fits | (ns <= upper), ns).when(no <= lower, room - no).otherwise(upper)
    keep_o = F.when(fits, no).when(ns <= upper, room - ns).when(no <= lower, no).otherwise(lower)
    return _framed([(F.slice(s, F.lit(1), keep_s), 0), (F.slice(p, 1, max_len - 4), 1), (F.slice(o, F.lit(1), keep_o), 0)], max_len, start, sep)


def encode_spo_fixed(s: Column, p: Column, o: Column, max_len: int, start: int, sep: int, blank: int = 1) -> Column:
    """Equal room for subject and object, the remainder for the predicate; each part is filled with the blank token."""
    side = (max_len - 4) // 3
    middle = side + (max_len - 4) % 3
    fill = lambda c, n: F.concat(F.slice(c, 1, n), F.array_repeat(F.lit(blank), F.greatest(F.lit(n) - F.size(c), F.lit(0))))
    return _framed([(fill(s, side), 0), (fill(p, middle), 1), (fill(o, side), 0)], max_len, start, sep)


def tfidf(train: DataFrame, test: DataFrame, key: str, text: str, lower: bool = True) -> DataFrame:
    """(split, key, term, weight): words of two or more characters, idf ``ln((1+n)/(1+df))+1`` of the training rows, L2-normed.

    Terms unseen in training are dropped. Counts are stored once; terms of very many rows are split in the idf join, and
    rows are normed where they meet by key.
    """
    rows = train.select(F.lit("train").alias("split"), key, text).unionByName(test.select(F.lit("test").alias("split"), key, text))
    tf = rows.select("split", key, F.explode(words(F.col(text), lower, 2)).alias("term")).groupBy("split", key, "term").agg(F.count("*").alias("tf"))
    tf = materialise(tf, "term-counts")
    n = train.agg(F.count("*").alias("n")).scalar()
    df = tf.where("split = 'train'").groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", "df")
    raw = split_join(tf, idf, "term", F.col(key)).withColumn("raw", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("split", key)))
    return raw.select("split", key, "term", (F.col("raw") / norm).alias("weight"))


def with_split(df: DataFrame, train: Column, test: Column) -> DataFrame:
    """Rows of the training and test selections with their ``split``; a row in both appears twice."""
    both = F.filter(F.array(F.when(train, F.lit("train")), F.when(test, F.lit("test"))), lambda x: x.isNotNull())
    return df.withColumn("split", F.explode(both))


def fc_dataset(sent: DataFrame, binary: bool = False, cuis: bool = False, keep_unknown: bool = False) -> DataFrame:
    """(split, id, text, label) for sentence truth: the sentence or its concept text."""
    text = cui_text(F.col("subject_cuis"), F.col("predicate_cuis"), F.col("object_cuis"), keep_unknown) if cuis else F.col("sentence")
    label = encode_class(F.col("sentence_class"), fixed.TRUTH_CLASSES, binary)
    return with_split(sent, sentence_selector("fc-train"), sentence_selector("fc-test")).select("split", "id", text.alias("text"), label.alias("label"))


def fd_dataset(items: DataFrame, test: str, binary: bool = False, test_set: str = fixed.TEST_SET_TYPE) -> DataFrame:
    """(split, id, text, label) for article verdicts with any named test selection."""
    label = encode_class(F.col("item_class_4"), fixed.TRUTH_CLASSES, binary)
    return with_split(items, item_selector("train"), item_selector(test, test_set)).select("split", "id", "text", label.alias("label"))


def fd_feature_dataset(items: DataFrame, sentences: DataFrame, test: str, binary: bool = False, level: int = 9) -> DataFrame:
    """(split, id, 18 features, label); the binary label is the item class, the other the 4-class code."""
    label = F.col("item_class") if binary else encode_class(F.col("item_class_4"), fixed.TRUTH_CLASSES)
    chosen = with_split(items, item_selector("train"), item_selector(test)).select("split", "id", label.alias("label"))
    return articles.item_features(chosen, sentences, level)


def combined_dataset(items: DataFrame, sentences: DataFrame, test: str, binary: bool = False) -> DataFrame:
    """Item text and its count features side by side, matched on split and item id."""
    feats = fd_feature_dataset(items, sentences, test, binary).drop("label")
    return fd_dataset(items, test, binary).join(feats, ["split", "id"])
