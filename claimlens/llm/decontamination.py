"""Benchmark decontamination with a positional inverted index that is split by documents.

``build_index`` cuts the texts into shards of bounded size and stores for each shard the sorted term hashes, the posting
list of every term (word positions in the shard) and the documents' bounds. A search runs on every shard for itself: the
posting lists of a phrase, shifted by the terms' offsets, are intersected from the shard's rarest term on. No list of a
frequent term is ever gathered across shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise
from claimlens.llm import blocks, words

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Phrases sent to the tasks at once: at most about 20 MB; more are searched in further blocks.
PHRASE_BLOCK = 200_000
#: Stands for the id of all items that have none.
_NAMELESS = -(1 << 63)

_INDEX = "shard string, doc_ids array<long>, bounds binary, terms binary, cuts binary, postings binary"
_MATCH = "shard string, place int, doc_id long, phrase long, start long, length int"


def build_index(docs: DataFrame, id_column: str = "doc_id", name: str = "postings") -> DataFrame:
    """Stores the index of (id, text) rows; null texts are empty, every row takes part."""

    def batches(it):
        task, n = TaskContext.get().partitionId(), 0
        for b in it:
            ids = b["id"].to_pylist()
            for run in words.runs(b["text"], words.ALNUM, size=SHARD_BYTES):
                order = np.argsort(run.hashes, kind="stable")
                ordered = run.hashes[order]
                cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)
                row = [f"{task}-{n}", ids[run.lo : run.hi], run.first.astype(np.int64).tobytes(), ordered[cuts].tobytes(), np.append(cuts, len(ordered)).astype(np.int64).tobytes(), order.astype(np.uint32).tobytes()]
                n += 1
                yield pa.RecordBatch.from_pylist([dict(zip(("shard", "doc_ids", "bounds", "terms", "cuts", "postings"), row))], schema=pa.schema(
                    [("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("bounds", "terms", "cuts", "postings")]]))

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(batches, _INDEX), name)


class Shard:
    """One stored shard: posting lists by term and document bounds."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.name, self.doc_ids = batch["shard"][i].as_py(), batch["doc_ids"][i].values
        kinds = {"bounds": np.int64, "terms": np.uint64, "cuts": np.int64, "postings": np.uint32}
        self.bounds, self.terms, self.cuts, self.postings = (np.frombuffer(batch[c][i].as_buffer(), dtype=k) for c, k in kinds.items())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for terms that do not occur."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def list(self, term: int) -> np.ndarray:
        return self.postings[self.cuts[term] : self.cuts[term + 1]].astype(np.int64)

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase, within one document."""
        sizes = self.cuts[terms + 1] - self.cuts[terms]
        starts = None
        for i in np.argsort(sizes, kind="stable"):
            shifted = self.list(terms[i]) - i
            if starts is None:
                starts = shifted[shifted >= 0]
            elif len(shifted) > 64 * len(starts):
                at = np.minimum(np.searchsorted(shifted, starts), len(shifted) - 1)
                starts = starts[shifted[at] == starts]
            else:
                starts = np.intersect1d(starts, shifted, assume_unique=True)
            if not len(starts):
                return starts
        return starts[self.doc(starts) == self.doc(starts + len(terms) - 1)]

    def near(self, terms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the shortest stretches of at most ``width`` words that hold all terms."""
        lists = [self.list(t) for t in np.unique(terms)]
        starts = np.unique(np.concatenate(lists))
        ends = starts
        for one in lists:
            at = np.searchsorted(one, starts)
            starts, ends, at = starts[at < len(one)], ends[at < len(one)], at[at < len(one)]
            ends = np.maximum(ends, one[at])
        good = (ends - starts < width) & (self.doc(starts) == self.doc(ends))
        return starts[good], ends[good] - starts[good] + 1


def phrase_windows(items: DataFrame, item: str = "item_id", width: int = WINDOW) -> DataFrame:
    """(item_id, terms): term hashes of all stretches of ``width`` words of each text, or of the whole text if it is shorter."""

    def batches(it):
        for b in it:
            ids, rows = [], []
            for run in words.runs(b["text"], words.ALNUM):
                for i, one in enumerate(b["id"].to_pylist()[run.lo : run.hi]):
                    h = run.hashes[run.first[i] : run.first[i + 1]].view(np.int64)
                    for k in range(max(1, len(h) - width + 1) if len(h) else 0):
                        ids.append(one)
                        rows.append(h[k : k + width])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["item_id", "terms"])

    rows = items.select(F.col(item).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "item_id long, terms array<long>")


def search(index: DataFrame, phrases: DataFrame, within: int | None = None, block: int = PHRASE_BLOCK) -> DataFrame:
    """All matches of ``phrases`` (phrase long, terms array<long>): (shard, place, doc_id, phrase, start, length).

    Exact phrases, or with ``within`` the stretches of at most so many words that hold all terms in any order.
    ``place`` is the document's number in its shard, ``start`` a word number in the document. The phrases are read in
    blocks of bounded size, each of which is sent to all shards.
    """
    spark = index.sparkSession
    wanted = materialise(phrases.select(F.col("phrase").cast("long"), "terms"), "phrases")
    blocks = max(1, -(-wanted.count() // block))
    found = None
    for k in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("phrase", "terms"), F.lit(blocks)) == k)
        rows = part.toArrow()
        sent = spark.sparkContext.broadcast((rows["phrase"].to_numpy(), [np.array(t, dtype=np.int64).view(np.uint64) for t in rows["terms"].to_pylist()]))

        def match(it, sent=sent):
            names, terms = sent.value
            cuts = np.cumsum([0] + [len(t) for t in terms])
            flat = np.concatenate(terms) if terms else np.empty(0, dtype=np.uint64)
            for b in it:
                for i in range(len(b)):
                    yield from _matches(Shard(b, i), names, flat, cuts, within)

        one = index.mapInArrow(match, _MATCH)
        found = one if found is None else found.unionByName(one)
    return found


def _matches(shard: Shard, names: np.ndarray, flat: np.ndarray, cuts: np.ndarray, within: int | None) -> Iterator[pa.RecordBatch]:
    if not len(flat):
        return
    terms = shard.find(flat)
    absent = np.cumsum(np.concatenate([[0], terms < 0]))
    out = []
    for i in np.flatnonzero((absent[cuts[1:]] == absent[cuts[:-1]]) & (np.diff(cuts) > 0)):
        own = terms[cuts[i] : cuts[i + 1]]
        starts, lengths = (shard.phrase(own), len(own)) if within is None else shard.near(own, within)
        if len(starts):
            out.append((np.full(len(starts), names[i]), starts, np.broadcast_to(lengths, starts.shape)))
    if out:
        phrase, start, length = (np.concatenate(x) for x in zip(*out))
        doc = shard.doc(start)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard.name] * len(doc)), pa.array(doc, pa.int32()), shard.doc_ids.take(pa.array(doc)), pa.array(phrase, pa.int64()), pa.array(start - shard.bounds[doc], pa.int64()), pa.array(length, pa.int32())],
            ["shard", "place", "doc_id", "phrase", "start", "length"])


def _stretches(matches: DataFrame) -> DataFrame:
    """Overlapping matches of one phrase owner in a document become one stretch, inside the batches of a shard."""

    def merge(it):
        for b in it:
            t = pa.Table.from_batches([b]).sort_by([("shard", "ascending"), ("place", "ascending"), ("phrase", "ascending"), ("start", "ascending")])
            if not t.num_rows:
                continue
            start, end = t["start"].to_numpy(), t["start"].to_numpy() + t["length"].to_numpy()
            group = np.ones(t.num_rows, dtype=bool)
            keys = [t["shard"].combine_chunks().dictionary_encode().indices.to_numpy(), t["place"].to_numpy(), t["phrase"].to_numpy()]
            for k in keys:
                group[1:] &= k[1:] == k[:-1]
            # only with the match before it: a match cut off here although an earlier one reaches it is counted once by _covered
            group[1:] &= start[1:] <= end[:-1]
            group[0] = False
            first = np.flatnonzero(~group)
            yield pa.RecordBatch.from_arrays([*[t[c].combine_chunks().take(pa.array(first)) for c in ("shard", "place", "phrase", "start")], pa.array(np.maximum.reduceat(end, first), pa.int64())], ["shard", "place", "phrase", "start", "end"])

    return matches.select("shard", "place", "phrase", "start", "length").mapInArrow(merge, "shard string, place int, phrase long, start long, end long")


def _covered(pairs: Column) -> Column:
    """Number of words in the union of (start, end) stretches."""
    start = F.expr("named_struct('reach', 0L, 'n', 0L)")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["reach"], x["end"]).alias("reach"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["reach"], x["start"]))).alias("n"))

    return F.aggregate(F.sort_array(pairs), start, step)["n"]


def report(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """Per document: its id, n_words, n_hit (words inside any occurrence of a window) and the sorted ids of the items found.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a window is ``width`` consecutive words of an
    item, or the whole item if it has fewer. Null and empty texts have no words; items without words match nothing; an item
    without an id is searched like the others and its words are hit, but it cannot be listed. Texts of any length are read
    whole; repeated rows are reported each; other columns are ignored; an empty table gives no rows.
    """
    blocks.bound_batches(docs.sparkSession)
    index = build_index(docs, id_column)
    phrases = phrase_windows(items, width=width).select(F.coalesce("item_id", F.lit(_NAMELESS)).alias("phrase"), "terms").distinct()
    hits = _stretches(search(index, phrases)).select("shard", "place", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), "phrase", F.struct("start", "end").alias("at"))

    def sizes(it):
        for b in it:
            for row in b.to_pylist():
                n = np.diff(np.frombuffer(row["bounds"], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(n)), pa.array(np.arange(len(n)), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(n, pa.int64())], ["shard", "place", "doc_id", "n_words"])

    every = index.select("shard", "doc_ids", "bounds").mapInArrow(sizes, "shard string, place int, doc_id long, n_words long")
    every = every.select("*", F.lit(None).cast("long").alias("phrase"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("at"))
    # each document and its stretches meet in one group; there are no more stretches than words
    listed = F.collect_set(F.when(F.col("phrase") != _NAMELESS, F.col("phrase")))
    both = every.unionByName(hits).groupBy("shard", "place").agg(F.max("doc_id").alias(id_column), F.max("n_words").alias("n_words"), F.collect_list("at").alias("_at"), listed.alias("items"))
    return both.select(id_column, "n_words", _covered(F.col("_at")).alias("n_hit"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, unchanged; repeated rows are judged alike."""
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    hit = report(keyed.select("_key", "text"), items, "_key").where("n_hit > 0").select("_key").distinct()
    return keyed.join(hit, "_key", "left_anti").drop("_key")
