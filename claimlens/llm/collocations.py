"""Phrases that occur often, counted by broadcast double-array tries over numpy word sequences.

Texts are cut into words anew in every pass; nothing of them is stored. Level by level, a phrase becomes a candidate only
if the phrases left when its first or last word is cut are candidates themselves (a bitmap of fixed size answers that,
and may only say yes too often) and if its counts per run, cut at 255, add up to the least count. Candidates are dealt to shards
of bounded size; a task builds each shard's trie, and a pass sends a few tries to all tasks, where the states of all
text positions advance word by word together. Counts of accepting states are summed over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.cluster import materialise
from claimlens.llm.blocks import bound_batches, first_of, groups, meet, pack, unpack
from claimlens.llm.words import mix, runs, text_hash

LONGEST = 4
#: Phrases in a trie, and tries sent at once: some 100 MB at most whatever the corpus.
SHARD = 1 << 18
TRIES = 4
#: Bits of the bitmaps that tell which phrases of a level are candidates (16 MB), in slices made by different tasks.
BITS, SLICES = 27, 32

_ENDS = b".,;:!?\n\x0b\x0c\r"
_CUT = np.zeros(256, dtype=bool)
_CUT[list(_ENDS)] = True
_WORD = ~_CUT
_WORD[[9, 32]] = False


class Words:
    """The words of a run: hashes that also stand for the language, and whether a word goes on the piece of the one before."""

    def __init__(self, run, languages: np.ndarray):
        self.run = run
        self.hashes = mix(run.hashes + languages[run.lo : run.hi][run.row])
        passed = np.concatenate([[0], np.cumsum(_CUT[run.data])])
        self.joined = np.zeros(len(run.starts), dtype=bool)
        self.joined[1:] = passed[run.starts[1:]] == passed[run.ends[:-1]]
        self.joined[run.first[:-1][np.diff(run.first) > 0]] = False

    def inside(self, width: int) -> np.ndarray:
        """Whether ``width`` words from each place on stand in one piece."""
        n = max(0, len(self.joined) - width + 1)
        return np.logical_and.reduce([self.joined[j : j + n] for j in range(1, width)]) if width > 1 else np.ones(n, dtype=bool)

    def grams(self, width: int) -> np.ndarray:
        return gram(np.lib.stride_tricks.sliding_window_view(self.hashes, width)) if len(self.hashes) >= width else np.empty(0, dtype=np.uint64)


def gram(words: np.ndarray) -> np.ndarray:
    """One hash per row of word hashes; a single word's is its own."""
    if words.shape[1] == 1:
        return words[:, 0]
    return mix(sum(words[:, k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(words.shape[1])))


def _read(batch: pa.RecordBatch) -> Iterator[Words]:
    lang = batch.column("lang").fill_null("und") if batch.column("lang").null_count else batch.column("lang")
    lang = lang.dictionary_encode()
    names = text_hash(["lang " + x for x in lang.dictionary.to_pylist()] or [""])  # no word has a blank: never a word's hash
    languages = names[lang.indices.to_numpy(zero_copy_only=False)]
    for run in runs(batch.column("text"), _WORD, size=8 << 20):
        yield Words(run, languages)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n): occurrences of every word of every language."""

    def count(batches):
        for b in batches:
            lang = b.column("lang")
            for w in _read(b):
                hashes, at, n = np.unique(w.hashes, return_index=True, return_counts=True)
                starts, sizes = w.run.starts[at], w.run.ends[at] - w.run.starts[at]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                letters = w.run.data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
                words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])
                rows = w.run.lo + np.searchsorted(w.run.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(rows)), words, pa.array(hashes.view(np.int64)), pa.array(n)], ["lang", "word", "hash", "n"])

    found = docs.mapInArrow(count, "lang string, word string, hash long, n long")
    return found.groupBy(F.coalesce("lang", F.lit("und")).alias("lang"), "word", "hash").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Packed bits of the top ``BITS`` bits of all values of column ``hash``; the driver gets 2 ** (BITS - 3) bytes."""
    low, width = 64 - BITS, BITS - SLICES.bit_length() + 1

    def deal(batches):
        for b in batches:
            bit = b.column("hash").to_numpy().view(np.uint64) >> np.uint64(low)
            yield pack("b", (bit >> np.uint64(width)).astype(np.int64), (bit & np.uint64((1 << width) - 1)).astype(np.uint32))

    def fill(t):
        bits = np.zeros(1 << width, dtype=bool)
        bits[unpack(t, "b", np.dtype(np.uint32))] = True
        yield pa.RecordBatch.from_arrays([pa.array([t["bucket"][0].as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["part", "bits"])

    dealt = hashes.select("hash").mapInArrow(deal, "bucket int, kind string, data binary")
    out = np.zeros((SLICES, 1 << width - 3), dtype=np.uint8)
    for r in meet(dealt, SLICES, fill, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def candidates(docs: DataFrame, width: int, shorter: DataFrame, least: int) -> DataFrame:
    """(hash, words): phrases of ``width`` words, both of whose shorter parts are in ``shorter``, that occur ``least`` times."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bitmap(shorter))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    record = np.dtype([("words", "<u8", (width,)), ("n", "u1")])

    def deal(batches):
        for b in batches:
            for w in _read(b):
                part = _has(sent.value, w.grams(width - 1)) if len(w.hashes) >= width else np.zeros(1, dtype=bool)
                at = np.flatnonzero(part[:-1] & part[1:] & w.inside(width)) if len(part) > 1 else np.empty(0, dtype=np.int64)
                if len(at):
                    words = w.hashes[at[:, None] + np.arange(width)]
                    hashes, one, n = np.unique(gram(words), return_index=True, return_counts=True)
                    records = np.empty(len(one), dtype=record)
                    records["words"], records["n"] = words[one], np.minimum(n, 255)
                    yield pack("p", (hashes % np.uint64(buckets)).astype(np.int64), records)

    def frequent(t):
        records = unpack(t, "p", record)
        hashes = gram(records["words"])
        order = np.argsort(hashes, kind="stable")
        at = np.flatnonzero(first_of(hashes[order]))
        keep = np.add.reduceat(records["n"][order].astype(np.int64), at) >= least
        one = order[at[keep]]
        words = np.ascontiguousarray(records["words"][one]).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1) * width, pa.int32()), pa.array(words))
        yield pa.RecordBatch.from_arrays([pa.array(hashes[one].view(np.int64)), lists], ["hash", "words"])

    return meet(docs.mapInArrow(deal, "bucket int, kind string, data binary"), buckets, frequent, "hash long, words array<bigint>")


class Trie:
    """Double-array trie over word sequences; a word is two digits, so that children of a state lie close together."""

    def __init__(self, symbols: np.ndarray, digit_bits: int, base: np.ndarray, check: np.ndarray, accept: np.ndarray, size: int):
        self.symbols, self.digit_bits, self.base, self.check, self.accept, self.size = symbols, digit_bits, base, check, accept, size

    @classmethod
    def build(cls, phrases: list[np.ndarray]) -> Trie:
        """``phrases``: distinct word-hash sequences; a phrase is accepted under its number."""
        sizes = np.array([len(p) for p in phrases])
        symbols, flat = np.unique(np.concatenate(phrases), return_inverse=True)
        bits = max(1, (int(len(symbols) - 1).bit_length() + 1) // 2)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        state = np.zeros(len(phrases), dtype=np.int64)
        parents, digits, nodes = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 1
        for depth in range(2 * int(sizes.max())):
            live = np.flatnonzero(2 * sizes > depth)
            word = flat[starts[live] + depth // 2]
            digit = word >> bits if depth % 2 == 0 else word & ((1 << bits) - 1)
            keys, number = np.unique(state[live] << bits | digit, return_inverse=True)
            state[live] = nodes + number
            parents.append(keys >> bits)
            digits.append(keys & ((1 << bits) - 1))
            nodes += len(keys)
        parent, digit = np.concatenate(parents), np.concatenate(digits)
        slot, base = cls._places(parent, digit, 1 << bits)
        size = int(slot.max()) + (1 << bits) + 1
        made = [np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)]
        made[0][slot], made[1][slot[1:]], made[2][slot[state]] = base, slot[parent[1:]], np.arange(len(phrases))
        return cls(symbols, bits, *made, len(phrases))

    @staticmethod
    def _places(parent: np.ndarray, digit: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot and base of every node: large sets of children first, each at the first place where all of them fit."""
        first = np.searchsorted(parent[1:], np.arange(len(parent))) + 1
        n = np.searchsorted(parent[1:], np.arange(len(parent)), "right") + 1 - first
        slot, base = np.zeros(len(parent), dtype=np.int64), np.zeros(len(parent), dtype=np.int64)
        look = 2048
        used = np.zeros(2 * len(parent) + 4 * span + 2 * look, dtype=bool)
        used[:span] = True
        many = np.flatnonzero(n > 1)
        lowest, at, last = span, span, 0
        for p in many[np.argsort(-n[many], kind="stable")].tolist():
            kids = digit[first[p] : first[p] + n[p]]
            away = (kids - kids[0]).tolist()
            if n[p] != last:
                lowest = at = lowest + int(used[lowest:].argmin())
                last = n[p]
            while True:
                if at + look + span > len(used):
                    used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
                bad = used[at : at + look].copy()
                for o in away[1:]:
                    bad |= used[at + o : at + o + look]
                j = int(bad.argmin())
                if not bad[j]:
                    break
                at += look
            base[p] = at + j - kids[0]
            slot[first[p] : first[p] + n[p]] = base[p] + kids
            used[base[p] + kids] = True
        one = np.flatnonzero(n == 1)
        free = np.flatnonzero(~used)
        if len(free) < len(one):
            free = np.concatenate([free, len(used) + np.arange(len(one))])
        slot[first[one]] = free[: len(one)]
        base[one] = free[: len(one)] - digit[first[one]]
        return slot, base

    def count(self, w: Words) -> np.ndarray:
        """Occurrences of every phrase: all positions' states advance together, one word after the other."""
        symbol = np.searchsorted(self.symbols, w.hashes)
        known = self.symbols[np.minimum(symbol, len(self.symbols) - 1)] == w.hashes
        at = np.flatnonzero(known)
        state = np.zeros(len(at), dtype=np.int32)
        n = np.zeros(self.size, dtype=np.int64)
        for depth in range(LONGEST):
            if depth:
                on = at + depth < len(known)
                at, state = at[on], state[on]
                on = w.joined[at + depth] & known[at + depth]
                at, state = at[on], state[on]
            for digit in (0, 1):
                s = symbol[at + depth]
                to = self.base[state] + (s >> self.digit_bits if digit == 0 else s & ((1 << self.digit_bits) - 1))
                on = self.check[to] == state
                at, state = at[on], to[on].astype(np.int32)
            found = self.accept[state]
            n += np.bincount(found[found >= 0], minlength=self.size)
        return n


def phrase_counts(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words, n): occurrences of every phrase of the (hash, words) table, counted by tries of its shards."""
    spark = docs.sparkSession
    shards = max(1, -(-phrases.count() // SHARD))

    def build(batches):
        for t in groups(batches, ["shard"]):
            lists = t["words"].combine_chunks()
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            trie = Trie.build([flat[a:z] for a, z in zip(cuts[:-1], cuts[1:])])
            rows = pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists)
            data = [pa.array([x.tobytes()]) for x in (trie.symbols, trie.base, trie.check, trie.accept)]
            yield pa.RecordBatch.from_arrays([t["shard"].combine_chunks().slice(0, 1), pa.array([trie.digit_bits], pa.int32()), *data, rows], ["shard", "bits", "symbols", "base", "check", "accept", "phrases"])

    dealt = phrases.select(F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), "words").repartition(shards, "shard").sortWithinPartitions("shard")
    tries = materialise(dealt.mapInArrow(build, "shard int, bits int, symbols binary, base binary, check binary, accept binary, phrases array<array<bigint>>"), "tries")
    record = np.dtype([("id", "<u4"), ("n", "<u8")])
    parts = []
    for lo in range(0, shards, TRIES):
        some = tries.where(F.col("shard").between(lo, lo + TRIES - 1)).drop("phrases").collect()
        sent = spark.sparkContext.broadcast([
            (r["shard"], Trie(np.frombuffer(r["symbols"], np.uint64), r["bits"], *(np.frombuffer(r[c], np.int32) for c in ("base", "check", "accept")), int(np.frombuffer(r["accept"], np.int32).max()) + 1)) for r in some
        ])

        def count(batches):
            n = {shard: 0 for shard, _ in sent.value}
            for b in batches:
                for w in _read(b):
                    for shard, trie in sent.value:
                        n[shard] = n[shard] + trie.count(w)
            for shard, found in n.items():
                ids = np.flatnonzero(found)
                records = np.empty(len(ids), dtype=record)
                records["id"], records["n"] = ids, found[ids] if len(ids) else 0
                if len(ids):
                    yield pack("n", shard * 4096 + (ids >> 14), records)

        def total(t):
            records = unpack(t, "n", record)
            order = np.argsort(records["id"], kind="stable")
            at = np.flatnonzero(first_of(records["id"][order]))
            sums = np.add.reduceat(records["n"][order].astype(np.int64), at)
            shard = np.full(len(at), t["bucket"][0].as_py() // 4096, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(records["id"][order][at].astype(np.int32)), pa.array(sums)], ["shard", "id", "n"])

        dealt = docs.mapInArrow(count, "bucket int, kind string, data binary")
        parts.append(materialise(meet(dealt, int(spark.conf.get("spark.sql.shuffle.partitions")), total, "shard int, id int, n long"), "counts"))
        sent.destroy()
    named = tries.select("shard", F.posexplode("phrases").alias("id", "words"))
    return reduce(DataFrame.unionByName, parts).join(named, ["shard", "id"]).select("words", "n")


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = 30) -> DataFrame:
    """(words, n): every phrase of 2 to ``LONGEST`` words that occurs ``least`` times within pieces; words as hashes.

    ``docs`` has lang and text, ``words`` is their ``word_counts``.
    """
    bound_batches(docs.sparkSession)
    shorter = words.where(F.col("n") >= least)
    levels = []
    for width in range(2, LONGEST + 1):
        shorter = materialise(candidates(docs, width, shorter, least), "candidates")
        levels.append(shorter)
    return phrase_counts(docs, reduce(DataFrame.unionByName, levels)).where(F.col("n") >= least)


def _decimal(c):
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(words, a, l, r, score): every phrase with its lowest-scoring cut; phrases that a longer one nearly always holds are left out."""
    single = words.select(F.array("hash").alias("part"), F.col("n").alias("f"))
    counts = single.unionByName(phrases.select(F.col("words").alias("part"), F.col("n").alias("f")))
    size = F.size("words")
    cuts = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size).alias("rest"))
    both = cuts.join(counts.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    exact = both.withColumns({"up": F.lit(2_000_000).cast("decimal(10,0)") * _decimal("a"), "down": _decimal("l") + _decimal("r")})
    cut = F.struct(F.expr("up div down").alias("score"), "k", "l", "r")
    best = exact.groupBy("words", "a").agg(F.min(cut).alias("cut"))

    starts = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("words", at, n)))
    parts = phrases.where(size > 2).select(F.explode(F.flatten(starts)).alias("words"), "n").groupBy("words").agg(F.max("n").alias("longer"))
    held = _decimal("longer") * 100 >= _decimal("a") * 80
    free = best.join(parts, "words", "left").where(F.col("longer").isNull() | ~held)
    return free.select("words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """The ``most`` best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang (null: ``und``) and text (null: empty); other columns are not read, whatever their names. Texts are
    read whole whatever their length; repeated rows count again; ties end by the phrase in byte order. A language without a
    frequent phrase and an empty table give no rows.
    """
    given = docs.select("lang", "text")
    bound_batches(docs.sparkSession)
    words = materialise(word_counts(given), "words")
    phrases = materialise(frequent_phrases(given, words, least), "phrases")
    found = scored(phrases, words.where(F.col("n") >= least))
    each = found.select("*", F.posexplode("words").alias("at", "hash")).join(words.where(F.col("n") >= least).select("hash", "lang", "word"), "hash")
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = each.groupBy("words", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), spelled.alias("phrase"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    few = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
