"""Line deduplication by a deletion-neighbourhood join on words.

Equal lines are found by their hash, lines that differ in one word (replaced, added or left out) by equal variants: each
line is hashed without its i-th word, for every i. Two lines with one word replaced share the variant of that place, a
line and a longer one share the longer one's variant with the shorter line itself. A line goes if an equal or near line
stands earlier, in order of doc_id, a hash of the text, and line number.

Lines that share neither their first nor their last half of words with another line cannot be near one, and get no variants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise
from claimlens.llm import blocks, words
from claimlens.llm.blocks import first_of

#: Lines of fewer words stay, whatever they say.
MIN_WORDS = 5
#: Lines of fewer words must be equal; longer ones may differ in one word.
NEAR_WORDS = 10

#: Documents whose lines are compared in one task, about.
_BUCKET_DOCS = 4000

_BASE = 0xD6E8FEB86659FD93
_ORDER = ("doc_id", "text_hash", "line")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Sums:
    """Order-dependent hashes of any stretch of words."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _powers(len(hashes) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.up[:-1])])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]


def _salted(h: np.ndarray, salt) -> np.ndarray:
    return words.mix(h + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_doc", F.col("doc_id").cast("long")).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))


_LINE = np.dtype([("hash", "u8"), ("check", "u8"), ("none", "u1"), ("doc", "i8"), ("text", "i8"), ("line", "i4")])
_HALF = np.dtype([("half", "u8"), ("hash", "u8")])
_VARIANT = np.dtype([("key", "u8"), ("no", "i8"), ("whole", "u1")])
_SALTS = 8


def _line_records(b: pa.RecordBatch, min_words: int, near_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Records of the lines of at least ``min_words`` words and of the halves of those of ``near_words`` words.

    Two near lines of n and n or n + 1 words share their first or their last n // 2 words, so a line of n words has the
    halves of n // 2 and of (n - 1) // 2 words.
    """
    lines, halves = [np.empty(0, dtype=_LINE)], [np.empty(0, dtype=_HALF)]
    none = np.asarray(b["_doc"].is_null())
    doc, text = b["_doc"].fill_null(0).to_numpy(), b["_hash"].to_numpy()
    for run in words.runs(b["text"]):
        ends = np.flatnonzero(run.data == 10)
        # line starts: every row start and what follows each line end
        row = np.concatenate([np.arange(run.hi - run.lo), np.searchsorted(run.offsets, ends, "right") - 1])
        starts = np.concatenate([run.offsets[:-1], ends + 1])
        order = np.lexsort((starts, row))
        starts, row = starts[order], row[order]
        a, z = np.searchsorted(run.starts, starts), np.searchsorted(run.starts, np.append(starts[1:], len(run.data)))
        number = np.arange(len(row)) - np.searchsorted(row, row)
        use = z - a >= min_words
        a, z, row, number = a[use], z[use], row[use] + run.lo, number[use]
        n, sums, other = z - a, Sums(run.hashes), Sums(words.mix(run.hashes))
        out = np.empty(len(n), dtype=_LINE)
        out["hash"], out["check"] = _salted(sums(a, z), n), _salted(other(a, z), n)
        out["none"], out["doc"], out["text"], out["line"] = none[row], doc[row], text[row], number
        lines.append(out)
        for m, keep in ((n // 2, n >= near_words), ((n - 1) // 2, (n >= near_words) & (n % 2 == 0))):
            for side, h in enumerate((sums(a, a + m), sums(z - m, z))):
                half = np.empty(int(keep.sum()), dtype=_HALF)
                half["half"], half["hash"] = _salted(h, 2 * m + side)[keep], out["hash"][keep]
                halves.append(half)
    return np.concatenate(lines), np.concatenate(halves)


def _by_place(x: np.ndarray) -> np.ndarray:
    """In order of hash and place; a line that stands twice at one place, by a repeated row, is kept once."""
    x = x[np.lexsort((x["line"], x["text"], x["doc"], x["none"], x["check"], x["hash"]))]
    return x[first_of(*[x[c] for c in ("hash", "check", "none", "doc", "text", "line")])]


def _line_rows(kind: str, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(x), pa.string()), pa.array(x["hash"].view(np.int64)), pa.array(x["doc"], mask=x["none"] > 0), pa.array(x["text"]), pa.array(x["line"])], ["kind", "hash", *_ORDER])


def _find_equal(docs: DataFrame, min_words: int, near_words: int, buckets: int) -> DataFrame:
    """(kind, hash, doc_id, text_hash, line): ``first`` for the first of equal lines, ``equal`` for the others, ``half`` for hashes of lines that share a half with a different line."""

    def deal(it):
        for b in it:
            lines, halves = _line_records(b, min_words, near_words)
            lines = _by_place(lines)
            new = first_of(lines["hash"], lines["check"])
            # a batch sends only its first of equal lines to be compared, so a line of all documents stays small
            yield blocks.pack("line", lines[new]["hash"] % np.uint64(buckets), lines[new])
            yield blocks.pack("equal", lines[~new]["text"].view(np.uint64) % np.uint64(buckets), lines[~new])
            halves = np.unique(halves)
            yield blocks.pack("half", halves["half"] % np.uint64(buckets), halves)

    def each(t: pa.Table):
        lines = _by_place(blocks.unpack(t, "line", _LINE))
        new = first_of(lines["hash"], lines["check"])
        yield _line_rows("first", lines[new])
        yield _line_rows("equal", lines[~new])
        yield _line_rows("equal", blocks.unpack(t, "equal", _LINE))
        halves = np.sort(blocks.unpack(t, "half", _HALF))
        at = np.flatnonzero(first_of(halves["half"]))
        shared = np.repeat(halves["hash"][at] != halves["hash"][np.append(at[1:], len(halves)) - 1], np.diff(np.append(at, len(halves)))) if len(at) else np.empty(0, dtype=bool)
        found = np.unique(halves["hash"][shared])
        none = lambda kind: pa.nulls(len(found), kind)
        yield pa.RecordBatch.from_arrays([pa.array(["half"] * len(found), pa.string()), pa.array(found.view(np.int64)), none(pa.int64()), none(pa.int64()), none(pa.int32())], ["kind", "hash", *_ORDER])

    rows = _keyed(docs).select("_doc", "_hash", F.col("text").cast("string").alias("text"))
    return blocks.meet(rows.mapInArrow(deal, blocks.BLOCK), buckets, each, "kind string, hash long, doc_id long, text_hash long, line int")


def _variants(it, buckets: int):
    """Blocks of the variants of (no, text) lines.

    A variant with its place stands for one replaced word: any two lines with it are near, so of each batch only the first
    line travels and the others are paired with it here. A variant without its place must meet a whole line: whole
    lines go to all salts, variants to one.
    """
    for b in it:
        for run in words.runs(b["text"]):
            no = b["no"].to_numpy()[run.lo : run.hi]
            n, sums, word, row = np.diff(run.first), Sums(run.hashes), np.arange(len(run.hashes)), run.row
            a, z = run.first[row], run.first[row + 1]
            # first part + base^i * last part, as if the word were not there
            left = sums(a, word) + sums.up[word - a] * sums(word + 1, z)
            replaced = np.zeros(len(row), dtype=_VARIANT)
            replaced["key"], replaced["no"] = words.mix(_salted(left, 2 * (word - a) + 1) + n[row].astype(np.uint64)), no[row]
            replaced = np.sort(replaced, order=["key", "no"])
            new = first_of(replaced["key"])
            start = np.flatnonzero(new)
            owner = replaced["no"][start[np.cumsum(new) - 1]] if len(start) else replaced["no"]
            yield blocks.pack("replaced", replaced["key"][new] % np.uint64(buckets), replaced[new])
            pairs = np.stack([replaced["no"][~new], owner[~new]], axis=1).reshape(-1)
            yield blocks.pack("pair", np.repeat(replaced["key"][~new] % np.uint64(buckets), 2), pairs)
            shorter = np.zeros(len(row), dtype=_VARIANT)
            shorter["key"], shorter["no"] = words.mix(_salted(left, 2 * n[row] - 2)), no[row]
            salt = words.mix(shorter["no"].view(np.uint64)) % np.uint64(_SALTS)
            yield blocks.pack("length", (shorter["key"] + salt) % np.uint64(buckets), shorter)
            whole = np.ones(len(n), dtype=_VARIANT)
            whole["key"], whole["no"] = words.mix(_salted(sums(run.first[:-1], run.first[1:]), 2 * n)), no
            for salt in range(min(_SALTS, buckets)):
                yield blocks.pack("length", (whole["key"] + np.uint64(salt)) % np.uint64(buckets), whole)


def _meet_variants(t: pa.Table):
    """(no, earlier) pairs of a bucket."""
    found = [blocks.unpack(t, "pair", np.dtype("i8")).reshape(-1, 2)]
    x = np.sort(blocks.unpack(t, "replaced", _VARIANT), order=["key", "no"])
    new = first_of(x["key"])
    if len(x):
        found.append(np.stack([x["no"], x["no"][np.flatnonzero(new)[np.cumsum(new) - 1]]], axis=1)[~new])
    x = blocks.unpack(t, "length", _VARIANT)
    whole = x[x["whole"] > 0]
    whole = whole[np.argsort(whole["key"], kind="stable")]
    part = x[x["whole"] == 0]
    if len(whole):
        at = np.minimum(np.searchsorted(whole["key"], part["key"]), len(whole) - 1)
        hit = whole["key"][at] == part["key"]
        both = np.stack([part["no"][hit], whole["no"][at[hit]]], axis=1)
        later = both[both[:, 0] < both[:, 1]][:, ::-1]
        later = later[np.lexsort((later[:, 1], later[:, 0]))]
        found += [both[both[:, 0] > both[:, 1]], later[first_of(later[:, 0])] if len(later) else later]
    pairs = np.unique(np.concatenate(found), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["no", "earlier"])


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two word lists are equal or differ by one replaced, added or missing word."""
    if abs(len(a) - len(b)) > 1:
        return False
    front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[front + (len(a) >= len(b)) :] == b[front + (len(b) >= len(a)) :]


def near_lines(candidates: DataFrame, buckets: int) -> DataFrame:
    """The numbers of those (no, text) lines before which a line stands that differs in one word at most, checked word by word."""
    pairs = materialise(blocks.meet(candidates.select("no", "text").mapInArrow(lambda it: _variants(it, buckets), blocks.BLOCK), buckets, _meet_variants, "no long, earlier long"), "line-pairs").distinct()

    def check(it):
        split = lambda s: s.encode().translate(words.LOWER.tobytes()).split()
        for b in it:
            good = [one_edit(split(x), split(y)) for x, y in zip(b["text"].to_pylist(), b["other"].to_pylist())]
            yield b.select(["no"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(candidates.select("no", "text"), "no").join(candidates.select(F.col("no").alias("earlier"), F.col("text").alias("other")), "earlier")
    return both.select("no", "text", "other").mapInArrow(check, "no long").distinct()


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, text_hash, line, near): every line with an equal (near false) or a near line before it."""
    blocks.bound_batches(docs.sparkSession)
    buckets = max(_SALTS, docs.count() // _BUCKET_DOCS)
    met = materialise(_find_equal(docs, min_words, near_words, buckets), "lines")
    equal = met.where("kind = 'equal'").select(*_ORDER, F.lit(False).alias("near"))
    # only lines that share a half with a different line get variants
    some = met.where("kind = 'half'").select("hash").distinct()
    chosen = met.where("kind = 'first'").join(some, "hash", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))
    full = _keyed(docs).select("_doc", "_hash", F.col("text").cast("string").alias("text"))
    texts = full.join(chosen, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    texts = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line", "text"), "lines").where(F.array_contains("lines", F.col("line")))
    # sorted, so that numbers follow the order of lines
    ordered = texts.select(*_ORDER, "text").dropDuplicates(list(_ORDER)).orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "line")
    candidates = materialise(ordered.withColumn("no", F.monotonically_increasing_id()), "line-texts")
    near = candidates.join(near_lines(candidates, buckets), "no", "left_semi").select(*_ORDER, F.lit(True).alias("near"))
    return equal.unionByName(near)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(row, text, n_lines, n_equal, n_near): every row as a struct of its columns, its text without repeated lines, and the counts.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, lines end at a line feed. Lines with fewer than ``min_words``
    words stay. Repeated rows (doc_id and text equal) count as one document and keep the same lines. Null texts stay null,
    empty ones empty; a null doc_id comes after all others. Other columns pass through.
    """
    gone = repeated(docs, min_words, near_words).distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line", "near")).alias("gone"))
    rows = _keyed(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", "text")).select("row", "_doc", "_hash")
    both = rows.join(gone, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left").select("row", "gone")

    def cut(it):
        for b in it:
            texts, n, equal, near = [], [], [], []
            for text, out in zip(b["row"].field("text").cast(pa.string()).to_pylist(), b["gone"].to_pylist()):
                parts = (text or "").split("\n")
                numbers = {x["line"] for x in out or ()}
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in numbers) if numbers else text)
                n.append(len(parts))
                equal.append(sum(not x["near"] for x in out or ()))
                near.append(sum(x["near"] for x in out or ()))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in (n, equal, near)]], ["row", "text", "n_lines", "n_equal", "n_near"])

    return both.mapInArrow(cut, f"row {both.schema['row'].dataType.simpleString()}, text string, n_lines long, n_equal long, n_near long")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their texts deduplicated; rows that lost all their words are left out."""
    out = dedup(docs).where((F.col("n_equal") + F.col("n_near") == 0) | (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != ""))
    fields = [F.col("text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*fields)
