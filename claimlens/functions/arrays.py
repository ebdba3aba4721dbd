"""Array functions over whole batches of rows, in numpy and Arrow: the rows' values stand in one flat array.

Spark's array functions evaluate a lambda per element, which took most of the time of the queries over words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all rows one after the other, and the number of values of each row (0 for a missing row)."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _lists(sizes: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    """Rows of the given sizes; missing where ``like`` is."""
    return pa.ListArray.from_arrays(pa.array(_ends(sizes), pa.int32()), values, mask=like.is_null())


def _sums(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Inclusive running sums within each row."""
    total = np.concatenate([[0], np.cumsum(numbers)])
    return total[1:] - np.repeat(total[_ends(sizes)[:-1]], sizes)


SPANS = "array<struct<text:string,start:int,gap:string>>"


def word_spans(words: pa.Array, gaps: pa.Array) -> pa.Array:
    """(text, start, gap) of each word, from a text's words and the texts before them (and one behind the last)."""
    texts, sizes = _flat(words)
    between, given = _flat(gaps)
    at = np.arange(len(texts)) - np.repeat(_ends(sizes)[:-1], sizes) + np.repeat(_ends(given)[:-1], sizes)
    before = between.take(pa.array(at))
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    ends = _sums(pc.utf8_length(before).to_numpy(zero_copy_only=False) + length, sizes)
    return _lists(sizes, pa.StructArray.from_arrays([texts, pa.array(ends - length, pa.int32()), before], ["text", "start", "gap"]), words)


def last_inside(tokens: pa.Array, starts: pa.Array) -> pa.Array:
    """Per token, the index of the last candidate that starts inside it, for tokens one blank apart from the text's start on.

    A row's numbers are moved behind those of the rows before it, so that one sorted search finds them for all rows. Of
    candidates with one start the later counts; those without a start are nowhere.
    """
    texts, sizes = _flat(tokens)
    at, counts = _flat(starts)
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = _sums(length + 1, sizes) - 1
    known = at.is_valid().to_numpy(zero_copy_only=False)
    index = (np.arange(len(at)) - np.repeat(_ends(counts)[:-1], counts))[known]
    at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
    row = np.repeat(np.arange(len(counts)), counts)[known]
    apart = int(max(ends.max(initial=0), at.max(initial=0))) + 2
    at = np.clip(at, -1, None) + row * apart
    order = np.lexsort((index, at))
    moved = np.repeat(np.arange(len(sizes)), sizes) * apart
    place = np.searchsorted(at[order], moved + ends, side="left") - 1
    found = np.concatenate([at[order], [-1]])[place]
    inside = found >= moved + ends - length
    return _lists(sizes, pa.array(np.concatenate([index[order], [0]])[place], pa.int32(), mask=~inside), tokens)


def _letter(tag: str | None) -> str:
    """The letter of a tag in the chunk grammar."""
    if tag in ("DT", "PP$"):
        return "D"
    return "J" if (tag or "").startswith("JJ") else "N" if (tag or "").startswith("NN") else "P" if tag == "IN" else "O"


CHUNKS = "array<struct<chunk_id:int,is_chunk:boolean,start:int,end:int,text:string>>"


def chunk_spans(names: pa.Array, tags: pa.Array, grammar: str) -> pa.Array:
    """(chunk_id, is_chunk, start, end, text) of the chunks of each row's tags and of the single tokens between them.

    The tags of all rows are read as one text of one letter per token, with a line end behind each row.
    """
    texts, sizes = _flat(names)
    coded = tags.flatten().dictionary_encode()
    letters = np.array([ord(_letter(t)) for t in coded.dictionary.to_pylist()] + [ord("O")], np.uint8)
    codes = letters[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)]
    lined = np.insert(codes, _ends(sizes)[1:], ord("\n")).tobytes().decode("ascii")
    spans = np.array([m.span() for m in re.finditer(f"(?:{grammar})|.", lined)], np.int64).reshape(-1, 2)
    row = np.searchsorted(_ends(sizes)[1:] + np.arange(len(sizes)), spans[:, 0], side="right")
    first, last = (spans - row[:, None]).T
    noun = np.diff(np.concatenate([[0], np.cumsum(codes == ord("N"))])[np.stack([first, last])], axis=0)[0] > 0
    chunks = np.bincount(row, minlength=len(sizes))
    base = np.repeat(_ends(sizes)[:-1], chunks)
    known = _ends(texts.is_valid().to_numpy(zero_copy_only=False))
    words = pa.ListArray.from_arrays(pa.array(known[np.concatenate([first, last[-1:] if len(last) else [0]])], pa.int32()), texts.drop_null())
    columns = {
        "chunk_id": pa.array(np.arange(len(row)) - np.repeat(_ends(chunks)[:-1], chunks), pa.int32()), "is_chunk": pa.array(noun),
        "start": pa.array(first - base, pa.int32()), "end": pa.array(last - base - 1, pa.int32()), "text": pc.binary_join(words, " ")}
    return _lists(chunks, pa.StructArray.from_arrays(list(columns.values()), list(columns)), names)


# The words that the stand-in tagger knows.
ARTICLES, PLACES = ("a", "an", "the", "le", "la", "der", "die", "el"), ("of", "in", "to", "de", "en")
_UPOS = {"DT": "DET", "IN": "ADP", "VBG": "VERB", "VBN": "VERB", "VBZ": "VERB", "RB": "PART", "NNP": "PROPN", "JJ": "ADJ", "NN": "NOUN", "CC": "ADP"}


def _tag(text: str) -> str:
    """Rule tag of a word from its spelling."""
    low = text.lower()
    if low in ARTICLES or low in PLACES:
        return "DT" if low in ARTICLES else "IN"
    for end, tag in (("ing", "VBG"), ("ed", "VBN"), ("es", "VBZ"), ("ly", "RB")):
        if low.endswith(end):
            return tag
    return "NNP" if "A" <= text < "[" else "JJ" if low.endswith(("al", "ble")) else "NN"


DEPENDENCIES = "array<struct<id:int,text:string,upos:string,xpos:string,head:int,deprel:string,feats:string,start_char:int,end_char:int>>"


def dependency_rows(words: pa.Array) -> pa.Array:
    """Dependency rows of each row's words by rule: every fifth is a conjunction, the others are tagged by their spelling.

    The first verb form, else the first word, is the root and the head of all others; nouns are subjects before it and objects
    behind it. A word starts 100 places behind the one before. Spellings are looked at once per batch.
    """
    texts, sizes = _flat(words)
    names = list(_UPOS)
    coded = texts.dictionary_encode()
    tags = np.array([names.index(_tag(t)) for t in coded.dictionary.to_pylist()] or [0], np.int8)[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(texts)) - np.repeat(_ends(sizes)[:-1], sizes)
    tags[place % 5 == 4] = names.index("CC")
    first = np.zeros(len(sizes), np.int32)
    verbs = np.flatnonzero(np.array([n.startswith("VB") for n in names])[tags])[::-1]
    first[row[verbs]] = place[verbs]  # the earliest is written last
    root = first[row]
    noun = np.array([n.startswith("NN") for n in names])[tags]
    relation = np.where(place == root, 0, np.where(noun, np.where(place < root, 1, 2), 3)).astype(np.int8)
    ends = place * 100 + pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    taken = lambda values, at: pa.array(values).take(pa.array(at))
    columns = {
        "id": pa.array(place + 1, pa.int32()), "text": texts, "upos": taken(list(_UPOS.values()), tags), "xpos": taken(names, tags),
        "head": pa.array(np.where(place == root, 0, root + 1), pa.int32()), "deprel": taken(["root", "nsubj", "obj", "dep"], relation),
        "feats": taken([""], np.zeros(len(texts), np.int8)), "start_char": pa.array(place * 100, pa.int32()), "end_char": pa.array(ends, pa.int32())}
    return _lists(sizes, pa.StructArray.from_arrays(list(columns.values()), list(columns)), words)
