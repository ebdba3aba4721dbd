"""Subject, predicate and object of parsed texts, over whole batches of rows.

The words of all rows stand in flat columns; a test of a word is made once per distinct value. As in Spark's conditions a
comparison with a missing value is neither true nor false, so such a word is not chosen, nor is it one of the other words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from claimlens.functions.arrays import _ends, _flat

SPO = "struct<subject:string,predicate:string,object:string,big_subject:string,big_predicate:string,big_object:string>"
_NOUNS, _HELPERS = ("NOUN", "PROPN"), ("AUX", "COP", "PART")


class _Labels:
    """A text column with few values."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode()
        self.values = coded.dictionary.to_pylist()
        self.codes = pc.fill_null(coded.indices, len(self.values)).to_numpy(zero_copy_only=False)

    def among(self, *wanted: str) -> np.ndarray:
        return np.array([v in wanted for v in self.values] + [False])[self.codes]

    def others(self, *wanted: str) -> np.ndarray:
        """Words with another value; those without any are left out."""
        return np.array([v not in wanted for v in self.values] + [False])[self.codes]


class _Numbers:
    def __init__(self, column: pa.Array):
        self.known = column.is_valid().to_numpy(zero_copy_only=False)
        self.values = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Words:
    def __init__(self, lists: pa.Array):
        flat, self.sizes = _flat(lists)
        fields = dict(zip((f.name for f in flat.type), flat.flatten()))
        self.text = fields["text"]
        self.upos, self.xpos, self.deprel, self.feats = (_Labels(fields[c]) for c in ("upos", "xpos", "deprel", "feats"))
        self.id, self.head, self.start, self.end = (_Numbers(fields[c]) for c in ("id", "head", "start_char", "end_char"))
        self.rows = len(self.sizes)
        self.row = np.repeat(np.arange(self.rows), self.sizes)
        self.noun = self.upos.among(*_NOUNS)
        self.pronoun = self.upos.among("PRON") & self.xpos.among("PRP")

    def last(self, *tests: np.ndarray) -> np.ndarray:
        """Per row the last word that passes the first test that any passes; -1 if none does."""
        out = np.full(self.rows, -1)
        for test in reversed(tests):
            at = np.flatnonzero(test)
            out[self.row[at]] = at
        return out

    def under(self, p: np.ndarray) -> np.ndarray:
        """Words whose head is the row's ``p``."""
        at = p[self.row]
        return (at >= 0) & self.head.known & self.id.known[at] & (self.head.values == self.id.values[at])

    def joined(self, at: np.ndarray, between: str, texts: pa.Array) -> pa.Array:
        """Per row the texts of the chosen words, which stand in order of rows."""
        counts = np.bincount(self.row[at], minlength=self.rows)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(_ends(counts), pa.int32()), texts), between)

    def result(self, p: np.ndarray, rest: np.ndarray, helped: np.ndarray, s: np.ndarray, o: np.ndarray) -> pa.Array:
        """The six texts of the rows that have all three words; ``helped`` are the words of ``rest`` under ``p``."""
        found = (p >= 0) & (s >= 0) & (o >= 0)
        ids, at_p = self.id.values, p[self.row]
        helper = helped & found[self.row] & self.id.known & self.upos.among(*_HELPERS)
        sides = [np.flatnonzero(helper & (ids < ids[at_p])), p[found], np.flatnonzero(helper & (ids > ids[at_p]))]
        span, side = np.concatenate(sides), np.repeat([0, 1, 2], [len(x) for x in sides])
        span = span[np.lexsort((span, side, self.row[span]))]
        starts = np.flatnonzero(np.diff(self.row[span], prepend=-1))
        low, high = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        if len(span):
            low[found], high[found] = (f.reduceat(ids[span], starts) for f in (np.minimum, np.maximum))
        ordered = found & self.id.known[p] & self.id.known[s] & self.id.known[o] & (ids[s] < low) & (high < ids[o]) if len(ids) else found
        sure = rest & self.id.known & ordered[self.row] & self.text.is_valid().to_numpy(zero_copy_only=False)
        outer = [np.flatnonzero(x) for x in (sure & (ids < low[self.row]), sure & (ids > high[self.row]))]
        first = np.zeros(len(span), bool)
        first[starts] = True
        length = pc.fill_null(pc.utf8_length(self.text.take(pa.array(span))), 0).to_numpy(zero_copy_only=False)
        begun = (np.cumsum(length) - length) - np.repeat((np.cumsum(length) - length)[starts], np.diff(np.append(starts, len(span))))
        before = np.concatenate([[0], span[:-1]]) if len(span) else span
        glued = self.end.known[before] & self.start.known[span] & (self.end.values[before] == self.start.values[span])
        gaps = pa.array(["", " "]).take(pa.array((~first & (begun > 0) & ~glued).astype(np.int8)))
        pieces = pc.binary_join_element_wise(gaps, self.text.take(pa.array(span)), "")
        one = lambda at: self.text.take(pa.array(at, mask=~found))
        texts = [one(s), one(p), one(o), self.joined(outer[0], " ", self.text.take(pa.array(outer[0]))),
                 self.joined(span, "", pieces), self.joined(outer[1], " ", self.text.take(pa.array(outer[1])))]
        names = ["subject", "predicate", "object", "big_subject", "big_predicate", "big_object"]
        return pa.StructArray.from_arrays(texts, names, mask=pa.array(~found))


def _whole(w: _Words) -> pa.Array:
    p, rest = w.last(w.deprel.among("root")), w.deprel.others("root")
    mine = rest & w.under(p)
    subj, obj = mine & w.deprel.among("nsubj", "nsubj:pass"), mine & w.deprel.among("obj", "obl")
    adjective = mine & w.upos.among("ADJ") & w.deprel.among("xcomp", "ccomp")
    return w.result(p, rest, mine, w.last(subj & w.noun, subj & w.pronoun), w.last(obj & w.noun, obj & w.pronoun, adjective))


def _clause(w: _Words) -> pa.Array:
    verbal = ("VERB", "AUX", "COP")
    tests = [w.deprel.among("root") & w.upos.among(*verbal), w.deprel.among("cop"), w.upos.among("VERB")]
    others = [w.deprel.others("root") | w.upos.others(*verbal), w.deprel.others("cop"), w.upos.others("VERB")]
    picks = [w.last(test) for test in tests]
    p, chosen = w.last(*tests), np.where(picks[0] >= 0, 0, np.where(picks[1] >= 0, 1, 2))
    rest = np.choose(chosen[w.row], others)
    mine = rest & w.under(p)
    person = w.noun | w.pronoun | (w.upos.among("PRON") & w.feats.among("PronType=Rel"))
    obj = [mine & person & w.deprel.among("obj"), mine & w.noun & w.deprel.among("obl")]
    return w.result(p, rest, mine, w.last(mine & person & w.deprel.among("nsubj")), w.last(*obj))


def whole_reading(words: pa.Array) -> pa.Array:
    """Root predicate, its last noun subject and object (else pronoun, else adjective complement)."""
    return _whole(_Words(words))


def clause_reading(words: pa.Array) -> pa.Array:
    """Verbal root, else copula, else last verb; subject ``nsubj`` only; object ``obj``, else ``obl``."""
    return _clause(_Words(words))


BOTH = f"struct<whole:{SPO},clause:{SPO}>"


def both_readings(words: pa.Array) -> pa.Array:
    """Both readings of each row, for parts of which some are whole and some are clauses."""
    w = _Words(words)
    return pa.StructArray.from_arrays([_whole(w), _clause(w)], ["whole", "clause"])
