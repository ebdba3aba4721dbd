"""Reading of extraction XML: the phrases of whole columns of documents, put together as Arrow columns."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa

_POSITION = ["start_pos", "length"]
_UNIT = {"SyntaxType": "syntax_type", "LexMatch": "lex_match", "InputMatch": "input_match", "LexCat": "lex_cat"}
_CANDIDATE = {"CandidateMatched": "matched", "CandidatePreferred": "preferred", "CandidateCUI": "cui", "Negated": "negated"}
_UNITS = "array<struct<" + ",".join(f"{n}:string" for n in [*_UNIT.values(), "tokens"]) + ">>"
_CANDIDATES = ("array<struct<" + ",".join(f"{n}:string" for n in [*_CANDIDATE.values(), "sem_type", "matched_words"])
               + ",positions:array<struct<start_pos:int,length:int>>>>")
PHRASES = f"array<struct<phrase_text:string,syntax_units:{_UNITS},candidates:{_CANDIDATES}>>"


def _text(e) -> str | None:
    return None if e is None else (e.text or "").strip()


def _number(e) -> int | None:
    return None if e is None else int(_text(e))


def _children(e) -> dict:
    return {} if e is None else {c.tag: c for c in e}


def _joined(e, tag: str) -> str | None:
    found = [] if e is None else e.findall(tag)
    return " ".join([_text(x) for x in found]) if found else None


class _Table:
    """Rows of a nested column as they come, the ends of their lists in them, and which lists are missing."""

    def __init__(self):
        self.rows, self.ends, self.missing = [], [0], []

    def close(self, missing: bool = False) -> None:
        self.ends.append(len(self.rows))
        self.missing.append(missing)

    def place(self) -> tuple[int, int]:
        return len(self.rows), len(self.missing)

    def back(self, place: tuple[int, int]) -> None:
        del self.rows[place[0]:], self.missing[place[1]:], self.ends[place[1] + 1:]

    def lists(self, names: list[str], kind: pa.DataType = pa.string(), **more: pa.Array) -> pa.Array:
        columns = list(zip(*self.rows)) or [()] * len(names)
        values = pa.StructArray.from_arrays([*[pa.array(c, kind) for c in columns], *more.values()], [*names, *more])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values, mask=pa.array(self.missing, pa.bool_()))


def read_phrases(xml: pa.Array) -> pa.Array:
    """Per document, its phrases with mappings and the candidates of the first mapping; see ``concepts.parse_concept_xml``."""
    tables = phrases, units, candidates, positions = [_Table() for _ in range(4)]

    def candidate(c):
        of = _children(c)
        types = of.get("SemTypes")
        kind = _text(None if types is None else types.find("SemType"))
        candidates.rows.append((*[_text(of.get(t)) for t in _CANDIDATE], kind, _joined(of.get("MatchedWords"), "MatchedWord")))
        for p in of["ConceptPIs"].iterfind("ConceptPI") if "ConceptPIs" in of else ():
            at = _children(p)
            positions.rows.append((_number(at.get("StartPos")), _number(at.get("Length"))))
        positions.close()
        return kind is not None

    def phrase(p):
        """Adds a phrase, if it has mappings; whether a candidate has a type."""
        of = _children(p)
        maps, listed = of.get("Mappings"), of.get("SyntaxUnits")
        if maps is None or int(maps.get("Count", "0")) == 0:
            return False
        chosen = [] if listed is None else listed.findall("SyntaxUnit")
        for u in map(_children, chosen):
            units.rows.append((*[_text(u.get(t)) for t in _UNIT], _joined(u.get("Tokens"), "Token")))
        units.close(not chosen)
        first = maps.find("Mapping")
        first = None if first is None else first.find("MappingCandidates")
        found = [] if first is None else first.findall("Candidate")
        typed = [candidate(c) for c in found]
        candidates.close(not found)
        phrases.rows.append((_text(of.get("PhraseText")),))
        return any(typed)

    for doc in xml.to_pylist():
        places = [t.place() for t in tables]
        try:
            root = ElementTree.fromstring(doc or "")
        except ElementTree.ParseError:
            root = ()
        typed = [phrase(p) for m in root if m.tag == "MMO" for p in m.iterfind("Utterances/Utterance/Phrases/Phrase")]
        if not any(typed):
            for t, place in zip(tables, places):
                t.back(place)
        phrases.close()
    placed = positions.lists(_POSITION, pa.int32())
    found = candidates.lists([*_CANDIDATE.values(), "sem_type", "matched_words"], positions=placed)
    return phrases.lists(["phrase_text"], syntax_units=units.lists([*_UNIT.values(), "tokens"]), candidates=found)
