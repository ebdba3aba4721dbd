"""Text functions on columns. All read whole texts; all but ``token_spans`` stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.functions.arrays import SPANS, word_spans

RUN = r"(?U)\w+"


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def sentence_pieces(c: Column) -> Column:
    """Trimmed non-empty runs that end in terminal punctuation or at a line end."""
    runs = F.regexp_extract_all(c, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: x != "")


def split_sentences(c: Column) -> Column:
    """Sentences of a text whose paragraphs are joined by the paragraph mark.

    Literal backslash-n / backslash-t pairs become blanks, whitespace runs shrink, and a closing quote
    after a full stop stays with its sentence.
    """
    def paragraph(p):
        p = F.replace(F.replace(p, F.lit(r"\n"), F.lit(" ")), F.lit(r"\t"), F.lit(" "))
        p = F.regexp_replace(p, r"\s\s+", " ")
        p = F.regexp_replace(p, r"\.” ([A-Z])", r".”. $1")
        return F.transform(sentence_pieces_quoted(p), lambda s: F.regexp_replace(s, r"\.”.", ".”"))

    return F.flatten(F.transform(F.split(c, fixed.PARAGRAPH_MARK), paragraph))


def sentence_pieces_quoted(c: Column) -> Column:
    """Like ``sentence_pieces``; a closing quote and its stop belong to the sentence they follow."""
    runs = F.regexp_extract_all(c, F.lit(r"[^.!?\n]+[.!?”]*"), F.lit(0))
    return F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: x != "")


def strip_symbols(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{So}", "")


def tsv_clean(c: Column) -> Column:
    one_line = F.translate(c, "\r\n", "  ")
    return F.translate(F.trim(F.regexp_replace(one_line, r"\s\s+", " ")), "\t", " ")


def decontract(c: Column) -> Column:
    for found, put in fixed.CONTRACTIONS:
        c = F.replace(c, F.lit(found), F.lit(put))
    return c


def clean_document(c: Column) -> Column:
    c = F.regexp_replace(decontract(c), r"\n+", ". ")
    c = F.regexp_replace(c, r"[^A-Za-z0-9?' .,-]+", " ")
    return F.trim(F.regexp_replace(c, r" +", " "))


def remove_stop_words(c: Column, words: list[str]) -> Column:
    kept = F.filter(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)), lambda w: ~F.lower(w).isin(*words))
    return F.array_join(kept, " ")


def quoted(c: Column) -> Column:
    """First quoted span, straight quotes before curly; an empty span counts as found."""
    straight = F.regexp_extract_all(c, F.lit(r'"(.*?)"'), F.lit(1))
    curly = F.regexp_extract_all(c, F.lit(r"“(.*?)”"), F.lit(1))
    return F.coalesce(F.get(straight, F.lit(0)), F.get(curly, F.lit(0)), F.lit(""))


def words(c: Column, lower: bool = True, min_len: int = 1) -> Column:
    runs = F.regexp_extract_all(F.lower(c) if lower else c, F.lit(RUN), F.lit(0))
    return F.filter(runs, lambda w: F.length(w) >= min_len) if min_len > 1 else runs


def key_terms(tokens: Column) -> Column:
    """Distinct proper nouns (as written) and subjects (lower-cased) that are not stop words."""
    proper = lambda t: t["pos"].isin("NNP", "PROPN")
    kept = F.filter(tokens, lambda t: (proper(t) | (t["dep"] == "nsubj")) & ~t["is_stop"])
    named = F.transform(kept, lambda t: F.when(proper(t), t["token"]).otherwise(F.lower(t["token"])))
    return F.array_join(F.array_distinct(named), " ")


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, r"//([^/]+)", 1)


def url_allowed(c: Column) -> Column:
    return ~_contains_any(c, fixed.BLOCKED_DOMAINS)


def url_ok(c: Column) -> Column:
    return ~_contains_any(c, fixed.BLOCKED_FILES)


def _contains_any(c, parts):
    hit = F.lit(False)
    for part in parts:
        hit = hit | c.contains(part)
    return hit


def pub_date(c: Column, style: str) -> Column:
    """Date text after the last bullet (``bullet``) or after the first word (``lead``), parsed; else the sentinel."""
    if style == "bullet":
        text = F.trim(F.element_at(F.split(c, "•"), -1))
    else:
        parts = F.split(F.trim(c), r"\s+")
        text = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    parsed = F.coalesce(F.try_to_date(text, "MMMM d, yyyy"), F.try_to_date(text, "d MMMM yyyy"))
    return F.coalesce(parsed, F.lit(fixed.MISSING_DATE).cast("date"))


def bracket_list(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[([^\]]*)\]"), F.lit(1))


def preview(c: Column, n: int = 50) -> Column:
    """First characters of a text with literal backslash pairs and whitespace runs reduced to blanks."""
    head = F.substring(c, 1, n)
    head = F.replace(F.replace(head, F.lit(r"\n"), F.lit(" ")), F.lit(r"\t"), F.lit(" "))
    return F.regexp_replace(head, r"\s\s+", " ")


def normalise_rating(label: Column, source: Column) -> Column:
    """struct(rating, class) for a source's rating label; unknown labels take the source's default."""
    def lookup(table, default):
        pair = lambda p: F.struct(F.lit(p[0]).alias("rating"), F.lit(p[1]).alias("class"))
        known = F.create_map(*[x for name, p in table.items() for x in (F.lit(name), pair(p))])
        return F.coalesce(F.try_element_at(known, F.trim(label)), pair(default))

    labels = lookup(fixed.LABEL_RATINGS, fixed.LABEL_UNKNOWN)
    return F.when(source == "label", labels).otherwise(lookup(fixed.METER_RATINGS, fixed.METER_UNKNOWN))


def rating_class(c: Column) -> Column:
    return (c > 50).cast("int")


def encode_class(c: Column, values: list[str], binary: bool = False) -> Column:
    """Class code = list index; binary code = 1 for the last class only. Unknown labels give null."""
    index = F.nullif(F.array_position(_lit_array(values), c), F.lit(0)) - 1
    return (index == len(values) - 1).cast("int") if binary else index.cast("int")


def decode_class(c: Column, values: list[str]) -> Column:
    return F.get(_lit_array(values), c)


def class_count(values: list[str], binary: bool = False) -> int:
    return 2 if binary else len(values)


def softmax_p1(scores: Column) -> Column:
    """Softmax probability of the second class."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.exp(F.get(scores, F.lit(1)) - top) / total


def argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def drop_unknown(c: Column) -> Column:
    tokens = F.filter(F.split(c, r"\s+"), lambda t: (t != "") & (t != fixed.UNKNOWN))
    return F.array_join(tokens, " ")


def cui_text(subject: Column, predicate: Column, obj: Column, keep_unknown: bool = False) -> Column:
    parts = [subject, predicate, obj]
    if not keep_unknown:
        parts = [drop_unknown(p) for p in parts]
    return F.concat_ws(f" {fixed.SEPARATOR} ", *parts)


def fix_label(c: Column) -> Column:
    return F.replace(c, F.lit("<50"), F.lit("Less Than 50"))


def xml_label(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit("and"))


def kg_parts(uri: Column) -> Column:
    """Language, term and relation name of a knowledge-graph URI (null where a part is absent)."""
    parts = F.split(uri, "/")
    return F.struct(
        F.try_element_at(parts, F.lit(3)).alias("lang"),
        F.try_element_at(parts, F.lit(4)).alias("term"),
        F.try_element_at(parts, F.lit(3)).alias("relation"),
    )


def sem_ok(tui: Column, group: Column) -> Column:
    return tui.isin(*fixed.CLINICAL_TUIS) | group.isin(*fixed.CLINICAL_GROUPS)


def white_tokens(c: Column) -> Column:
    """Whitespace-separated tokens; an empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def strip_wiki(c: Column) -> Column:
    """Plain words of one markup chunk: rules in order, then letters and digits only, single blanks."""
    for pattern, put in fixed.MARKUP_RULES:
        c = F.regexp_replace(c, pattern, put)
    return F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), r"[^A-Za-z0-9]+", " ")


def wiki_text(c: Column) -> Column:
    """Clean text lines of the ``<text ...>`` elements of an encyclopedia dump, up to a redirect mark."""
    def element(e):
        chunks = F.regexp_extract_all(e, F.lit(r"[^>]*>"), F.lit(0))
        redirect = F.array_position(F.transform(chunks, lambda x: F.lower(x).contains("#redirect")), True)
        return F.slice(chunks, F.lit(1), F.when(redirect > 0, redirect - 1).otherwise(F.size(chunks)).cast("int"))

    elements = F.regexp_extract_all(c, F.lit(r"(?s)<text .*?</text>"), F.lit(0))
    return F.flatten(F.transform(elements, lambda e: F.transform(element(e), lambda x: strip_wiki(x))))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` computed once, for values that a lambda reads per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an int array, null for null.

    A fold that appends would copy its growing result at each step. Here each pass adds the sums that stand 1, 2, 4, ...
    places before, so that an array of n numbers takes log n passes.
    """
    def moved(now, width):
        return F.concat(F.array_repeat(F.lit(0), width), F.slice(now, F.lit(1), F.size(now) - width))

    def summed(v):
        passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
        return F.aggregate(passes, v, lambda now, k: F.zip_with(now, moved(now, F.pow(F.lit(2), k).cast("int")), lambda x, y: x + y))

    return let(numbers, lambda v: F.when(F.size(v) < 2, v).when(v.isNotNull(), summed(v)))


def lookup(pairs: list[tuple[str, Column]], kind: str) -> Callable[[Column], Column]:
    """A function from a text to its value (null if it has none) for a list that is small and known to the driver.

    A map is searched from its start, so the pairs are dealt to as many small maps by the text's hash, and one is searched.
    """
    if not pairs:
        return lambda key: F.lit(None).cast(kind)
    buckets = 1 << len(pairs).bit_length()
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    dealt: list[list[Column]] = [[] for _ in range(buckets)]
    placed = SparkSession.getActiveSession().createDataFrame([(i, key) for i, (key, _) in enumerate(pairs)], "i int, key string")
    for r in placed.select("i", place(F.col("key")).alias("at")).collect():
        dealt[r["at"]] += [F.lit(pairs[r["i"]][0]), pairs[r["i"]][1].cast(kind)]
    maps = F.array(*[F.create_map(*held) if held else F.lit(None).cast(f"map<string,{kind}>") for held in dealt])
    return lambda key: F.try_element_at(F.get(maps, place(key)), key)


def token_spans(c: Column) -> Column:
    """Word runs in order: array of (text, start, gap), ``start`` zero-based, ``gap`` the text before the run."""
    return F.arrow_udf(word_spans, SPANS)(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)), F.split(c, RUN))


# Elements whose text makes a block, and the character entities decoded in page text.
BLOCK_TAGS = "title|h1|h2|h3|h4|h5|h6|li|p"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
ANY_TAG = r"<[^>]+>"


def _visible(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def page_blocks(html: Column) -> Column:
    """Texts of title, heading, list-item and paragraph elements in document order.

    A block runs from its opening tag to the next opening or closing tag of any block element, so each
    piece of text belongs to its innermost block even when closing tags are missing.
    """
    shown = F.regexp_replace(html, HIDDEN, "")
    opened = F.regexp_replace(shown, rf"(?i)<({BLOCK_TAGS})(\s[^>]*)?>", "\x01")
    pieces = let(F.split(opened, "\x01"), lambda p: F.slice(p, F.lit(2), F.size(p)))
    inner = F.transform(pieces, lambda p: F.get(F.split(p, rf"(?i)</({BLOCK_TAGS})\s*>"), F.lit(0)))
    texts = F.transform(inner, lambda p: F.trim(F.regexp_replace(_visible(F.regexp_replace(p, ANY_TAG, "")), r"\s+", " ")))
    return F.filter(texts, lambda t: t != "")


def page_text(html: Column) -> Column:
    """All visible text of a page."""
    shown = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), ANY_TAG, "")
    return _visible(shown)


def first_link(html: Column) -> Column:
    """First link target of a page that no block list rejects; ``''`` if none."""
    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
    usable = F.filter(links, lambda u: url_allowed(u) & url_ok(u))
    return F.coalesce(F.get(usable, F.lit(0)), F.lit(""))
