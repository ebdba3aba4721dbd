"""Merkle manifest, byte-pair encoding and collocations against brute force, with edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimlens.llm import bpe, collocations, merkle, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        at = i // 3 * 3
        yield "".join(nodes[at:i]), "".join(nodes[i + 1 : at + 3])
        i //= 3


def manifest_by_hand(rows):
    """{doc_id: (leaf, subroot, root, path)} of (doc_id, source, lang, n_chars, text) rows with distinct ids."""
    parts = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts.setdefault(r[1], []).append(r)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([sha("".join(map(field, r))) for r in parts[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    return {
        r[0]: (trees[s][0][i], trees[s][-1][0], top[-1][0], [*siblings(trees[s], i), *siblings(top, k)])
        for k, s in enumerate(names) for i, r in enumerate(parts[s])
    }


ROWS = [(None, "b", "en", 3, "abc"), (900, None, None, None, None), (901, "", "de", 0, ""), (902, "é", "fr", 1, "a\nb\n"), (903, "Z", "fr", 1, "\n" * 3), (904, "long", "en", 1, "x\ny " * 50_000)]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("digits", "n"), [(1, 40), (2, 40), (6, 40), (1, 0)])
def test_manifest_equals_trees_built_by_hand(spark, monkeypatch, digits, n):
    monkeypatch.setattr(merkle, "LEVELS", digits)  # blocks of 3 and 9 rows make rounds of blocks even here
    rows = ROWS + [(i, "hot" if i % 4 else f"s{i % 7}", "en", i, f"line {i}\nand\n") for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"hash": F.lit(1), "row": F.lit("x"), "path": F.lit(None).cast("int"), "part": F.lit(0), "rank": F.lit(5), "size": F.lit(2)})
    found = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in merkle.manifest(docs).collect()}
    assert found == manifest_by_hand(rows)


def test_manifest_of_repeated_and_of_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "x")] * 3 + [(1, "a", "en", 1, "y")], SCHEMA)
    found = merkle.manifest(docs).collect()
    leaves = sorted([sha("".join(map(field, (1, "a", "en", 1, t)))) for t in "xxxy"])
    assert [r["leaf"] for r in sorted(found, key=lambda r: r["leaf"])] == leaves and {r["root"] for r in found} == {levels(leaves)[-1][0]}
    for r in found:
        now = r["leaf"]
        for left, right in r["path"]:
            now = sha(left + now + right)
        assert now == r["root"]
    assert merkle.manifest(docs.where("false")).count() == 0
    one = merkle.manifest(docs.limit(1)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def test_manifest_query_sees_tampering(spark, data):
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_merkle_manifest"](spark, data).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = manifest_by_hand(rows)
    assert len(found) == len(rows)
    for i, s, lang, n, text in rows:
        leaf, subroot, root, path = want[i]
        even = zlib.crc32(str(i).encode()) % 2 == 0
        now = sha("".join(map(field, (i, s, lang, n, text.replace("\n", "") if even and text is not None else text))))
        for left, right in path:
            now = sha(left + now + right)
        r = found[i]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) == (leaf, subroot, root, sha("".join(a + z for a, z in path)), now, now == root)
        assert r["verified"] == (not (even and "\n" in (text or "")))


ODD = [
    None, "", " \t\r\n", "Hello, World!! don't I'VE we'll", "a<|endoftext|>b <|startoftext|> <|endoftext|>", "x y  ̈ é İstanbul ﬁ Å \x1c\x00q",
    "日本語のテキスト 中文 한국어", "1234567 ½ ² ٣", "wort" * 5000, " wide　blank ", "🙂🙃 zero​width", "same same\nsame", "same same\nsame",
]


def test_encoding_equals_the_library(spark, data, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)  # many blocks
    text = bpe.read_tokenizer(PATH)
    own = spark.createDataFrame(list(enumerate(ODD, 10**6)), "doc_id long, text string")
    docs = own.unionByName(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")).withColumns({"ids": F.lit("x"), "block": F.lit(1), "k": F.lit(None).cast("int"), "row": F.array(F.lit(1))})
    encoded = bpe.encode(docs, text)
    assert encoded.columns == ["row", "ids"] and encoded.schema["row"].dataType.names == ["doc_id", "ids", "block", "k", "row"]
    found = {r["row"]["doc_id"]: (r["ids"], r["text"]) for r in bpe.decode(encoded, text).collect()}
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert found.pop(r["doc_id"]) == (ids, library.decode(ids, skip_special_tokens=False))
    assert not found


def test_encoding_of_rows_that_come_in_another_order(spark):
    text = bpe.read_tokenizer(PATH)
    rows = spark.createDataFrame([(i, f"w{i} x{i * i} common words {i % 7}") for i in range(200)], "doc_id long, text string")
    mixed = rows.mapInPandas(lambda it: (p.sample(frac=1) for p in it), rows.schema)
    want = {r["row"]["doc_id"]: r["ids"] for r in bpe.encode(rows, text).collect()}
    assert {r["row"]["doc_id"]: r["ids"] for r in bpe.encode(mixed, text).collect()} == want and len(want) == 200
    twice = rows.unionByName(rows)  # equal blocks
    assert sorted((r["row"]["doc_id"], r["ids"]) for r in bpe.encode(twice, text).collect()) == sorted([*want.items()] * 2)


def test_encoding_of_no_rows_and_unknown_ids(spark):
    text = bpe.read_tokenizer(PATH)
    docs = spark.createDataFrame([("only text",)], "text string")
    assert bpe.encode(docs.where("false"), text).count() == 0
    assert len(bpe.encode(docs, text).collect()[0]["ids"]) == 2
    ids = spark.createDataFrame([(1, [320, 10**6, 321]), (2, []), (3, None), (4, [10**6])], "row int, ids array<int>")
    assert [r["text"] for r in bpe.decode(ids, text).sort("row").collect()] == ["a</w> b</w>", "", "", ""]


def collocations_by_hand(rows, least, most):
    counts, total = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k, i in itertools.product(range(1, 5), range(len(w))):
                if i + k <= len(w):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        named = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {q[i : i + n] for q, b in named.items() for n in range(2, len(q)) for i in range(len(q) - n + 1) if 100 * b >= 80 * f[q[i : i + n]]}
        best = []
        for p, a in named.items():
            if p not in held:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


def test_collocations_equal_counts_by_hand(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 40)  # many tries and passes
    monkeypatch.setattr(collocations, "TRIES", 2)
    rng = np.random.default_rng(5)
    words = [*"abcdefgh", "Été", "naïve", " x", "de", "en", "x" * 3000]
    rows = [(rng.choice(["en", "de", "", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", " ; "]) for w in rng.choice(words, rng.integers(0, 60), p=np.array([6, 5, 4, 3, 2] + [1] * 9) / 29))) for _ in range(150)]
    rows = [(None if lang is None else str(lang), t) for lang, t in rows]
    rows += [("en", None), (None, ""), ("fr", " \t\n"), ("es", "go go go go go " * 3000), ("es", "A B C D, a b c d. " * 9)] + [("it", "uno due tre quattro cinque")] * 8
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "word": F.lit("x"), "hash": F.lit(None).cast("string"), "rank": F.lit(0)})
    for least, most in ((8, 2000), (8, 3), (2, 25)):
        found = sorted(tuple(r) for r in collocations.collocations(docs, least, most).collect())
        assert found == collocations_by_hand(rows, least, most)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("lang = 'fr'")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, n = 9_000_000_000_000_000_000, 9_223_372_036_854_775_807
    phrases = spark.createDataFrame([([1, 2], a), ([1, 2, 3], a // 5 * 4 - 1), ([4, 2], a), ([4, 2, 3], a // 5 * 4)], "words array<bigint>, n long")
    words = spark.createDataFrame([(h, n - h) for h in range(1, 5)], "hash long, n long")
    pairs = spark.createDataFrame([([2, 3], n)], "words array<bigint>, n long")
    found = {tuple(r["words"]): (r["a"], r["l"], r["r"], r["score"]) for r in collocations.scored(phrases.unionByName(pairs), words).collect()}
    assert found[1, 2] == (a, n - 1, n - 2, 2_000_000 * a // (2 * n - 3)) and (4, 2) not in found  # held by (4, 2, 3) to 80 %
    assert found[1, 2, 3][3] == 2_000_000 * (a // 5 * 4 - 1) // (2 * n - 1)


def test_trie_counts_equal_a_dictionary():
    rng = np.random.default_rng(2)
    phrases = sorted({tuple(rng.integers(1, 60, rng.integers(1, 5)).tolist()) for _ in range(3000)} | {(i,) for i in range(1000, 1500)} | {(7, i) for i in range(2000, 4000)})
    trie = collocations.Trie.build([np.array(p, dtype=np.uint64) for p in phrases])

    class Text:
        hashes = np.concatenate([rng.integers(1, 60, 20_000), rng.integers(1000, 4000, 3000), [7, 2000]]).astype(np.uint64)
        joined = rng.random(23_002) < 0.9

    want = Counter()
    for i in range(len(Text.hashes)):
        for k in range(1, 5):
            if i + k <= len(Text.hashes) and Text.joined[i + 1 : i + k].all():
                want[tuple(Text.hashes[i : i + k].tolist())] += 1
    assert trie.count(Text).tolist() == [want[p] for p in phrases]
    assert len(trie.base) < 4 * sum(map(len, phrases))  # the array stays close to the number of states
