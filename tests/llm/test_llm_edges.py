"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlens.llm import components, decontamination, html, jaccard, knn, licenses, lines, lm, packing, quality, warc, words

LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = [
    (1, "One two three four five six seven eight nine ten eleven.", "a"), (2, "one TWO three four five six seven eight nine ten eleven.", "a"), (2, "one TWO three four five six seven eight nine ten eleven.", "a"),
    (3, None, None), (4, "", "b"), (5, " \n\t\n", "b"), (6, "hi", "c"), (7, "hi", "c"), (None, "one two three four five six seven eight nine ten eleven.", "a"), (8, LONG, "d"), (9, LONG + " end", "d"),
    (10, "no Été \U0001f600 café naïve İ words here", "e"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({"score": F.lit("x"), "n": F.lit(1), "row": F.lit(2), "node": F.lit(3), "line": F.lit(4), "n_words": F.lit("y"), "hash": F.lit(None).cast("string"), "bits": F.lit(0), "lang": F.lit("en"), "n_chars": F.lit(0).cast("long")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_words_equal_regular_expressions():
    texts = [t for _, t, _ in DOCS] + ["a" * 300_000, "\x0b\x0c x y \x1f z", "A1-b_C"]
    for member, rx in ((words.SPACED, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for run in words.runs(pa.array(texts), member, size=1000):
            for i in range(run.hi - run.lo):
                part = slice(run.first[i], run.first[i + 1])
                own = [bytes(run.data[a:b]).decode() for a, b in zip(run.starts[part], run.ends[part])]
                assert own == re.findall(rx, re.sub("[A-Z]", lambda m: m[0].lower(), texts[run.lo + i] or ""))
                for w, h in zip(own, run.hashes[part]):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 1), (9, 1), (6, 0), (7, 0), (None, 1), (4, None), (1, 1)], "doc_id long, quality int")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert quality.accepted(docs, labels.where("quality = 1")).count() == docs.count()  # one label only: nothing is rejected
    assert quality.accepted(empty, labels).count() == 0 and quality.accepted(docs, labels.where("false")).count() == docs.count()
    scores = [r["score"] for r in quality.scored(docs, quality.train(docs, labels)).collect()]
    assert len(scores) == len(DOCS) and all(0 <= s <= 1 for s in scores)


def test_ranking_needs_differences_only():
    x = np.random.default_rng(1).standard_normal((400, 5))
    good = x[:, 0] + 0.1 * x[:, 1] > -0.5
    model = quality.fit(x, good, pairs=4000)
    assert ((model.score(x) >= 0.3) == good).mean() > 0.97
    assert model.score(x) == pytest.approx(quality.fit(x + 7, good, pairs=4000).score(x + 7))


def test_jaccard(spark, docs, empty):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert {(1, 7, 1), (2, 7, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (None, 7, None), (8, 29996, 8), (9, 29997, 8), (10, 4, 10)} == found
    assert jaccard.join(docs).count() == len(DOCS) and jaccard.join(empty).count() == 0
    kept = jaccard.firsts(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 10]


def test_jaccard_large_groups(spark, monkeypatch):
    """Copies with one to many changed words, in leaves of many parts and elements of many nodes, against all pairs."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base[:12] + [f"y{i}-{k}" for k in range(40)])) for i in range(80)]
    for name, value in (("LEAF", 16), ("PART", 32), ("WIDE", 20), ("_BUCKET_POSTINGS", 500)):
        monkeypatch.setattr(jaccard, name, value)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == root and 3 < len(set(root.values())) < 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 3), (200, 201), (201, 202), (202, 200), (7, 7)]
    found = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200, 202: 200}


def test_lm(docs, empty):
    found = lm.score(docs).collect()
    assert len(found) == len(DOCS) and {r["train_tokens"] for r in found if True} == {found[0]["train_tokens"]}
    blank = [r for r in found if r["doc_id"] in (3, 4, 5)]
    assert all(r["n_tokens"] == 1 and r["score"] < 0 for r in blank)
    assert lm.score(empty).count() == 0


def test_lm_trains_on_every_training_document(spark):
    """More documents than one task is dealt: the network reads each token of each of them."""
    n = 6500
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (~lm.held_out(F.col("id"))).alias("train"))
    hashes = np.sort(np.append(words.text_hash(["a", "b", "c"]), lm.END))
    kept = rows.where("train").count()
    _, read = lm.train(rows, lm.Vocabulary.of(hashes, np.full(4, kept), 4 * kept, 4))
    assert read == 4 * kept


def test_lm_gradients_and_whole_documents():
    rng = np.random.default_rng(0)
    net = lm.Network.new()
    token = rng.integers(0, lm.CLASSES * lm.MEMBERS + 2, 60).astype(np.int32)
    data = lm.streams(token, np.array([0, 7, 8, 30, 60]), 3)
    _, previous, fresh, target, _, active = next(lm.windows(data, 12))
    use = np.arange(12)[:, None] < data.length[:active]
    state = np.zeros((active, lm.STATE))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    g, _, _ = net.gradient(previous, fresh, target, use, state)
    for k, at in (("e", (previous[3, 0], 5)), ("u", (2, 3)), ("b", (4,)), ("wc", (1, 2)), ("bc", (3,))):
        sides = []
        for step in (1e-3, -2e-3):
            net.w[k][at] += step
            sides.append(net.gradient(previous, fresh, target, use, state)[1])
        net.w[k][at] += 1e-3
        assert g[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=1e-2, abs=1e-5)
    # one document alone and among others, cut into windows: the same probability
    def total(first, size):
        out, s = np.zeros(len(first) - 1), lm.streams(token, np.array(first), 3)
        h = np.zeros((s.token.shape[1], lm.STATE), dtype=np.float32)
        for _, previous, fresh, target, doc, active in lm.windows(s, size):
            states = lm.Network.new().forward(previous, fresh, h[:active])
            h[:active] = states[-1]
            on = doc.reshape(-1) >= 0
            out += np.bincount(doc.reshape(-1)[on], weights=lm.Network.new().log_probability(states.reshape(-1, lm.STATE)[on], target.reshape(-1)[on]), minlength=len(out))
        return out

    assert total([0, 7, 8, 30, 60], 4) == pytest.approx(total([0, 7, 8, 30, 60], 50), rel=1e-4)


def test_lm_probabilities_add_up():
    net, states = lm.Network.new(), np.random.default_rng(2).standard_normal((2, lm.STATE)).astype(np.float32)
    every = np.arange(lm.CLASSES * lm.MEMBERS + 2)
    for s in states:
        assert np.exp(net.log_probability(np.repeat(s[None], len(every), 0), every)).sum() == pytest.approx(1, rel=1e-3)


def test_html():
    side = '<div class="sidebar">Side text here.</div><div id="content"><h2>Head</h2><p>One, two. Three four five six seven, eight.</p><p>A.</p><ul><li>x<li>y</ul><form>f</form>'
    assert html.article(f"<html><head><title>x</title></head><body>{side}<section class='comments'><p>Great post, thanks a lot. I read it.</p></section></div><footer>foo</footer><p>tail <") == "Head\nOne, two. Three four five six seven, eight.\nA.\nx\ny"
    assert html.article("plain text only, no tags.") == "plain text only, no tags."
    assert html.article("<p>a&nbsp;&lt;b&gt;\n x &#233;") == "a <b> x é"
    assert html.article("<article><nav>menu</nav><p>a<script>var t='</p>';</script> b<br>c<!-- <p>d</p> --></p><aside>e</aside><p><a href='?a>b'>f</a></article>") == "a b c\nf"
    assert html.article("") == html.article("<nav>a</nav>") == html.article("<") == html.article("<p") == ""
    assert html.article("<article>" + "<div><b>y" * 20_000 + "x").count("\n") == 19_999
    assert html.article("</p></div>" * 20_000 + "<p><b>" * 20_000 + "x") == "x"
    assert html.article("1 < 2, <3") == "1 < 2, <3"


def test_html_keeps_what_the_paths_select():
    one, two = "One, two, three. Four five, six.", "Seven, eight, nine. Ten, and so on."
    assert html.article(f"<article><p>{one}</p><p>{two}</p></article><article><p>More, of it. Here, there, too.</p></article>") == f"{one}\n{two}\nMore, of it. Here, there, too."
    inner = "<section id='side-effects'><p>Head, ache. Fever.</p></section><h2 id='related-work'>Related</h2><h2 id='search'>Search</h2><p>a, b. c</p>"
    assert html.article(f"<article><p>{one}</p>{inner}<div class='related-posts'><p>{two}</p></div><div class='share-buttons'>{two}</div></article>") == f"{one}\nHead, ache. Fever.\nRelated\nSearch\na, b. c"
    assert html.article(f"<body><p>Lead, text. It goes on, and on.</p><div><p>{one}</p><p>{two}</p><p>{two}</p></div></body>") == f"Lead, text. It goes on, and on.\n{one}\n{two}\n{two}"
    assert html.article(f"<article><p>{one}</p><p>{two}</p></article><p>After, the end. It goes on, as it does.</p><footer>f, g. h</footer>") == f"{one}\n{two}\nAfter, the end. It goes on, as it does."
    assert html.article(f"<body><div class='related-work'>x, y. z</div><article><p>{one}</p></article><article class='comment'><p>{two}</p></article></body>") == one


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>a, b.</p>", "t"), (1, "u", "", "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    found = html.extract(pages)
    assert sorted((r["text"], r["n_chars"]) for r in found.collect()) == [("", 0), ("", 0), ("", 0), ("a, b.", 5)]
    assert html.extract(pages.where("false")).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "two three FOUR"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15, w16"), (3, None), (4, "..."), (1, "two three FOUR"), (11, "café"), (None, "hi")], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontamination.report(docs, items).collect())
    hit = (11, 3, ("1",))
    assert found == [(0, *hit), (1, *hit), (2, *hit), (2, *hit), (3, 0, 0, ()), (4, 0, 0, ()), (5, 0, 0, ()), (6, 1, 1, ()), (7, 1, 1, ()), (8, 30000, 12, ("2",)), (9, 30001, 12, ("2",)), (10, 8, 1, ("11",))]
    assert decontamination.report(empty, items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontamination.report(docs, items.where("false")).collect())
    kept = decontamination.clean(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]  # an item without an id leaks all the same
    assert sorted(kept.columns) == sorted(docs.columns)


def test_separate_occurrences_are_not_joined(spark):
    """A late match in an earlier document, then two occurrences of one item far apart, and one with a changed word."""
    item = [f"q{i}" for i in range(10)]
    long = [f"q{i}" for i in range(21)]
    fill = lambda n: ["x"] * n
    rows = [(1, fill(900) + item), (2, item + fill(190) + item + fill(5)), (3, long[:10] + ["x"] + long[11:]), (4, fill(3) + long[:15])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (2, "q3 q4")], "item_id long, text string")
    found = {r["doc_id"]: r["n_hit"] for r in decontamination.report(docs, items).collect()}
    assert found == {1: 10, 2: 20, 3: 20, 4: 15}


def test_phrase_blocks_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c a b d c x a"), (2, "c q b q q a")], "doc_id long, text string")
    index = decontamination.build_index(docs)
    terms = lambda *w: [int(x) for x in words.text_hash(list(w)).view(np.int64)]
    phrases = spark.createDataFrame([(1, terms("a", "b")), (2, terms("b", "c", "a")), (3, terms("z"))], "phrase long, terms array<long>")
    for block in (1, 100):
        found = {(r["doc_id"], r["phrase"], r["start"], r["length"]) for r in decontamination.search(index, phrases, block=block).collect()}
        assert found == {(1, 1, 0, 2), (1, 1, 3, 2), (1, 2, 1, 3)}
    near = {(r["doc_id"], r["phrase"], r["start"], r["length"]) for r in decontamination.search(index, phrases, within=3).collect()}
    assert near == {(1, 1, 0, 2), (1, 1, 1, 3), (1, 1, 3, 2), (1, 2, 0, 3), (1, 2, 1, 3), (1, 2, 2, 3)}


def test_knn(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).astype(float).tolist()) for i in range(300)] + [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan")] * 6), (None, [1.0] * 6), (7, [0.5] * 6), (303, [])]
    rows += [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200)]
    vectors = knn.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = knn.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=7, pivots=9, slice_rows=40).collect()
    data = [(i, (np.floor(np.array(v + [0.0] * (6 - len(v))) * 1024)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in data:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in data if i != q)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert knn.top_k(vectors, vectors.where("false")).count() == 0 and knn.top_k(vectors.where("false"), vectors).count() == 0


def test_products_are_exact():
    big = np.array([[2**31 - 1, -(2**31)]], dtype=np.int64)
    assert knn.products(big, big).item() == (2**31 - 1) ** 2 + 2**62


def test_licenses_with_many_matches_in_a_paragraph(spark):
    text = "Copyright 2020 by me, some rights reserved\n" * 20_000 + "copyright" + " 1999" * 50_000
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (r["n_words"], r["labels"], r["n_base"]) == (7 * 20_000 + 50_001, "cc,copyright", 0)
    assert r["score"] == pytest.approx((5 * 20_000 + 50_001) / (7 * 20_000 + 50_001))


def test_licenses(docs, empty, spark):
    found = licenses.scan(docs)
    assert {r["n_base"] for r in found.collect()} == {0} and "score" in found.columns and found.schema["n_words"].dataType.simpleString() == "bigint"
    assert licenses.scan(empty).count() == 0
    texts = [
        ("CC-BY cc by; GENERAL PUBLIC\nLICENSE", 3, 0, 4, "cc-by,gpl"), ("xcc by all rights reservedx", 0, None, None, ""), ("all rights reserved all rights reserved", 2, 0, 3, "reserved"), (None, 0, None, None, ""),
    ]
    rows = licenses.scan(spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == t[1:]
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "This work is licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl-2.1", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "(c) 2020, in the public domain": "",
        "This text is in the public domain": "public-domain", "Copyright (c) 2019 2020 by me": "copyright",
    }
    rows = licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == list(lines.values())
    assert rows[0]["score"] == 1.0


def test_wrapped_license_texts(spark):
    """Matches over line feeds, as in the usual headers; a blank line ends a match."""
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the X."
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted"
    lgpl = "it under the terms of the GNU Lesser General\n * Public\n * License"
    rows = [(0, gpl), (1, lgpl), (2, bsd), (3, "the ISC\n \nlicense"), (4, "x\n\nthe MIT\nLicense\n\n\ny")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in found] == ["gpl", "gpl,lgpl", "bsd", "", "mit"]
    assert found[0]["score"] == pytest.approx(13 / 19) and found[2]["score"] == 1.0 and found[4]["score"] == pytest.approx(2 / 5)


def test_lines(spark, docs, empty):
    base = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    texts = [
        (1, f"{base}\nshort line\n{base}\n"), (2, f"short line\n{base.upper()} extra\nnew words in this line"), (3, base.replace("w5", "other") + "\n" + base.replace("w3 ", "")),
        (4, base.replace("w5", "p").replace("w6", "q")), (5, "a b c d e\r"), (6, "a b c d e"), (None, "a b c d e"), (7, "a b c d x"), (5, "a b c d e"),
    ]
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumn("gone", F.lit(1))
    out = {(r["row"]["doc_id"], r["row"]["text"]): r for r in lines.dedup(table).collect()}
    assert [out[t]["text"] for t in texts[:4]] == [f"{base}\nshort line\n", "short line\nnew words in this line", "", texts[3][1]]
    left = sorted((i or 99, t) for (i, _), t in ((k, r["text"]) for k, r in out.items()) if i is None or i > 4)
    assert sum(t != "" for _, t in left) == 2 and (7, "a b c d x") in left and (99, "") in left  # one of the two texts of 5, and 7
    kept = lines.cleaned(docs)
    assert kept.columns == docs.columns and lines.cleaned(empty).count() == 0
    assert sorted((r["doc_id"] or 99) for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 10]


def test_many_near_lines(spark):
    """Lines of one pattern: random edits against all pairs, word by word."""
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(14)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.integers(0, 4)):
            at, kind = int(rng.integers(0, len(own))), rng.integers(0, 3)
            own[at : at + int(kind != 1)] = [f"e{rng.integers(0, 3)}"] * int(kind != 2)
        rows.append((i, " ".join(own)))
    found = {r["row"]["doc_id"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect() if r["n_equal"] + r["n_near"]}

    def near(a, b):
        return a == b or (len(a) >= 10 and len(b) >= 10 and lines.one_edit(a, b))

    split = [t.split() for _, t in rows]
    assert found == {i for i in range(300) if any(near(split[j], split[i]) for j in range(i))}


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u1", "xé"), (2, None, "xé"), (3, "u3\r\nX: y", None), (4, "u4", ""), (None, "u5", "xé"), (2, None, "xé"), (9, "u9", "z" * 100_000)], "page_id long, url string, html string").withColumn("sha256", F.lit("q"))
    archive = warc.write_archive(pages)
    found = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read_back(spark, archive).collect())
    assert found == [(0, 3, "revisit", 2), (1, 3, "revisit", 2), (2, 3, "response", 0), (2, 3, "response", 0), (3, 0, "revisit", 4), (4, 0, "response", 0), (9, 100_000, "response", 0)]
    assert spark.read.parquet(archive.payloads).count() == 3
    records = {(r["page_id"], bytes(r["record"])) for r in warc.records(spark, archive).collect()}
    one = next(r for i, r in records if i == 9)
    head, _, body = one.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 100000" in head and body == b"z" * 100_000 + b"\r\n\r\n"
    assert all(b"\r\nX: y" not in r for _, r in records)
    assert {r["record_type"] for r in warc.read_back(spark, warc.write_archive(pages, min_bytes=200_000)).collect()} == {"response"}
    assert warc.read_back(spark, warc.write_archive(pages.where("false"))).count() == 0


def test_packing(spark, docs, empty):
    found = packing.pack(docs, capacity=50, shard_pieces=5).collect()
    assert sorted({r["doc_id"] or 0 for r in found}) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert sum(r["n_tokens"] for r in found) == sum(len((t or "").split()) for _, t, _ in DOCS)
    assert all(r["bin_id"] is None for r in found if r["n_tokens"] == 0)
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, offsets, n = packing.best_fit([7, 6, 3, 3, 2], [1, 2, 1, 4, 2], [1, 2, 4, 1, 8], 10)
    assert (bins, offsets, n) == ([0, 1, 1, 2, 0], [0, 0, 6, 0, 7], 3)


def test_lm_windows_share_memory_and_words_are_found_by_their_first_bits():
    net = lm.Network.new()
    rng = np.random.default_rng(4)
    shape = (12, 5)
    token, fresh = rng.integers(0, lm.CLASSES * lm.MEMBERS + 2, shape), np.zeros(shape, dtype=bool)
    first = net.forward(token, fresh, np.zeros((5, lm.STATE), dtype=np.float32))
    kept = first.copy()
    again = net.forward(token, fresh, np.zeros((5, lm.STATE), dtype=np.float32))
    assert np.shares_memory(first, again) and (again == kept).all()
    hashes = np.unique(np.append(rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64), [lm.END, np.uint64(5), np.uint64(2**64 - 1)]))
    v = lm.Vocabulary.of(hashes, np.ones(len(hashes), dtype=np.int64), 1, 1)
    assert (v.find(hashes) == np.arange(len(hashes))).all()
    assert (v.find(np.array([0, 2, 6, 2**64 - 2], dtype=np.uint64)) == -1).all()
