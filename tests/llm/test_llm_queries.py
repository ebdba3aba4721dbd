"""Queries of the training-data operators against their SQL and, where there is none, against brute force."""

import collections
import glob
import math
import os
import re
import zlib

import duckdb
import pytest

from claimlens.llm import lm, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([f"{v[i]:.9g}" if isinstance(v[i], float) else str(v[i]) for i in order] for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, data, con, name):
    df = queries.QUERIES[name](spark, data)
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_quality_ranks_held_out_labels(spark, con):
    """At sf0.01: every held-out good document scores above every bad one, but for one pair in fifty."""
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.QUERIES["op1_bradley_terry_quality"](spark, folder).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    assert len(found) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(found[i]["score"], q) for i, q in labels.items() if found[i]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum((s >= 0.3) == q for s, q in held) >= 0.95 * len(held)


def test_lm_matches_counts_and_beats_unigrams(spark, data, con):
    docs = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    tokens = {i: WORDS.findall(lower(x)) + [""] for i, x in docs.items()}
    train = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total, kinds = sum(train.values()), len(train)
    held = [0.0, 0.0]
    for r in lm.score(spark.read.parquet(f"{data}/documents.parquet")).collect():
        own = tokens[r["doc_id"]]
        base = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if r["held_out"]:
            held = [held[0] + r["base_score"], held[1] + r["score"]]
    assert held[1] > held[0]


def test_licenses_match_a_walk_over_words(spark, con, data):
    from claimlens.llm import licenses

    rules = [r | {"rx": re.compile(r["pattern"])} for r in licenses.rules()]
    docs = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for g in queries.QUERIES["op7_license_rules"](spark, data).collect():
        low = lower(docs[g["doc_id"]])
        w = ALNUM.findall(low)
        places = [(j, label) for phrase, label in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        labels, covered = {x for _, x in places}, 0
        for paragraph in re.split(r"\n[\t\x0b-\r ]*\n", low):
            x, reach = " ".join(ALNUM.findall(paragraph)), -1
            for s, e, _, label, n in sorted((m.start(), -m.end(), -r["priority"], r["label"], m.group().count(" ") + 1) for r in rules for m in r["rx"].finditer(x)):
                if -e > reach:
                    reach, covered = -e, covered + n
                    labels.add(label)
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(places), min((j for j, _ in places), default=None), max((j for j, _ in places), default=None))
        assert (g["base_labels"], g["labels"]) == (",".join(sorted({x for _, x in places})), ",".join(sorted(labels)))
        assert g["score"] == pytest.approx(min(1, covered / max(1, len(w))))


def test_every_license_rule_is_reached_by_its_keywords():
    from claimlens.llm import licenses

    assert len(licenses.rules()) > 420 and len(licenses.TEXTS) > 130
    texts = ["Licensed under the GNU GPL v3", "see the Mozilla Public License for details", "EPL 2.0", "MPL 2 0", "the unlicense", "SPDX-License-Identifier: MIT-0", "for research purposes only",
             "released under the Open Database License", "CC0 1.0 Universal", "Llama 3 Community License", "OpenRAIL-M", "MS-PL", "EUPL", "CDDL 1.0", "dedicated to the public domain", "with proper attribution",
             "No part of this book may be reproduced", "unauthorized copying of this file is strictly prohibited", "Proprietary and confidential", "Neither the name of X nor Y may be used to endorse or promote products",
             "You should have received a copy of the GNU Affero General Public License", "Tous droits réservés", "Alle Rechte vorbehalten", "The Software shall be used for Good, not Evil.", "Business Source License 1.1",
             "Reprinted with permission", "Share-Alike", "for internal use only", "with LLVM exceptions", "Datenlizenz Deutschland", "Terms of Service apply", "Polyform Shield", "Gemma Terms of Use", "use-based restrictions",
             "This product includes software developed by the OpenSSL Project", "Not for redistribution", "Reproduction is strictly forbidden", "fair use notice", "Licence Ouverte", "no known copyright restrictions",
             "GPL v2 only", "GPL 3 or later", "Commons Clause", "Hippocratic License", "shareware version", "Elastic License 2.0", "Llama 3.1 Community License Agreement", "Copyright (c) 1999, 2001-2004",
             "All advertising materials mentioning features or use of this software", "This is free and unencumbered software released into the public domain", "http://www.apache.org/licenses/LICENSE-2.0"]
    for text in texts:
        x = " ".join(ALNUM.findall(lower(text)))
        hits = [r for r in licenses.rules() if re.search(r["pattern"], x)]
        assert hits, text
        assert all(r["keyword"] in x for r in hits) and any(k in x for k in licenses.KEYWORDS), text


def test_pages_keep_exactly_the_article(spark, con, data):
    import html

    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    for r in queries.QUERIES["op4_tag_path_extraction"](spark, data).collect():
        page = pages[r["page_id"]]
        start = page.index("<article>") + 9
        end = page.find("</article>")
        inside = page[start:end] if end >= 0 else re.sub(r"<[^>]*$", "", page[start:])
        inside = re.sub(r"</?b>", "", inside).replace("<br>", " ")
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]+>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_packing_is_whole_and_compatible(spark, con, data):
    docs = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    found = queries.QUERIES["op10_best_fit_packing"](spark, data).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        bins[r["bin_id"]].append(r)
    for i, text in docs.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["piece"]):
            assert r["start"] == at
            at += r["n_tokens"]
        assert at == len(WORDS.findall(text or ""))
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in own] == [sum(x["n_tokens"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["n_tokens"] for r in own) <= 2048
        assert len({r["source"] for r in own}) == len({r["cluster"] for r in own}) == len(own)


def test_pipeline_stages_do_what_they_say(spark, data):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, data)
        seen[name] = ({r["doc_id"]: r for r in docs.collect()}, out.collect())
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name][1], out.schema)
    before, after = seen["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert sum((i in kept) == q for i, q in labels.items()) >= 0.97 * len(labels)
    before, after = seen["line_dedup"]
    lines = collections.Counter(tuple(WORDS.findall(lower(x))) for r in after for x in (r["text"] or "").split("\n"))
    assert all(n == 1 for w, n in lines.items() if len(w) >= 5)
    before, after = seen["jaccard_join"]

    def shingles(text):
        w = WORDS.findall(lower(text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {i: shingles(r["text"]) for i, r in before.items()}
    kept = {r["doc_id"] for r in after}
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b) > 0
    assert not any(near(sets[a], sets[b]) for a in kept for b in kept if a < b)
    assert all(any(near(sets[i], sets[j]) for j in sets if j < i) for i in set(sets) - kept)
    before, after = seen["decontamination"]
    leaks = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = ALNUM.findall(lower(r["text"]))
        leaks |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    for i, r in before.items():
        w = ALNUM.findall(lower(r["text"]))
        hit = any(tuple(w[k : k + n]) in leaks for n in {len(x) for x in leaks} for k in range(len(w) - n + 1))
        assert hit == (i not in {x["doc_id"] for x in after})
