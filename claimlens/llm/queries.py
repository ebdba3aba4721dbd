"""Registered queries of this subpackage and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import bpe, collocations, decontamination, html, jaccard, knn, licenses, lines, lm, merkle, packing, quality, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op6_voronoi_knn", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    vectors = knn.integers(table(spark, folder, "embeddings"))
    return knn.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


@register("op9_warc_archive", """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages
)
SELECT page_id, url, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM p
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_back(spark, warc.write_archive(table(spark, folder, "pages")))


@register("op10_best_fit_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@register("op1_bradley_terry_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.scored(docs, quality.train(docs, table(spark, folder, "labels")))
    score = F.col("score")
    return found.select(F.col("row.doc_id").alias("doc_id"), quality.held_out(F.col("row.doc_id")).alias("held_out"), score, F.when(score >= quality.CUT, 1).otherwise(0).alias("predicted"))


@register("op7_license_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"


@register("op5_benchmark_index", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
g AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)
),
m AS (SELECT g.doc_id, g.i, g.k, p.item FROM g JOIN p USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPLIT = r"regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{9}-\x{D}]+')"


@register("op8_line_dedup", f"""
WITH l AS (
  SELECT doc_id, i, line, {_SPLIT} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
),
f AS (SELECT w, len(w) AS n, min({{'d': doc_id, 'i': i}}) AS o FROM l WHERE len(w) >= 5 GROUP BY w),
k AS (
  SELECT w, n, o, s, hash(s, m, list_slice(w, 1, m // 2)) AS half FROM (SELECT w, n, o, unnest([n, n - 1]) AS m, 'a' AS s FROM f WHERE n >= 10)
  UNION ALL SELECT w, n, o, s, hash(s, m, list_slice(w, n - m // 2 + 1, n)) FROM (SELECT w, n, o, unnest([n, n - 1]) AS m, 'z' AS s FROM f WHERE n >= 10)
),
p AS (SELECT DISTINCT a.w AS v, a.n AS vn, b.w AS w, b.n AS n, b.o AS o FROM k a JOIN k b ON a.half = b.half AND a.o < b.o AND abs(a.n - b.n) <= 1),
near AS (
  SELECT DISTINCT o FROM p WHERE CASE
    WHEN vn = n THEN len(list_filter(range(1, n + 1), lambda i: v[i] <> w[i])) = 1
    WHEN vn < n THEN len(list_filter(range(1, n + 1), lambda i: list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, n)) = v)) > 0
    ELSE len(list_filter(range(1, vn + 1), lambda i: list_concat(list_slice(v, 1, i - 1), list_slice(v, i + 1, vn)) = w)) > 0 END
),
c AS (
  SELECT l.doc_id, l.i, l.line, len(l.w) >= 5 AND {{'d': l.doc_id, 'i': l.i}} <> f.o AS equal_line, near.o IS NOT NULL AS near_line
  FROM l LEFT JOIN f USING (w) LEFT JOIN near ON near.o = {{'d': l.doc_id, 'i': l.i}}
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE equal_line) AS n_equal, count(*) FILTER (WHERE near_line) AS n_near,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(equal_line, false) AND NOT near_line), '') AS text
FROM c GROUP BY doc_id
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup(table(spark, folder, "documents")).select("row.doc_id", "n_lines", "n_equal", "n_near", "text")


@register("op2_jaccard_signature_trees", """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{20}\\x{9}-\\x{D}]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM (
    SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
  ) JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * o >= 75 * (a.n + b.n - o)
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(root) AS c FROM r GROUP BY 1) USING (doc_id)
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@register("op3_recurrent_lm")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


@register("op4_tag_path_extraction")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).select("row.page_id", "row.url", "text", "n_chars")


@register("op11_distinct_word_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    found = bpe.decode(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), tokenizer), tokenizer)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@register("op12_collocation_tries", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x{A}-\x{D}]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x{20}\x{9}]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
u AS (
  SELECT c.lang, c.g, c.a, x.cut, x.l, x.r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.l AS HUGEINT) + x.r) AS BIGINT) AS score
  FROM c JOIN (
    SELECT h.lang, h.g, h.cut, a.f AS l, b.f AS r FROM (
      SELECT lang, g, cut, array_to_string(list_slice(w, 1, cut), ' ') AS p, array_to_string(list_slice(w, cut + 1, k), ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
    ) h JOIN f a ON a.lang = h.lang AND a.g = h.p JOIN f b ON b.lang = h.lang AND b.g = h.q
  ) x ON x.lang = c.lang AND x.g = c.g
),
v AS (SELECT lang, g, a, l, r, score FROM u QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (
  SELECT DISTINCT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g, a FROM (
    SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)
  )
),
t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT v.lang, row_number() OVER (PARTITION BY v.lang ORDER BY score DESC, v.a DESC, v.g) AS rank, v.g AS phrase, v.a, l, r, CAST(t.n AS BIGINT) AS n, score
FROM v JOIN t ON t.lang = v.lang WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = v.lang AND o.g = v.g AND CAST(100 AS HUGEINT) * o.a >= CAST(80 AS HUGEINT) * v.a)
QUALIFY rank <= 2000
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


#: CRC-32 of the decimal id, bit by bit.
_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_BYTES = "list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda j: CAST(ascii(substr(CAST(doc_id AS VARCHAR), j, 1)) AS BIGINT))"
_EVEN = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: {_STEP}), 4294967295) % 2 = 0"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


@register("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT *, replace(text, chr(10), '') AS bare FROM documents),
l AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="bare")} AS other,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM d
),
t AS (
  SELECT source, 0 AS lv, i, leaf AS h, count(*) OVER (PARTITION BY source) AS m FROM l
  UNION ALL
  SELECT source, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM t WHERE m > 1 GROUP BY source, lv, i // 3
),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t WHERE m = 1),
u AS (
  SELECT 0 AS lv, i, h, count(*) OVER () AS m FROM s
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM u WHERE m > 1 GROUP BY lv, i // 3
),
k AS (SELECT l.doc_id, l.leaf, l.other, l.i, l.source, s.h AS subroot, s.i AS si FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
p AS (
  SELECT k.doc_id, t.lv, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < k.i // (3 ** t.lv)::BIGINT), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > k.i // (3 ** t.lv)::BIGINT), '') AS z
  FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source AND t.m > 1 AND t.i // 3 = k.i // (3 ** (t.lv + 1))::BIGINT GROUP BY 1, 2
  UNION ALL
  SELECT k.doc_id, 1000 + u.lv, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < k.si // (3 ** u.lv)::BIGINT), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > k.si // (3 ** u.lv)::BIGINT), '')
  FROM k JOIN u ON u.m > 1 AND u.i // 3 = k.si // (3 ** (u.lv + 1))::BIGINT GROUP BY 1, 2
),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lv) AS step, a, z FROM p),
f AS (
  SELECT doc_id, 0 AS step, CASE WHEN crc32_even THEN other ELSE leaf END AS h FROM (SELECT *, {_EVEN} AS crc32_even FROM k)
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(o.a || f.h || o.z) FROM f JOIN o ON o.doc_id = f.doc_id AND o.step = f.step + 1
),
g AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM f GROUP BY 1)
SELECT k.doc_id, leaf, subroot, (SELECT h FROM u WHERE m = 1) AS root,
       sha256(coalesce((SELECT string_agg(a || z, '' ORDER BY step) FROM o WHERE o.doc_id = k.doc_id), '')) AS proof_sha256,
       folded_root, folded_root = (SELECT h FROM u WHERE m = 1) AS verified
FROM k JOIN g USING (doc_id)
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rest = [F.col(c) for c in merkle.FIELDS[:-1]]
    bare = merkle.digest(*rest, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(table(spark, folder, "documents"), {"other": F.when(even, bare).otherwise(merkle.digest(*rest, F.col("text")))})
    path, root = F.col("path"), F.col("root")
    folded = found.select("doc_id", "leaf", "subroot", root, F.sha2(merkle.proof(path), 256).alias("proof_sha256"), merkle.folded(F.col("other"), path).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == root)
