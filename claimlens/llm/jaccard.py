"""Exact Jaccard join of word n-gram sets with signature trees.

A document's set is a list of 64-bit n-gram hashes. Documents with the same smallest element form the lowest nodes, which
most near copies share. By the prefix rule two linked sets also share one of their first ``n - ceil(t n) + 1``
elements in any common order; here by hash, with frequent n-grams last. So only nodes with a common prefix element
are ever compared. Inside and between nodes the search goes down signature trees: tree nodes hold the OR of their
members' bitmaps and their range of sizes, and two of them are searched at once, going down only while the largest overlap
that bitmaps and sizes allow can reach the threshold.

1. Equal sets become one representative.
2. Each node is searched by itself with full sets; large nodes in parts that all hold the node's first document.
3. Pairs of nodes that share a prefix element, and large nodes with themselves, are searched by bitmaps; documents that step 2
   has connected are passed over. What may be linked is checked with full sets, first one pair of every two components,
   then what is left between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise
from claimlens.llm import blocks, words
from claimlens.llm.blocks import first_of, groups
from claimlens.llm.components import components

SHINGLE = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents of a node searched with full sets at once; larger nodes are cut, each part with the node's first document.
LEAF = 128
#: Documents of a node that travel or stay together when nodes are compared.
PART = 512
#: Elements of more nodes than this are searched by their documents instead of pairs of nodes.
WIDE = 512
#: One document in SAMPLE counts n-grams to put frequent ones last; the list has HOT entries at most. It orders, it drops nothing.
SAMPLE = 32
HOT = 200_000
_BUCKET_POSTINGS = 600_000


def shingle_runs(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, cuts, hashes): the distinct n-gram hashes of rows lo to hi, ascending in each row."""
    for run in words.runs(column):
        n = np.diff(run.first)
        rows = run.hi - run.lo
        grams = words.windows(run.hashes, k)
        at = np.arange(len(grams))
        row = run.row[: len(grams)]
        inside = at + k <= run.first[row + 1]
        row, grams = row[inside], grams[inside]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            own = [words.mix(words.windows(run.hashes[run.first[i] : run.first[i + 1]], int(n[i])) + np.uint64(n[i]))[0] for i in short]
            row, grams = np.concatenate([row, short]), np.concatenate([grams, np.array(own, dtype=np.uint64)])
        order = np.lexsort((grams, row))
        row, grams = row[order], grams[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
        row, grams = row[new], grams[new]
        yield run.lo, run.hi, np.searchsorted(row, np.arange(rows + 1)), grams


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits of the hashes' low ends, at least four per element, as bytes."""
    bits = 64
    while bits < 4 * len(hashes):
        bits *= 2
    out = np.zeros(bits, dtype=np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis: 64-bit words) brought to ``size`` words; a set bit stays set."""
    return bits if bits.shape[-1] == size else np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, size), axis=-2)


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets reach the threshold; an empty set is linked with nothing."""
    if not len(a) or not len(b) or percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class Node:
    """Some sets: OR of their bitmaps, range of sizes, and the most elements by which a set exceeds its bits."""

    __slots__ = ("low", "high", "slack", "bits", "kids", "members", "sizes", "rows")

    @classmethod
    def leaf(cls, members: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> Node:
        self = cls()
        self.low, self.high, self.slack = int(sizes.min()), int(sizes.max()), int((sizes - popcount(rows)).max())
        self.bits, self.kids, self.members, self.sizes, self.rows = np.bitwise_or.reduce(rows, axis=0), (), members, sizes, rows
        return self

    @classmethod
    def over(cls, kids: list[Node]) -> Node:
        self = cls()
        least = min(len(k.bits) for k in kids)
        self.low, self.high, self.kids = min(k.low for k in kids), max(k.high for k in kids), kids
        # on fewer bits more elements may share one: then only the sizes say how many
        self.slack = max(k.slack if len(k.bits) == least else k.high for k in kids)
        self.bits = np.bitwise_or.reduce([fold(k.bits, least) for k in kids])
        return self

    def may_link(self, other: Node, percent: int) -> bool:
        """Whether sizes and the largest possible overlap allow a link between members."""
        if percent * max(self.low, other.low) > 100 * min(self.high, other.high):
            return False
        least = min(len(self.bits), len(other.bits))
        common = int(popcount(fold(self.bits, least) & fold(other.bits, least)))
        most = min(self.high, other.high)
        for side in (self, other):
            if len(side.bits) == least:
                most = min(most, common + side.slack)
        return (100 + percent) * most >= percent * (self.low + other.low)


def tree(sizes: np.ndarray, bits: list[bytes], fan: int = 8, leaf: int = 32) -> Node:
    """Signature tree of sets given by size and bitmap; neighbours in size and bitmap length come together."""
    order = np.lexsort((sizes, [len(b) for b in bits]))
    nodes, at = [], 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and upto - at < leaf and len(bits[order[upto]]) == len(bits[order[at]]):
            upto += 1
        own = order[at:upto]
        nodes.append(Node.leaf(own, sizes[own], np.stack([np.frombuffer(bits[i], dtype=np.uint64) for i in own])))
        at = upto
    while len(nodes) > 1:
        nodes = [Node.over(nodes[i : i + fan]) if len(nodes[i : i + fan]) > 1 else nodes[i] for i in range(0, len(nodes), fan)]
    return nodes[0]


def search(x: Node, y: Node, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dual traversal: members of x and y (arrays i, j) that pass every bound, with their largest possible overlap."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        if x is y and x.kids:
            todo += [(a, b) for n, a in enumerate(x.kids) for b in x.kids[n:]]
        elif x is not y and not x.may_link(y, percent):
            continue
        elif x.kids or y.kids:
            # the larger one opens
            todo += [(k, y) for k in x.kids] if x.kids and (not y.kids or x.high >= y.high) else [(x, k) for k in y.kids]
        else:
            least = min(x.rows.shape[1], y.rows.shape[1])
            a, b = fold(x.rows, least), fold(y.rows, least)
            common = popcount(a[:, None, :] & b[None, :, :])
            n, m = x.sizes[:, None], y.sizes[None, :]
            # elements whose bit the other set lacks are not shared
            most = np.minimum(n - popcount(a)[:, None] + common, m - popcount(b)[None, :] + common)
            good = (percent * np.maximum(n, m) <= 100 * np.minimum(n, m)) & ((100 + percent) * most >= percent * (n + m))
            if x is y:
                good &= np.tri(len(good), k=-1, dtype=bool)
            i, j = np.nonzero(good)
            if len(i):
                yield x.members[i], y.members[j], most[i, j]


class Sets:
    """Disjoint sets of member numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def hot_shingles(docs: DataFrame, sample: int = SAMPLE, most: int = HOT) -> np.ndarray:
    """Sorted hashes of n-grams that occur in several sampled documents, the most frequent ``most`` at most."""

    def batches(it):
        for b in it:
            for _, _, _, grams in shingle_runs(b["text"]):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    some = _usable(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    counted = some.mapInArrow(batches, "gram long").groupBy("gram").count().where("count >= 3")
    rows = counted.orderBy(F.desc("count"), "gram").limit(most).select("gram").toArrow()
    return np.sort(rows["gram"].to_numpy().view(np.uint64))


def signatures(docs: DataFrame, hot: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, a, b, leaf, bits, prefix): set size, two hashes of the set, its node, bitmap and prefix elements (48 bits each)."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)  # HOT hashes at most

    def batches(it):
        hot = sent.value
        for b in it:
            for lo, hi, cuts, grams in shingle_runs(b["text"]):
                n = np.diff(cuts)
                ids = b["doc_id"].slice(lo, hi - lo)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(words.mix(grams + np.uint64(s)))]) for s in (1, 2)]
                one, two = (pa.array((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64)) for s in sums)
                late = np.zeros(len(grams), dtype=np.uint64)
                if len(hot) and len(grams):
                    late = (hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams).astype(np.uint64)
                row = np.repeat(np.arange(hi - lo), n)
                ordered = grams[np.lexsort(((grams >> np.uint64(1)) | (late << np.uint64(63)), row))]
                keep = np.arange(len(grams)) - cuts[row] < prefix_length(n, percent)[row]
                packed = np.ascontiguousarray((ordered[keep] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
                bits = [bitmap(grams[cuts[i] : cuts[i + 1]]).tobytes() if n[i] else b"" for i in range(hi - lo)]
                ends = np.concatenate([[0], np.cumsum(prefix_length(n, percent))]) * 6
                leaf = np.zeros(hi - lo, dtype=np.int64)  # the smallest element, 40 bits of it
                leaf[n > 0] = (grams[cuts[:-1][n > 0]] >> np.uint64(24)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n.astype(np.int64)), one, two, pa.array(leaf), pa.array(bits, pa.binary()), words.binary(packed.reshape(-1), ends)], ["doc_id", "n", "a", "b", "leaf", "bits", "prefix"])

    return _usable(docs).mapInArrow(batches, "doc_id long, n long, a long, b long, leaf long, bits binary, prefix binary")


def elements(prefix: bytes) -> np.ndarray:
    wide = np.zeros((len(prefix) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(prefix, dtype=np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).reshape(-1)


def _leaf_links(docs: DataFrame, leaves: DataFrame, percent: int) -> DataFrame:
    """(a, b): enough links inside the parts (leaf, part, doc_id) to connect what is linked there."""

    def batches(it):
        for t in groups(it, ["leaf", "part"]):
            ids = t["doc_id"].to_numpy()
            sets = [g[c[i] : c[i + 1]] for _, _, c, g in shingle_runs(t["text"]) for i in range(len(c) - 1)]
            known, links = Sets(len(ids)), []
            if len(ids) > 1:
                root = tree(np.array([len(x) for x in sets]), [bitmap(x).tobytes() for x in sets])
                for left, right, _ in search(root, root, percent):
                    for i, j in zip(left.tolist(), right.tolist()):
                        if known.root(i) != known.root(j) and linked(sets[i], sets[j], percent):
                            known.join(i, j)
                            links.append((ids[i], ids[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    texts = _usable(docs).join(leaves, "doc_id").select("leaf", "part", "doc_id", "text")
    return texts.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(batches, "a long, b long")


_POSTING = np.dtype([("element", "V6"), ("node", "V5")])


def _node_pairs(table: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that share a prefix element: as pairs (a, b), and as (element, node) rows where very many share one."""

    def low_bytes(values: np.ndarray, n: int) -> np.ndarray:
        return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n]).view(f"V{n}").reshape(-1)

    def wide(values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(values), 8), dtype=np.uint8)
        out[:, :n] = np.ascontiguousarray(values).view(np.uint8).reshape(-1, n)
        return out.view(np.int64).reshape(-1)

    def unique(element: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((node, element))
        element, node = element[order], node[order]
        new = first_of(element, node)
        return element[new], node[new]

    def deal(it):
        for b in it:
            parts = [elements(p) for p in b["prefix"].to_pylist()]
            element = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, dtype=np.int64)
            element, node = unique(element, np.repeat(b["leaf"].to_numpy(), [len(p) for p in parts]))
            out = np.empty(len(element), dtype=_POSTING)
            out["element"], out["node"] = low_bytes(element, 6), low_bytes(node, 5)
            yield blocks.pack("posting", element % buckets, out)

    def each(t: pa.Table):
        x = blocks.unpack(t, "posting", _POSTING)
        element, node = unique(wide(x["element"], 6), wide(x["node"], 5))
        start = np.flatnonzero(first_of(element))
        count = np.diff(np.append(start, len(element)))
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for size in np.unique(count[(count > 1) & (count <= WIDE)]):
            i, j = np.triu_indices(size, 1)
            for at in np.array_split(start[count == size], max(1, (count == size).sum() * len(i) // 2_000_000)):
                rows = node[at[:, None] + np.arange(size)]
                pairs = np.unique(np.stack([rows[:, i].reshape(-1), rows[:, j].reshape(-1)], axis=1), axis=0)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        many = np.repeat(count > WIDE, count)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "element"])
        yield pa.RecordBatch.from_arrays([pa.array(node[many]), pa.nulls(int(many.sum()), pa.int64()), pa.array(element[many])], ["a", "b", "element"])

    met = materialise(blocks.meet(table.select("leaf", "prefix").mapInArrow(deal, blocks.BLOCK), buckets, each, "a long, b long, element long"), "node-pairs")
    return met.where("element is null").select("a", "b").distinct(), met.where("element is not null").select("element", F.col("a").alias("node"))


_MAYBE = "a long, b long, a_root long, b_root long, most long"


def _compare(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Pairs of documents of different components that bitmaps and sizes let be linked.

    ``rows`` are (key, side, doc_id, root, n, bits); in a group side 0 is compared with side 1, and side 2 with itself.
    """

    def batches(it):
        for t in groups(it, key):
            side, ids, root = t["side"].to_numpy(), t["doc_id"].to_numpy(), t["root"].to_numpy()
            n, bits = t["n"].to_numpy(), t["bits"].to_pylist()
            found = []
            trees = {s: (own, tree(n[own], [bits[i] for i in own])) for s in (0, 1, 2) if len(own := np.flatnonzero(side == s))}
            for s, r in ((0, 1), (2, 2)):
                if s in trees and r in trees:
                    for i, j, most in search(trees[s][1], trees[r][1], percent):
                        i, j = trees[s][0][i], trees[r][0][j]
                        new = root[i] != root[j]
                        found.append(np.stack([ids[i], ids[j], root[i], root[j], most], axis=1)[new])
            if found:
                out = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(5)], ["a", "b", "a_root", "b_root", "most"])

    return rows.repartition(*key).sortWithinPartitions(*key).select(*key, "side", "doc_id", "root", "n", "bits").mapInArrow(batches, _MAYBE)


def _between(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Candidates of paired nodes: the larger node stays in parts, the documents of the smaller one visit them."""
    sizes = members.groupBy("node").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    side = lambda s: sizes.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("m", "low", "high")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(percent) * F.greatest("a_low", "b_low") <= 100 * F.least("a_high", "b_high"))
    swap = F.col("b_m") > F.col("a_m")
    own = sizes.where(F.col("m") > LEAF).select(F.col("node").alias("x"), F.col("node").alias("y"), F.col("m").alias("x_m"), F.col("m").alias("y_m"))
    both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"), F.greatest("a_m", "b_m").alias("x_m"), F.least("a_m", "b_m").alias("y_m"))
    both = materialise(both.unionByName(own), "size-pairs")
    # parts of the staying node, and groups of its visitors
    plan = both.groupBy("x").agg(F.ceil(F.max("x_m") / PART).cast("int").alias("parts"), F.ceil(F.sum("y_m") / (4 * PART)).cast("int").alias("turns"))
    cut = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    columns = ["x", "part", "turn", "side", "doc_id", "root", "n", "bits"]
    stay = members.join(plan, members["node"] == plan["x"]).select("x", cut("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("side"), "doc_id", "root", "n", "bits")
    visit = both.select("x", "y").join(plan, "x").join(members, F.col("y") == members["node"])
    visit = visit.select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), cut("turns").alias("turn"), F.lit(1).alias("side"), "doc_id", "root", "n", "bits")
    return _compare(stay.select(columns).unionByName(visit.select(columns)), ["x", "part", "turn"], percent)


def _among(wide: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Candidates of the nodes that share one very common element: their documents in blocks that meet pairwise."""
    full = wide.join(members, "node").select("element", "doc_id", "root", "n", "bits")
    sized = full.join(full.groupBy("element").agg(F.ceil(F.count("*") / (2 * PART)).cast("int").alias("parts")), "element")
    sized = sized.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = sized.select("element", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "doc_id", "root", "n", "bits")
    return _compare(rows, ["element", "x", "y"], percent)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the threshold."""

    def batches(it):
        for b in it:
            left = [g[c[i] : c[i + 1]] for _, _, c, g in shingle_runs(b["text"]) for i in range(len(c) - 1)]
            right = [g[c[i] : c[i + 1]] for _, _, c, g in shingle_runs(b["other"]) for i in range(len(c) - 1)]
            yield b.select(["a", "b"]).filter(pa.array([linked(x, y, percent) for x, y in zip(left, right)], pa.bool_()))

    both = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), "text"), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
    return both.select("a", "b", "text", "other").mapInArrow(batches, "a long, b long")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): for every row its set size and the smallest doc_id reachable by links.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer than five words is one shingle; texts without
    words (null, empty) have no set and no links. A doc_id that occurs with several texts is one document that is linked
    wherever one of them is. Rows with a null doc_id are returned without a component. Other columns are ignored.
    """
    blocks.bound_batches(docs.sparkSession)
    table = materialise(signatures(docs, hot_shingles(docs), percent), "signatures")
    full = table.where("n > 0 and doc_id is not null")
    same = full.groupBy("n", "a", "b").agg(F.min("doc_id").alias("first"))
    slim = full.select("doc_id", "n", "a", "b")
    alike = materialise(slim.join(same, ["n", "a", "b"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "equal-sets")
    # one row per different set; an id with several sets has several
    reps = full.select("doc_id", "n", "a", "b", "leaf", "bits").join(same.select(F.col("first").alias("doc_id"), "n", "a", "b"), ["doc_id", "n", "a", "b"], "left_semi").dropDuplicates(["doc_id", "n", "a", "b"])
    reps = materialise(reps.select(F.col("leaf").alias("node"), "doc_id", "n", "bits"), "sets")

    sizes = reps.groupBy("node").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m > 1")
    parts = reps.select("doc_id", F.col("node").alias("leaf")).join(sizes.withColumnRenamed("node", "leaf"), "leaf").withColumn("parts", F.ceil(F.col("m") / LEAF).cast("int"))
    part = F.when(F.col("doc_id") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    leaves = parts.select("doc_id", "leaf", F.explode(part).alias("part")).distinct()
    near = materialise(_leaf_links(docs, leaves, percent), "leaf-links")

    nodes = components(near)
    members = materialise(reps.join(nodes.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "members")
    postings = full.agg(F.sum(F.octet_length("prefix") / 6)).first()[0] or 0
    pairs, wide = _node_pairs(full, max(8, int(postings // _BUCKET_POSTINGS)))
    maybe = materialise(_between(pairs, members, percent).unionByName(_among(wide, members, percent)), "maybe")
    ids = maybe.select(F.col("a").alias("doc_id")).unionByName(maybe.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialise(_usable(docs).join(ids, "doc_id"), "pair-texts")

    # the likeliest pair of every two components, then all pairs that still lie between components
    low, high = F.least("a_root", "b_root"), F.greatest("a_root", "b_root")
    best = maybe.groupBy(low.alias("x"), high.alias("y")).agg(F.max(F.struct("most", "a", "b")).alias("best")).select("best.a", "best.b")
    edges = nodes.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(alike)
    roots = components(edges.unionByName(materialise(_verified(best, texts, percent), "links")))
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_now"))
    left = maybe.select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_now", "a") != F.coalesce("b_now", "b"))
    more = materialise(_verified(left, texts, percent), "links")
    if more.limit(1).count():
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    found = table.select("doc_id", F.col("n").alias("n_shingles")).join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def firsts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: those with the smallest doc_id of a component, rows without a set, and rows without an id.

    All columns pass through; repeated rows of the smallest doc_id stay.
    """
    gone = join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
