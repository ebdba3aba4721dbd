"""Language-model scores: a gated recurrent network with a class-factored softmax, over smoothed corpus counts.

Counts of every token of every training document come from one distributed count. The most frequent words (the head) get
softmax probabilities inside equal-sized classes; the next ones and all others form two more classes, inside which a
word's share is its smoothed count. So the model, like the base, gives every token of an open vocabulary a probability,
and all of them add up to one.

The network reads the words of a document one after the other. Scoring and training run on many documents side by side
in lanes, window by window; the state is carried from window to window, so a document is scored as a whole, and
gradients are cut at the window's start.

Tokens beyond the head and the next words are not looked up where they stand: their hashes are dealt to the counts
and come back as one sum per document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import materialise
from claimlens.llm import blocks, words
from claimlens.llm.blocks import first_of

#: Words with a softmax probability of their own: CLASSES classes of MEMBERS words.
CLASSES, MEMBERS = 32, 32
#: Words sent to the tasks with their counts, head included.
KNOWN = 65_536
STATE = 20
WINDOW = 32
LANES = 256
#: Tokens that a task deals to its lanes at once: enough that one long document does not leave the other lanes idle for long.
DEALT_TOKENS = 2_500_000
#: Longer documents are trained on in spans, each from an empty state; scoring reads every document as a whole.
TRAIN_SPAN = 2048
#: Parts of the training documents; the tasks' weights are averaged after each part.
ROUNDS = 2
_RUN = 8 << 20
_LEAD_BITS = 18
_BUCKET_DOCS = 6000

#: Hash of the end token; words have random 64-bit hashes.
END = np.uint64(1)
_COUNT = np.dtype([("hash", "u8"), ("count", "i8"), ("seen", "u1")])
_TAIL = np.dtype([("hash", "u8"), ("doc", "i8"), ("n", "i4")])
_SUM = np.dtype([("doc", "i8"), ("far", "f8"), ("known", "i8")])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


class Streams(NamedTuple):
    """Documents side by side: lane l holds ``length[l]`` tokens; lanes are sorted from long to short."""

    token: np.ndarray
    fresh: np.ndarray
    doc: np.ndarray
    length: np.ndarray


def streams(token: np.ndarray, first: np.ndarray, lanes: int = LANES) -> Streams:
    """Deals documents (tokens ``first[i]:first[i + 1]``, none empty) to lanes, longest first, each to the shortest lane."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    count = min(lanes, len(n))
    load, owner = np.zeros(count, dtype=np.int64), np.empty(len(n), dtype=np.int64)
    for at in range(0, len(order), count):
        part = order[at : at + count]
        owner[part] = np.argsort(load, kind="stable")[: len(part)]
        load[owner[part]] += n[part]
    rank = np.argsort(-load, kind="stable")
    lane_of = np.empty(count, dtype=np.int64)
    lane_of[rank] = np.arange(count)
    lane = lane_of[owner]
    by = np.lexsort((np.arange(len(n)), lane))
    total = int(load.max(initial=0))
    out, fresh, doc = np.zeros((total, count), dtype=np.int32), np.zeros((total, count), dtype=bool), np.full((total, count), -1, dtype=np.int32)
    begin = np.cumsum(n[by]) - n[by]
    start_of_lane = np.concatenate([[0], np.cumsum(load[rank])[:-1]])
    at = begin - start_of_lane[lane[by]]
    flat = np.repeat(at - begin, n[by]) + np.arange(n.sum())
    source = np.repeat(first[:-1][by] - begin, n[by]) + np.arange(n.sum())
    column = np.repeat(lane[by], n[by])
    out[flat, column] = token[source]
    doc[flat, column] = np.repeat(by, n[by])
    fresh[at, lane[by]] = True
    return Streams(out, fresh, doc, load[rank])


class Network:
    """Gated recurrent network over token numbers: head words 0 to H - 1, then the two outer classes, then the start."""

    SHAPES = {
        "e": (CLASSES * MEMBERS + 3, 3 * STATE), "u": (STATE, 3 * STATE), "b": (3 * STATE,), "wc": (STATE, CLASSES + 2), "bc": (CLASSES + 2,),
        "wo": (CLASSES, STATE, MEMBERS), "bo": (CLASSES, MEMBERS),
    }

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self._rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of that shape whose memory the next window takes again: new memory would be paged in for each window."""
        size, held = int(np.prod(shape)), self._rooms.get(name)
        if held is None or len(held) < size or held.dtype != self.w["u"].dtype:
            held = self._rooms[name] = np.empty(size, dtype=self.w["u"].dtype)
        return held[:size].reshape(shape)

    @classmethod
    def new(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        w = {k: (rng.standard_normal(s) * (0.3 if k in "eu" else 0.1)).astype(np.float32) for k, s in cls.SHAPES.items()}
        for k in ("b", "bc", "bo"):
            w[k][:] = 0
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].reshape(-1) for k in self.SHAPES])

    @classmethod
    def unflat(cls, values: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in cls.SHAPES.items():
            size = int(np.prod(s))
            out[k] = np.asarray(values[at : at + size], dtype=np.float32).reshape(s)
            at += size
        return cls(out)

    def forward(self, previous: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step of a window (steps x lanes); ``h`` is the state before it.

        The result, and what ``keep`` gets, is good until the next window is read.
        """
        w, s = self.w, STATE
        steps, lanes = previous.shape
        held = steps if keep is not None else 1
        # units first and lanes last, so that gates are whole stretches of memory; the result is a view of it
        out, inputs = self._room("out", s, steps, lanes), self._room("inputs", 3 * s, steps, lanes)
        turns, gates, news = self._room("turns", held, 3 * s, lanes), self._room("gates", held, 2 * s, lanes), self._room("news", held, s, lanes)
        np.take(np.ascontiguousarray((w["e"] + w["b"]).T), previous, axis=1, out=inputs, mode="clip")
        u, h = np.ascontiguousarray(w["u"].T), np.ascontiguousarray(h.T)
        half, one = np.float32(0.5), np.float32(1)
        for t in range(steps):
            if fresh[t].any():
                h = h * ~fresh[t]
            x, r, g, n, new = inputs[:, t], turns[t % held], gates[t % held], news[t % held], out[:, t]
            np.matmul(u, h, out=r)
            np.add(x[: 2 * s], r[: 2 * s], out=g)
            g *= half
            np.tanh(g, out=g)
            g += one
            g *= half
            np.multiply(g[:s], r[2 * s :], out=n)
            n += x[2 * s :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, g, n, r[2 * s :]))
            np.subtract(h, n, out=new)
            new *= g[s:]
            new += n
            h = new
        return out.transpose(1, 2, 0)

    def log_probability(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the class, and inside head classes of the word, for rows of states."""
        w, head = self.w, CLASSES * MEMBERS
        cls = np.where(target < head, target // MEMBERS, target - head + CLASSES).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        states, target, cls = np.take(states.T, order, axis=1), target[order], cls[order]
        # units, classes and members first: maxima and sums over them run along whole stretches of memory
        logits = np.matmul(w["wc"].T, states, out=self._room("logits", CLASSES + 2, len(cls)))
        logits += w["bc"][:, None]
        logits -= logits.max(0)
        out = logits[cls, np.arange(len(cls))]
        out -= np.log(np.exp(logits, out=logits).sum(0))
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        n = int(cuts[-1])
        inner = self._room("inner", MEMBERS, n)
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[c], cuts[c + 1])
            np.add(w["wo"][c].T @ states[:, own], w["bo"][c][:, None], out=inner[:, own])
        inner -= inner.max(0)
        out[:n] += inner[target[:n] % MEMBERS, np.arange(n)]
        out[:n] -= np.log(np.exp(inner, out=inner).sum(0))
        back = np.empty_like(out)
        back[order] = out
        return back

    def gradient(self, previous: np.ndarray, fresh: np.ndarray, target: np.ndarray, use: np.ndarray, h: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """Backpropagation through one window; returns gradients of the mean loss, the loss and the last state."""
        w, s, head = self.w, STATE, CLASSES * MEMBERS
        steps, lanes = previous.shape
        kept: list = []
        states = self.forward(previous, fresh, h, kept)
        t, scale = target.reshape(-1), use.reshape(-1).astype(np.float32) / max(1, int(use.sum()))
        cls = np.where(t < head, t // MEMBERS, t - head + CLASSES).astype(np.uint8)
        order = np.argsort(cls, kind="stable")  # by class, so that a class is a stretch of rows
        flat, t, scale, cls = np.take(states.reshape(-1, s).T, order, axis=1), t[order], scale[order], cls[order]
        rows = np.arange(len(t))
        p = np.matmul(w["wc"].T, flat, out=self._room("logits", CLASSES + 2, len(t)))
        p += w["bc"][:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        loss = -(np.log(p[cls, rows] + 1e-30) * scale).sum()
        p[cls, rows] -= 1
        p *= scale
        g = {k: np.zeros(shape, dtype=np.float32) for k, shape in self.SHAPES.items()}
        g["wc"], g["bc"] = flat @ p.T, p.sum(1)
        sorted_back = w["wc"] @ p
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        classes, n = np.flatnonzero(np.diff(cuts)).tolist(), int(cuts[-1])
        q = self._room("inner", MEMBERS, n)
        for c in classes:
            own = slice(cuts[c], cuts[c + 1])
            np.add(w["wo"][c].T @ flat[:, own], w["bo"][c][:, None], out=q[:, own])
        q -= q.max(0)
        np.exp(q, out=q)
        q /= q.sum(0)
        at = (t[:n] % MEMBERS, rows[:n])
        loss -= (np.log(q[at] + 1e-30) * scale[:n]).sum()
        q[at] -= 1
        q *= scale[:n]
        for c in classes:
            own = slice(cuts[c], cuts[c + 1])
            g["wo"][c], g["bo"][c] = flat[:, own] @ q[:, own].T, q[:, own].sum(1)
            sorted_back[:, own] += w["wo"][c] @ q[:, own]
        place = np.empty_like(order)
        place[order] = rows
        back = np.take(sorted_back, place, axis=1).reshape(s, steps, lanes)
        turns, last = self._room("inputs", 3 * s, steps, lanes), self._room("last", s, steps, lanes)
        befores = self._room("befores", s, steps, lanes)
        carry = np.zeros((s, lanes), dtype=np.float32)
        for step in range(steps - 1, -1, -1):
            before, gates, n, rn = kept[step]
            r, z = gates[:s], gates[s:]
            d = back[:, step] + carry
            dn = d * (1 - z) * (1 - n * n)
            turn = turns[:, step]
            turn[s : 2 * s] = d * (before - n) * z * (1 - z)
            turn[:s] = dn * rn * r * (1 - r)
            np.multiply(dn, r, out=turn[2 * s :])
            last[:, step], befores[:, step] = dn, before
            carry = d * z + w["u"] @ turn
            carry *= ~fresh[step]
        g["u"] = befores.reshape(s, -1) @ turns.reshape(3 * s, -1).T
        source = previous.reshape(-1)
        for k, values in enumerate([*turns[: 2 * s], *last]):
            g["b"][k] = values.sum()
            g["e"][:, k] = np.bincount(source, weights=values.reshape(-1), minlength=len(g["e"]))
        return g, float(loss), states[-1].copy()

    def train(self, data: Streams, rate: float = 0.01, passes: int = 1, moments: list | None = None) -> float:
        """Adam steps, one per window; returns the mean loss of the last pass. ``moments`` (empty at first) carries them to the next call."""
        moments = [] if moments is None else moments
        if not moments:
            moments += [0, *({k: np.zeros(s, dtype=np.float32) for k, s in self.SHAPES.items()} for _ in range(2))]
        step, m, v = moments
        total, tokens = 0.0, 1
        for _ in range(passes):
            total, tokens = 0.0, 0
            h = np.zeros((data.token.shape[1], STATE), dtype=np.float32)
            for at, previous, fresh, target, _doc, active in windows(data):
                use = np.arange(at, at + len(target))[:, None] < data.length[:active]
                g, loss, last = self.gradient(previous, fresh, target, use, h[:active])
                h[:active] = last
                size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                clip, step = min(1.0, 1.0 / max(size, 1e-9)), step + 1
                for k in g:
                    d = g[k] * np.float32(clip)
                    m[k] += np.float32(0.1) * (d - m[k])
                    v[k] += np.float32(0.01) * (d * d - v[k])
                    self.w[k] = self.w[k] - np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k]) + np.float32(1e-8))
                total, tokens = total + loss * int(use.sum()), tokens + int(use.sum())
        moments[0] = step
        return total / max(1, tokens)


def windows(data: Streams, size: int = WINDOW):
    """(start, previous tokens, document starts, targets, documents, active lanes) of each window; finished lanes drop out."""
    start = CLASSES * MEMBERS + 2
    shifted = np.full_like(data.token, start)
    shifted[1:] = data.token[:-1]
    shifted[data.fresh] = start
    for at in range(0, len(data.token), size):
        active = int((data.length > at).sum())
        part = (slice(at, at + size), slice(0, active))
        yield at, shifted[part], data.fresh[part], data.token[part], data.doc[part], active


class Vocabulary(NamedTuple):
    """The most frequent tokens with their counts, by hash; ``number`` is the network's token number of each."""

    hashes: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    train_tokens: int
    types: int

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, train_tokens: int, types: int) -> Vocabulary:
        """From tokens sorted by falling count."""
        head = CLASSES * MEMBERS
        number = np.minimum(np.arange(len(hashes)), head).astype(np.int32)
        order = np.argsort(hashes)
        return cls(hashes[order], counts[order], number[order], train_tokens, types)

    @property
    def outer(self) -> tuple[float, float]:
        """Smoothed mass of the known words outside the head, and of all other words."""
        head = self.number < CLASSES * MEMBERS
        near = float((self.counts[~head] + 0.5).sum())
        return near, self.train_tokens + 0.5 * (self.types + 1) - float((self.counts[head] + 0.5).sum()) - near

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for tokens not sent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        # hashes are random, so their first bits lead close to their place; the few that stand further on are moved up
        shift = np.uint64(64 - _LEAD_BITS)
        first = np.searchsorted(self.hashes, np.arange(1 << _LEAD_BITS, dtype=np.uint64) << shift)
        known = np.append(self.hashes, np.uint64(2**64 - 1))
        at = first[hashes >> shift]
        behind = np.flatnonzero(known[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[known[at[behind]] < hashes[behind]]
        at[known[at] != hashes] = -1
        at[at == len(self.hashes)] = -1
        return at


def _documents(column: pa.Array):
    """(lo, hi, first, hashes) of runs of rows, each row's words followed by the end token."""
    for run in words.runs(column, size=_RUN):
        n = np.diff(run.first) + 1
        first = np.concatenate([[0], np.cumsum(n)])
        hashes = np.full(first[-1], END, dtype=np.uint64)
        hashes[np.arange(len(run.hashes)) + run.row] = run.hashes
        yield run.lo, run.hi, first, hashes


def _gathered(batches):
    """(ids, first, hashes) of the documents of several Arrow batches at a time; ``ids`` is null without a doc_id column."""
    ids, sizes, held, n = [], [], [], 0

    def out():
        return pa.concat_arrays(ids) if ids else None, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(held)

    for b in batches:
        for lo, hi, first, hashes in _documents(b["text"]):
            if "doc_id" in b.schema.names:
                ids.append(b["doc_id"].slice(lo, hi - lo))
            sizes.append(np.diff(first))
            held.append(hashes)
            n += len(hashes)
            if n >= DEALT_TOKENS:
                yield out()
                ids, sizes, held, n = [], [], [], 0
    if n:
        yield out()


def _by_hash(rows: np.ndarray) -> np.ndarray:
    """Sorted by the plain column: numpy compares whole records field by field, many times slower."""
    return rows[np.argsort(np.ascontiguousarray(rows["hash"]))]


def count(docs: DataFrame, buckets: int) -> DataFrame:
    """(hash, count) of every token of the training rows (``train`` true)."""

    def deal(it):
        for b in it:
            b = b.filter(b["train"])
            for _, _, _, hashes in _documents(b["text"]):
                found, n = np.unique(hashes, return_counts=True)
                out = np.zeros(len(found), dtype=_COUNT)
                out["hash"], out["count"] = found, n
                yield blocks.pack("count", found % np.uint64(buckets), out)

    def each(t: pa.Table):
        x = _by_hash(blocks.unpack(t, "count", _COUNT))
        at = np.flatnonzero(first_of(x["hash"]))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x["hash"][at].view(np.int64)), pa.array(np.add.reduceat(x["count"], at))], ["hash", "count"])

    return blocks.meet(docs.mapInArrow(deal, blocks.BLOCK), buckets, each, "hash long, count long")


def train(docs: DataFrame, vocabulary: Vocabulary) -> tuple[Network, int]:
    """The network after one pass over all training documents, and the number of tokens it has read.

    The documents are read where they lie, in rounds, each in parallel on its part of them; the weights are averaged after
    each round. Adam's moments last as long as the task.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS))
    network, read = Network.new(), 0
    for step in range(ROUNDS):
        sent = spark.sparkContext.broadcast((network.flat(), vocabulary))

        def fit(it, sent=sent, step=step):
            weights, vocabulary = sent.value
            own, tokens, moments = Network.unflat(weights), 0, []
            for _, first, hashes in _gathered(it):
                at = vocabulary.find(hashes)
                token = np.where(at >= 0, vocabulary.number[at] if len(vocabulary.number) else 0, CLASSES * MEMBERS + 1).astype(np.int32)
                long = [np.arange(first[i], first[i + 1], TRAIN_SPAN) for i in np.flatnonzero(np.diff(first) > TRAIN_SPAN)]
                own.train(streams(token, np.unique(np.concatenate([first, *long]))), rate=0.01 / (1 + 2 * step), moments=moments)
                tokens += len(token)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([own.flat().tolist()], pa.list_(pa.float64()))], ["tokens", "weights"])

        def add(it):
            total, sums = 0.0, None
            for b in it:
                for n, w in zip(b["tokens"].to_pylist(), b["weights"]):
                    part = w.values.to_numpy() * n
                    total, sums = total + n, part if sums is None else sums + part
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums / total], pa.list_(pa.float64()))], ["tokens", "weights"])

        kind = "tokens double, weights array<double>"
        found = docs.where(F.col("train") & (part == step)).select("text").mapInArrow(fit, kind).repartition(8).mapInArrow(add, kind).collect()  # 8 rows at most
        if found:
            network = Network.unflat(np.average([r["weights"] for r in found], axis=0, weights=[r["tokens"] for r in found]))
            read += int(sum(r["tokens"] for r in found))
    return network, read


def _score_run(network: Network, vocabulary: Vocabulary, first: np.ndarray, hashes: np.ndarray) -> tuple[dict, np.ndarray]:
    """Sums per document over known tokens and all classes, and (hash, document, n) of the tokens not sent."""
    head, rows = CLASSES * MEMBERS, len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    at = vocabulary.find(hashes)
    sent = at >= 0
    token = np.full(len(at), head + 1, dtype=np.int32)
    token[sent] = vocabulary.number[at[sent]]
    weight = np.zeros(len(at))
    weight[sent] = np.log10(vocabulary.counts[at[sent]] + 0.5)
    near, far = vocabulary.outer
    total = lambda x: np.bincount(row, weights=x, minlength=rows)
    outer = token == head
    # natural logs of the network's part, by document
    data = streams(token, first)
    model, h = np.zeros(rows), np.zeros((data.token.shape[1], STATE), dtype=np.float32)
    for start, previous, fresh, target, doc, active in windows(data):
        states = network.forward(previous, fresh, h[:active])
        h[:active] = states[-1]
        use = doc.reshape(-1) >= 0
        model += np.bincount(doc.reshape(-1)[use], weights=network.log_probability(states.reshape(-1, STATE), target.reshape(-1))[use], minlength=rows)
    sums = {
        "n_tokens": np.diff(first), "n_sent": total(sent).astype(np.int64), "base": total(weight),
        "model": model / np.log(10) + total(np.where(outer, weight - np.log10(max(near, 1e-300)), 0.0)) - total(~sent) * np.log10(max(far, 1e-300)),
    }
    order = np.lexsort((hashes[~sent], row[~sent]))
    rest, owner = hashes[~sent][order], row[~sent][order]
    cuts = np.flatnonzero(first_of(rest, owner))
    tail = np.zeros(len(cuts), dtype=_TAIL)
    tail["hash"], tail["doc"], tail["n"] = rest[cuts], owner[cuts], np.diff(np.append(cuts, len(rest)))
    return sums, tail


_SCORED = f"{blocks.BLOCK}, place long, doc_id long, n_tokens long, n_sent long, base double, model double"


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token; null texts are empty. Learns from rows
    that are not ``held_out``; a null doc_id is not. ``base_score`` is the unigram score with half a count added to each of V
    types and one unknown, ``score`` the network's; both are log10 and cover the whole text. Repeated rows are learned from
    and scored each; other columns are ignored; without rows there is no result.
    """
    spark = docs.sparkSession
    blocks.bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~held_out(F.col("doc_id"))).alias("train"))
    n_docs = rows.count()
    buckets = max(8, n_docs // _BUCKET_DOCS)
    counts = materialise(count(rows, buckets), "token-counts")
    train_tokens, types = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("count"), "hash").limit(KNOWN).toArrow()  # KNOWN rows at most
    vocabulary = Vocabulary.of(top["hash"].to_numpy().view(np.uint64), top["count"].to_numpy(), train_tokens, types)
    sent = spark.sparkContext.broadcast((train(rows, vocabulary)[0].flat(), vocabulary))

    def read(it):
        weights, vocabulary = sent.value
        network, task, seen = Network.unflat(weights), TaskContext.get().partitionId(), 0
        for ids, first, hashes in _gathered(it):
            sums, tail = _score_run(network, vocabulary, first, hashes)
            place = (task << 40) + seen + np.arange(len(ids))
            seen += len(ids)
            tail["doc"] = place[tail["doc"]]
            nothing = [pa.nulls(len(ids), k) for k in (pa.int32(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(place), ids, *[pa.array(sums[k]) for k in ("n_tokens", "n_sent", "base", "model")]], names)
            block = blocks.pack("tail", tail["hash"] % np.uint64(buckets), tail)
            yield pa.RecordBatch.from_arrays([*block.columns, *[pa.nulls(len(block), k) for k in (pa.int64(),) * 4 + (pa.float64(),) * 2]], names)

    def again(it):
        for b in it:
            out = np.zeros(len(b), dtype=_COUNT)
            out["hash"], out["count"] = b["hash"].to_numpy().view(np.uint64), b["count"].to_numpy()
            yield blocks.pack("count", out["hash"] % np.uint64(buckets), out)

    def each(t: pa.Table):
        """Per document the sum over its tokens of this bucket, and how many of them have a count; dealt on by document."""
        counts = _by_hash(blocks.unpack(t, "count", _COUNT))
        tail = blocks.unpack(t, "tail", _TAIL)
        n = np.zeros(len(tail), dtype=np.int64)
        if len(counts):
            at = np.minimum(np.searchsorted(counts["hash"], tail["hash"]), len(counts) - 1)
            n = np.where(counts["hash"][at] == tail["hash"], counts["count"][at], 0)
        order = np.argsort(tail["doc"], kind="stable")
        doc, times, n = tail["doc"][order], tail["n"][order].astype(np.int64), n[order]
        at = np.flatnonzero(first_of(doc))
        out = np.zeros(len(at), dtype=_SUM)
        if len(at):
            out["doc"], out["far"], out["known"] = doc[at], np.add.reduceat(times * np.log10(n + 0.5), at), np.add.reduceat(times * (n > 0), at)
        yield blocks.pack("sum", out["doc"] % buckets, out)

    def added(t: pa.Table):
        x = blocks.unpack(t, "sum", _SUM)
        x = x[np.argsort(x["doc"], kind="stable")]
        at = np.flatnonzero(first_of(x["doc"]))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"][at]), pa.array(np.add.reduceat(x["far"], at)), pa.array(np.add.reduceat(x["known"], at))], ["place", "far", "known"])

    names = [x.split()[0] for x in _SCORED.split(", ")]
    scored = materialise(rows.select("doc_id", "text").mapInArrow(read, _SCORED), "scored")
    dealt = scored.where("bucket is not null").select("bucket", "kind", "data").unionByName(counts.mapInArrow(again, blocks.BLOCK))
    far = blocks.meet(blocks.meet(dealt, buckets, each, blocks.BLOCK), buckets, added, "place long, far double, known long")
    both = scored.where("bucket is null").join(far, "place", "left")
    far, known = F.coalesce("far", F.lit(0.0)), F.coalesce("known", F.lit(0))
    mass = F.log10(F.lit(train_tokens + 0.5 * (types + 1)))
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_sent") + known).cast("long").alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + far - F.col("n_tokens") * mass).alias("base_score"), (F.col("model") + far).alias("score"))
