"""Byte-pair encoding over a table of distinct words, and decoding through a join of ids with pieces.

Texts are split into words in blocks of documents. The distinct words of a block travel, packed by hash buckets; the packets
of a bucket meet, where each distinct word is encoded once, and the ids go back to the block, where they are joined to the
words' places by number. A frequent word costs one entry a block, however often it occurs.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.blocks import bound_batches, groups
from claimlens.llm.words import SPACED, hash_ranges, raw, spans

#: Bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Words whose ids are put together at once.
_SLICE = 1 << 19
_IDS = T.ArrayType(T.IntegerType())
_ZSTD = pa.Codec("zstd", compression_level=9)


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text, to be sent to tasks: its size is that of a fixed vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(text)
    made.no_truncation()
    made.no_padding()
    return made


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte plane by byte plane, compressed: the high planes are nearly all zero."""
    return _ZSTD.compress(pa.py_buffer(np.ascontiguousarray(numbers.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)), asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 4 * n, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _words(data: bytes, size: int) -> list[str]:
    return _ZSTD.decompress(data, size, asbytes=True).decode().split("\n")


class _Block:
    """Words of some documents: each Arrow batch is split when it comes and its text let go."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.rows, self.counts, self.words = [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = raw(batch.column("_text"))
        starts, ends = spans(data, offsets, SPACED)
        cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        self.words.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[SPACED[data]])]))
        self.counts.append(np.diff(np.searchsorted(starts, offsets)))
        self.rows.append(batch.column("_row"))
        self.size += len(data)

    def finish(self) -> None:
        """The distinct words of each bucket, frequent ones first; their digest names the block.

        Word i of bucket b has number ``i * buckets + b``, so low numbers are frequent words and packets need no numbers.
        """
        coded = pa.chunked_array(self.words, pa.binary()).dictionary_encode()
        self.words = []
        words = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.binary())  # all chunks share one
        at = np.concatenate([np.empty(0, dtype=np.int32), *(c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks)])
        del coded
        data, cuts = raw(words)
        bucket = (hash_ranges(data, cuts[:-1], cuts[1:]) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((-np.bincount(at, minlength=len(words)), bucket))
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        number = np.empty(len(words), dtype=np.uint32)
        number[order] = (np.arange(len(words)) - first[bucket[order]]) * self.buckets + bucket[order]
        self.places, self.packets, name = number[at], [], hashlib.sha256()
        for b in np.flatnonzero(np.diff(first)).tolist():
            joined = b"\n".join(words.take(pa.array(order[first[b] : first[b + 1]])).to_pylist())
            name.update(b"%d\n%s\0" % (b, joined))
            self.packets.append({"bucket": b, "n": int(first[b + 1] - first[b]), "size": len(joined), "words": _ZSTD.compress(joined, asbytes=True)})
        self.name = name.digest()


_PACKET = pa.struct([("bucket", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("words", pa.binary())])


def _blocks(batches, buckets: int):
    block = _Block(buckets)
    for b in batches:
        block.add(b)
        if block.size >= BLOCK_BYTES:
            block.finish()
            yield block
            block = _Block(buckets)
            pa.default_memory_pool().release_unused()
    if block.rows:
        block.finish()
        yield block


def _encoded(made, words: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype="<u4") for e in made.encode_batch(words, add_special_tokens=False)]


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(row, ids): the other columns of each row as one struct and the ids of its whole text, without special tokens added.

    ``tokenizer`` is the text of a tokenizer file whose splitting drops white space, so that no id depends on what stands
    beyond a blank; special tokens that stand in a text are found as the library finds them. Null and empty texts have no
    ids. A text of any length is encoded whole; repeated rows are kept; an empty table gives no rows. Columns of ``docs``
    may have any names, they stay inside ``row``. ``docs`` is read twice, once for words and once for places; if its rows
    come in another order the second time, the blocks concerned are encoded where they are, with the same result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("int").alias("none"))
    given = docs.select(others.alias("_row"), F.col(text).alias("_text"))
    row = given.schema["_row"].dataType
    sent = spark.sparkContext.broadcast(tokenizer)

    def words_of(batches):
        for block in _blocks(batches, buckets):
            found = pa.array(block.packets, _PACKET)
            yield pa.RecordBatch.from_arrays([pa.array([block.name] * len(found), pa.binary()), *found.flatten()], ["block", "bucket", "n", "size", "words"])

    def ids_of(batches):
        made, bucket, known = _tokenizer(sent.value), None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], {}
                words = _words(r["words"], r["size"])
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, _encoded(made, fresh)))
                found = [known[w] for w in words]
                ids = np.concatenate(found)
                columns = [[r["block"]], [bucket], [len(words)], [_planes(np.array([len(x) for x in found]))], [len(ids)], [_planes(ids)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["block", "bucket", "n", "counts", "size", "ids"])

    def places_of(batches):
        for block in _blocks(batches, buckets):
            rows = pa.concat_arrays(block.rows)
            columns = [pa.array([block.name], pa.binary()), pa.array([-1], pa.int32()), pa.array([len(block.places)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)]
            columns += [pa.array([_planes(np.concatenate(block.counts))]), pa.array([_planes(block.places)]), pa.array([block.packets], pa.list_(_PACKET))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "n", "rows", "counts", "places", "packets"])

    def look_up(packets, found):
        """Start and number of ids by word number, and all ids; words whose packet has not come back are encoded here."""
        size = 1 + max((p["bucket"] + (p["n"] - 1) * buckets for p in packets), default=-1)
        n, start, ids, filled = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), [np.empty(0, dtype=np.int32)], 0
        for p in packets:
            if p["bucket"] in found:
                f = found[p["bucket"]]
                each, part = _unplanes(f["counts"], f["n"]).astype(np.int64), _unplanes(f["ids"], f["size"])
            else:
                own = _encoded(_tokenizer(sent.value), _words(p["words"], p["size"]))
                each, part = np.array([len(x) for x in own]), np.concatenate(own)
            numbers = p["bucket"] + np.arange(p["n"]) * buckets
            n[numbers], start[numbers] = each, filled + np.cumsum(each) - each
            ids.append(part.astype(np.int32))
            filled += len(part)
        return start, n, np.concatenate(ids)

    def put(batches):
        for t in groups(batches, ["block"]):
            bucket = t["bucket"].to_numpy()
            found = {r["bucket"]: r for r in t.filter(pa.array(bucket >= 0)).select(["bucket", "n", "counts", "size", "ids"]).to_pylist()}
            for i in np.flatnonzero(bucket < 0).tolist():  # equal blocks have one name
                one = t.slice(i, 1).combine_chunks()
                head, rows = one.select(["n", "counts", "places", "packets"]).to_pylist()[0], one["rows"].chunk(0).flatten()
                start, n, ids = look_up(head["packets"], found)
                places, words = _unplanes(head["places"], head["n"]), np.concatenate([[0], np.cumsum(_unplanes(head["counts"], len(rows)), dtype=np.int64)])
                lo = 0
                while lo < len(rows):
                    hi = min(len(rows), lo + 4096, max(lo + 1, int(np.searchsorted(words, words[lo] + _SLICE, "right")) - 1))
                    at = places[words[lo] : words[hi]]
                    each = n[at]
                    ends = np.concatenate([[0], np.cumsum(each)])
                    picked = ids[np.repeat(start[at] - ends[:-1], each) + np.arange(ends[-1])]
                    yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends[words[lo : hi + 1] - words[lo]], pa.int32()), pa.array(picked))], ["row", "ids"])
                    lo = hi

    packets = given.mapInArrow(words_of, "block binary, bucket int, n long, size long, words binary")
    encoded = packets.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(ids_of, "block binary, bucket int, n long, counts binary, size long, ids binary")
    packet = T.StructType().add("bucket", "integer").add("n", "long").add("size", "long").add("words", "binary")
    layout = T.StructType().add("block", "binary").add("bucket", "integer").add("n", "long").add("rows", T.ArrayType(row)).add("counts", "binary").add("places", "binary").add("packets", T.ArrayType(packet))
    both = given.mapInArrow(places_of, layout).unionByName(encoded, allowMissingColumns=True)
    schema = T.StructType().add("row", row).add("ids", _IDS)
    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(put, schema)


def pieces(tokenizer: str) -> pa.Array:
    """The vocabulary's pieces by id, special tokens included, null where no piece has an id: a table of fixed size."""
    found = {i: p for p, i in _tokenizer(tokenizer).get_vocab(with_added_tokens=True).items()}
    return pa.array([found.get(i) for i in range(max(found) + 1)], pa.string())


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(row, ids, text): pieces joined to the ids by id and put together with one space between them.

    The pieces are sent to all tasks. This is how a tokenizer without a decoder of its own decodes, special tokens kept. Ids
    that no piece has are left out; no ids give an empty text.
    """
    if _tokenizer(tokenizer).decoder is not None:
        raise ValueError("the tokenizer has a decoder of its own")
    sent = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer))

    def join(batches):
        for b in batches:
            lists = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
            ids = lists.flatten()
            found = sent.value.take(pc.if_else(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(sent.value))), ids, None))
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            if found.null_count:
                cuts = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])[cuts]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found.drop_null()), " ")
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("ids"), joined], ["row", "ids", "text"])

    schema = T.StructType().add("row", encoded.schema["row"].dataType).add("ids", _IDS).add("text", "string")
    return encoded.select("row", "ids").mapInArrow(join, schema)
