"""A corpus as a few large rows, and messages between them by hashed key.

``pack`` turns documents into chunks of some megabytes of text, each one row of
a written table.  Operators that need to know something about the whole corpus
(which n-grams occur elsewhere, how often a word occurs) send the *distinct*
keys of a chunk to buckets of the key space and get an answer per key back.
Because keys are distinct within a chunk, a key that fills a third of the
corpus costs one entry a chunk; no bucket receives rows in proportion to how
hot its keys are.  Keys and answers travel as packed arrays, eight bytes a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.storage import durable
from tickforge.llm.words import LOWER, U, hash_words, mix

#: Text bytes of a chunk (a longer document is a chunk of its own).
CHUNK_BYTES = 4 << 20
#: Keys that one bucket holds on average.
BUCKET_KEYS = 1_000_000
#: Stands for a null id: larger than any other.
NULL_ID = np.iinfo(np.int64).max

REQUEST = "bucket int, chunk long, keys binary, vals binary"
REPLY = "chunk long, bucket int, vals binary"


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    extras: dict[str, Column] | None = None, chunk_bytes: int = CHUNK_BYTES, name: str = "chunks", level: int = 6,
) -> DataFrame:
    """Write ``docs`` as chunks: ``chunk, n_docs, n_bytes, ids, ends, body`` and arrays of ``extras``.

    ``body`` is the compressed UTF-8 of the texts, each followed by a newline;
    ``ends`` are the offsets after those newlines.  Null texts are empty texts;
    null ids become ``NULL_ID``.
    """
    extras = extras or {}
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(int(NULL_ID))).alias("id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *(c.alias(k) for k, c in extras.items()),
    )
    kinds = dict(rows.dtypes)
    schema = "chunk long, n_docs int, n_bytes long, ids binary, ends binary, body binary"
    schema += "".join(f", `{k}` array<{kinds[k]}>" for k in extras)
    names = list(extras)

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=level)
        at, count = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [x.encode() for x in table["text"].to_pylist()]
            ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
            body = b"\n".join([*texts, b""])
            cols = [
                pa.array([at + count], pa.int64()), pa.array([len(texts)], pa.int32()), pa.array([len(body)], pa.int64()),
                pa.array([table["id"].to_numpy().tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary()),
                pa.array([squeeze.compress(body)], pa.binary()),
                *(pa.array([table[k].to_pylist()], pa.list_(table.schema.field(k).type)) for k in names),
            ]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "n_docs", "n_bytes", "ids", "ends", "body", *names])

        for batch in batches:
            lengths = pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False) + 1
            first = 0
            for i, n in enumerate(lengths):
                if size + n > chunk_bytes and size:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    yield row()
                    count, held, size, first = count + 1, [], 0, i
                size += int(n)
            if first < len(lengths):
                held.append(batch.slice(first))
        if held:
            yield row()

    return durable(rows.mapInArrow(to_chunks, schema), name)


class Chunk:
    """One row of a packed corpus, unpacked."""

    def __init__(self, row: dict, lower: bool = False):
        self.key = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.raw = zstandard.ZstdDecompressor().decompress(row["body"])
        self.buf = np.frombuffer(self.raw, np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        self.row = row

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, hash and document index of every word."""
        start, end, hashes = hash_words(self.buf)
        return start, end, hashes, np.searchsorted(self.ends, start, side="right")


def unpack(batches: Iterator[pa.RecordBatch], lower: bool = False) -> Iterator[Chunk]:
    """The chunks of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0], lower)


def buckets_for(chunks: DataFrame, keys_per_byte: float, least: int = 1) -> int:
    """How many buckets hold ``keys_per_byte`` keys of all text, about BUCKET_KEYS each."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(least, math.ceil(total * keys_per_byte / BUCKET_KEYS))


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts distinct sorted keys by bucket, and the ``n + 1`` bounds of the buckets in it."""
    bucket = (mix(keys) % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys that lie close together, as compressed differences."""
    step = np.diff(keys, prepend=U(0))
    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def open_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def requests(key: int, keys: np.ndarray, vals: np.ndarray | None, n: int, dense: bool = False) -> pa.RecordBatch:
    """Rows of REQUEST for one chunk: only buckets that get a key; with ``dense``, keys and values are compressed."""
    order, bounds = by_bucket(keys, n)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    keys, vals = keys[order], None if vals is None else vals[order]
    cut = [slice(bounds[b], bounds[b + 1]) for b in some]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some, pa.int32()), pa.array(np.full(len(some), key, np.int64)),
            pa.array([squeeze_keys(keys[c]) if dense else keys[c].tobytes() for c in cut], pa.binary()),
            pa.array([None if vals is None else zstandard.compress(vals[c].tobytes()) if dense else vals[c].tobytes() for c in cut], pa.binary()),
        ],
        ["bucket", "chunk", "keys", "vals"],
    )


def answer(reqs: DataFrame, fn: Callable, val: type | np.dtype | None, name: str | None = None) -> DataFrame:
    """Answer requests by bucket: ``fn(keys, vals, part)`` returns one value for each key.

    ``keys`` joins the keys of all chunks, ``part`` tells which chunk each came from.
    """

    def one(table: pa.Table) -> pa.Table:
        blobs = table["keys"].to_pylist()
        sizes = np.array([len(b) // 8 for b in blobs])
        keys = np.frombuffer(b"".join(blobs), np.uint64)
        vals = None if val is None else np.frombuffer(b"".join(table["vals"].to_pylist()), val)
        out = fn(keys, vals, np.repeat(np.arange(len(sizes)), sizes))
        ends = np.cumsum(sizes)
        replies = [out[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "vals": pa.array(replies, pa.binary())})

    out = reqs.groupBy("bucket").applyInArrow(one, REPLY)
    return durable(out, name) if name else out


def replies(table: pa.Table, kind: type | np.dtype, keys: np.ndarray, n: int) -> np.ndarray:
    """The answers to a chunk, in the order of its distinct sorted keys."""
    order, _ = by_bucket(keys, n)
    out = np.empty(len(keys), kind)
    rows = sorted(zip(table["bucket"].to_pylist(), table["vals"].to_pylist(), strict=True))
    out[order] = np.frombuffer(b"".join(v for _, v in rows), kind)
    return out


def gather(chunks: DataFrame, reply: DataFrame, fn: Callable[[Chunk, pa.Table], pa.Table], schema: str, lower: bool = False) -> DataFrame:
    """Bring each chunk together with its replies (none: an empty table)."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(Chunk(left.to_pylist()[0], lower), right)

    return chunks.groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(one, schema)


def id_array(ids: np.ndarray) -> pa.Array:
    """Ids as Arrow, ``NULL_ID`` as null again."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)
