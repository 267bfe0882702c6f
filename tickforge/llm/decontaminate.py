"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  A mask is a fixed pattern of word positions that count or do not;
a seed is the hash of the words at the positions that count.  The mask of items
of five words and more ignores its third word; shorter items have masks of three,
two and one words in a row.  Seeds of documents are joined with seeds of the
benchmark.  Each hit names a diagonal (document, item, offset), on which the words
are then compared one by one: the overlap is the stretch with the best score, +1
for an equal word and -2 for another, so substitutions are tolerated.  An item is
found in a document if the overlap has at least ``min(13, 3/4 of the item's words,
rounded up)`` equal words and three quarters of it are equal.  No such overlap is
missed: every one of 13 words and more, and every one of a shorter item, has a
place where its mask fits (the tests count them out).

The benchmark is a stated query set: it is taken in blocks of at most
``BLOCK_BYTES`` of text (an item longer than that: a block by itself), of which
each is broadcast and compared with all documents.

Null and empty texts are clean, and items without words are never found.  Null
ids come back null; rows that share an id are judged by themselves.  Extra columns
are kept, the added ones win over equally named ones.  Whole texts are compared,
however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.storage import durable
from tickforge.llm.words import LOWER, U, hash_words, mix

#: Word positions that count, and the least and most words of the items that have the mask.
MASKS = (("1101", 5, math.inf), ("111", 3, 4), ("11", 2, 2), ("1", 1, 1))
#: Words that are compared at once.
COMPARED = 1 << 22
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are hashed at once (a longer text: all of it).
BATCH_BYTES = 2 << 20
MOST_NEEDED, SHARE, MISS = 13, 0.75, 2
_BITS = 20

_KEEP = np.full(256, 0x20, np.uint8)
for _range in ((48, 58), (97, 123), (128, 256)):
    _KEEP[slice(*_range)] = np.arange(*_range)
_NORMAL = _KEEP[LOWER]


def normal_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of the text of each."""
    ends = np.cumsum([len(x) + 1 for x in texts])
    start, _, hashes = hash_words(_NORMAL[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)])
    return hashes, np.searchsorted(ends, start, side="right")


def seeds(hashes: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seeds under a mask of all places where it fits into one text, and those places."""
    n = max(0, len(hashes) - len(mask) + 1)
    out = np.full(n, U(int(mask, 2)))
    for j, counts in enumerate(mask):
        if counts == "1":
            out = out * U(0x9E3779B97F4A7C15) + hashes[j : j + n]
    fits = np.flatnonzero(doc[:n] == doc[len(mask) - 1 : len(mask) - 1 + n]) if n else np.zeros(0, np.int64)
    return mix(out[fits]), fits


def overlap(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the best score."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISS))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


class Benchmark:
    """Words and sorted seeds of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.hashes, doc = normal_words([t for _, t in items])
        self.first = np.searchsorted(doc, np.arange(len(items) + 1))
        words = np.diff(self.first)
        self.masks, found = [], []
        for mask, least, most in MASKS:
            keys, place = seeds(self.hashes, doc, mask)
            own = (words[doc[place]] >= least) & (words[doc[place]] <= most)
            if own.any():
                self.masks.append(mask)
            found.append((keys[own], place[own]))
        keys, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        self.keys, self.place, self.item = keys[order], place[order], doc[place[order]] if len(place) else place
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys >> U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (text, item, offset of the item's start in the words) of all seed hits."""
        out = [np.zeros((0, 3), np.int64)]
        for mask in self.masks:
            keys, place = seeds(hashes, doc, mask)
            sel = np.flatnonzero(self.maybe[(keys >> U(64 - _BITS)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.keys, keys[sel], side=s) for s in ("left", "right"))
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            here = np.repeat(place[sel], n)
            out.append(np.stack((doc[here], self.item[at], here - (self.place[at] - self.first[self.item[at]])), axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def likely(self, hits: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The hits whose diagonal has enough equal words, wherever they are."""
        text, item, offset = hits.T
        lo, hi = self.first[item], self.first[item + 1]
        begin, end = np.maximum(offset, first[text]), np.minimum(offset + (hi - lo), first[text + 1])
        need, n = np.minimum(MOST_NEEDED, np.ceil(SHARE * (hi - lo))), end - begin
        keep, cut = np.zeros(len(hits), bool), np.cumsum(n) // COMPARED
        for a, b in zip(*(np.searchsorted(cut, np.unique(cut), side=s) for s in ("left", "right")), strict=True):
            starts = np.cumsum(n[a:b]) - n[a:b]
            step = np.arange(int(n[a:b].sum())) - np.repeat(starts, n[a:b])
            equal = hashes[np.repeat(begin[a:b], n[a:b]) + step] == self.hashes[np.repeat(lo[a:b] + begin[a:b] - offset[a:b], n[a:b]) + step]
            keep[a:b] = np.add.reduceat(equal.astype(np.int64), starts) >= need[a:b]
        return hits[keep]

    def found(self, hashes: np.ndarray, doc: np.ndarray, texts: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, first word in the text, words, equal words) of every overlap that counts."""
        first = np.searchsorted(doc, np.arange(texts + 1))
        for text, item, offset in self.likely(self.hits(hashes, doc), hashes, first).tolist():
            lo, hi = self.first[item], self.first[item + 1]
            begin, end = max(offset, first[text]), min(offset + (hi - lo), first[text + 1])
            equal = hashes[begin:end] == self.hashes[lo + begin - offset : lo + end - offset]
            a, b = overlap(equal)
            n = int(equal[a:b].sum())
            if n >= min(MOST_NEEDED, math.ceil(SHARE * (hi - lo))) and n >= SHARE * (b - a):
                yield text, self.ids[item], int(begin + a - first[text]), b - a, n


FOUND = "doc_id long, row long, item_id long, start long, n_words long, n_equal long"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(ids: list, rows: list, texts: list[bytes]) -> pa.RecordBatch:
            hashes, doc = normal_words(texts)
            best: dict[tuple[int, int], tuple] = {}
            for text, item, start, n, equal in shared.value.found(hashes, doc, len(texts)):
                if equal > best.get((text, item), (0, 0, -1))[2]:
                    best[text, item] = (start, n, equal)
            out = [(ids[t], rows[t], item, *v) for (t, item), v in best.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], [x.split()[0] for x in FOUND.split(", ")])

        held, size = ([], [], []), 0
        for batch in batches:
            for values in zip(batch["id"].to_pylist(), batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                values = (*values[:2], values[2].encode())
                for have, value in zip(held, values, strict=True):
                    have.append(value)
                size += len(values[2])
                if size >= BATCH_BYTES:
                    yield judge(*held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield judge(*held)

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The best overlap of every document row and item found in it: FOUND."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / BLOCK_BYTES))
    out = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Benchmark([(r["item"], r["text"].encode()) for r in own]))
        out.append(durable(rows.mapInArrow(_scan(shared), FOUND), "benchmark-found"))
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """``docs`` with ``contaminated``, ``items`` (ids of the items found) and ``n_equal`` (equal words of the best overlap)."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    found = find_items(docs, benchmark, **names).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("n_equal").alias("n_equal"))
    rows = docs.drop("contaminated", "items", "n_equal").select(F.struct("*").alias("doc"), F.xxhash64(id_col, text_col).alias("row"))
    return rows.join(found, "row", "left").select(
        "doc.*", F.col("n_equal").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("n_equal", F.lit(0).cast("long")).alias("n_equal")
    )


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", (~F.col("contaminated")).alias("kept"), "items", "n_equal")
