"""Substring deduplication over prefix-partitioned suffix trees.

A *window* is ``min_words`` consecutive words of one document.  Words covered by
a window whose word sequence also starts in a document with a smaller id are
removed; windows are judged on the input.

Suffixes are anchored: the anchor of a window is the smallest (by hash) of its
short word prefixes, so equal windows have equal anchors at equal offsets and
about one suffix in five needs a place of its own.

1. Each chunk sends its distinct anchors to buckets, which answer whether an
   anchor occurs in two documents at all, and whether it is frequent.  Under
   frequent anchors the prefix is lengthened, and the longer ones are asked for in
   the same way, until a prefix is rare enough for one group or is the window
   itself (whose group is one entry a chunk).
2. Windows under a shared prefix form the candidate suffixes.  They are
   partitioned by that prefix of variable length.  Equal pieces of a chunk travel
   once, with their smallest document id.
3. Each partition builds its subtrees from the words themselves: a suffix array by
   prefix doubling and the words that neighbours share.  A run of suffixes that
   share ``min_words`` words and more is a deep internal node; its repeat is
   maximal in depth where the run branches, and all its suffixes learn the smallest
   document of the run.
4. Back in the chunk, every window learns the smallest document below its node.
   Maximal repeats longer than a piece come together there, from the overlapping
   windows of neighbouring pieces (``removed_spans``).

Null and empty texts have no words and keep an empty text; a null id counts as
larger than any other; rows that share an id are one document for the test
"smaller id", each judged by itself; extra columns are ignored unless named in
``keep``.  No text is cut, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm import chunks as C
from tickforge.llm.storage import durable
from tickforge.llm.words import U, fold, hash_words, mix, runs

#: Prefix lengths, in words, of the anchored suffixes; beyond the last, the window itself.
PREFIXES = (5, 9)
#: Occurrences from which the suffixes under a prefix are more than one group may hold, and the prefix is lengthened.
FREQUENT = 4096

#: The level of replies about pieces.
_NODES = -1

PIECES = "bucket int, chunk long, keys binary, windows binary, docs binary, body binary"


def _anchors(hashes: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams, and for each window the position of its smallest (the first of equal ones)."""
    grams = fold(hashes, k)
    n, span = len(hashes) - width + 1, width - k + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        at[less] = j
    return grams, at + np.arange(n)


class _Windows:
    """The windows of a chunk, and the prefix that each has so far."""

    def __init__(self, chunk: C.Chunk, width: int):
        self.chunk, self.width = chunk, width
        self.start, self.end, self.hash, self.doc = chunk.words()
        n = max(0, len(self.hash) - width + 1)
        self.ok = np.flatnonzero(self.doc[:n] == self.doc[width - 1 : width - 1 + n])
        self.level = np.zeros(len(self.ok), np.int8)  # which prefix; -1: unshared
        self.at, self.key = np.zeros(len(self.ok), np.int64), np.zeros(len(self.ok), U)
        self._anchor(0, np.arange(len(self.ok)))

    def _anchor(self, level: int, which: np.ndarray) -> None:
        """Give windows the prefix of a level."""
        if not len(which):
            return
        if level < len(PREFIXES):
            grams, at = _anchors(self.hash, self.width, PREFIXES[level])
        else:
            grams = fold(self.hash, self.width)
            at = np.arange(len(grams))
        self.at[which] = at[self.ok[which]]
        self.key[which] = mix(grams[self.at[which]] + U(level))
        self.level[which] = level

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct prefixes of a level, their occurrences, doubled, plus 1 if two documents of the chunk have it; and the windows' prefixes."""
        which = np.flatnonzero(self.level == level)
        place, first = np.unique(self.at[which], return_index=True)
        keys, inverse = np.unique(self.key[which[first]], return_inverse=True)
        ids = self.chunk.ids[self.doc[place]]
        order = np.lexsort((ids, inverse))
        at, size = runs(inverse[order])
        several = ids[order][at] < ids[order][at + size - 1] if len(at) else np.zeros(0, bool)
        return keys, (size * 2 + several).astype(np.uint32), which

    def answered(self, level: int, table: pa.Table, n: int) -> None:
        """Drop the windows with unshared prefixes, lengthen frequent prefixes."""
        keys, _, which = self.asked(level)
        if not len(keys):
            return
        kind = C.replies(table, np.uint8, keys, n)[np.searchsorted(keys, self.key[which])]
        self.level[which[kind == 0]] = -1
        self._anchor(level + 1, which[kind == 2])

    def pieces(self) -> dict[str, np.ndarray]:
        """Runs of candidate windows with one prefix."""
        sel = np.flatnonzero(self.level >= 0)
        window, at, level = self.ok[sel], self.at[sel], self.level[sel]
        key = self.key[sel]
        fresh = np.ones(len(window), bool)
        fresh[1:] = (window[1:] != window[:-1] + 1) | (at[1:] != at[:-1]) | (level[1:] != level[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.concatenate((first, [len(window)])))
        path = fold(self.hash, self.width)[window] if len(window) else np.zeros(0, U)
        last = first + size - 1
        digest = mix(path[first] + mix(path[last] + size.astype(U)))
        ids = self.chunk.ids[self.doc[window[first]]]
        order = np.lexsort((ids, digest))
        starts, counts = runs(digest[order])
        own = np.empty(len(order), np.int64)
        own[order] = np.repeat(np.arange(len(starts)), counts)
        one = order[starts]
        return {"window": window, "size": size, "own": own, "first": first, "one": one, "key": key[first[one]], "doc": ids[one]}


def _ask(width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.unpack(batches):
            keys, counts, _ = _Windows(chunk, width).asked(0)
            if len(keys):
                yield C.requests(chunk.key, keys, counts, n)

    return run


def _level(table: pa.Table, level: int) -> pa.Table:
    """The replies about the prefixes of a level."""
    return table.filter(pc.equal(table["level"], level)) if "level" in table.column_names else table


def _ask_longer(width: int, n: int, level: int):
    """Ask for the longer prefixes of windows whose prefix of the level before is frequent."""

    def run(chunk: C.Chunk, table: pa.Table) -> pa.Table:
        w = _Windows(chunk, width)
        for k in range(level):
            w.answered(k, _level(table, k), n)
        keys, counts, _ = w.asked(level)
        return pa.Table.from_batches([C.requests(chunk.key, keys, counts, n)])

    return run


def _some_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = any(np.frombuffer(x, np.uint8).max(initial=0) == 2 for batch in batches for x in batch["vals"].to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([some])], ["some"])


def _shared(keys: np.ndarray, vals: np.ndarray, part: np.ndarray) -> np.ndarray:
    _, inverse = np.unique(keys, return_inverse=True)
    count = np.bincount(inverse)
    several = np.bincount(inverse, weights=vals & 1) > 0
    often = np.bincount(inverse, weights=vals >> 1) > FREQUENT
    return np.where((count > 1) | several, 1 + often, 0).astype(np.uint8)[inverse]


def _send(width: int, n: int, n_pieces: int):
    def run(chunk: C.Chunk, table: pa.Table) -> pa.Table:
        w = _Windows(chunk, width)
        for k in range(len(PREFIXES)):
            w.answered(k, _level(table, k), n)
        p = w.pieces()
        squeeze = zstandard.ZstdCompressor(level=6)
        bucket = (p["key"] % U(n_pieces)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = []
        for at, size in zip(*runs(bucket[order]), strict=True):
            here = order[at : at + size]
            one = p["one"][here]
            m = p["size"][one]
            lo = p["window"][p["first"][one]]
            hi = lo + m + width - 2
            body = b"\n".join([chunk.raw[a:b] for a, b in zip(w.start[lo], w.end[hi], strict=True)])
            out.append((int(bucket[here[0]]), chunk.key, p["key"][here].tobytes(), squeeze.compress(m.astype(np.uint8).tobytes()), squeeze.compress(p["doc"][here].tobytes()), squeeze.compress(body)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(["bucket", "chunk", "keys", "windows", "docs", "body"], cols, kinds, strict=True)})

    return run


def suffix_array(hashes: np.ndarray, left: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in order (as indices of ``starts``), and how many words each shares with the one before.

    ``left`` tells for every position how many words its piece has from there;
    suffixes end with their piece.  Ranks by 1, 2, 4, ... words come from prefix
    doubling; shared words are found by descending through them.
    """
    longest = int(left.max(initial=0))
    ranks = [np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1]
    length = 1
    while length < longest:
        before = ranks[-1]
        ahead = np.zeros_like(before)
        ahead[: len(before) - length] = before[length:]
        ahead[left <= length] = 0
        ranks.append(np.unique(before * (int(before.max(initial=0)) + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1)
        length *= 2
    order = np.argsort(ranks[-1][starts], kind="stable")
    here = starts[order]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = here[:-1].copy(), here[1:].copy()
        most = np.minimum(left[a], left[b])
        same = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            go = same + (1 << k) <= most
            x, y = np.minimum(a + same, len(left) - 1), np.minimum(b + same, len(left) - 1)
            same += np.where(go & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
        shared[1:] = same
    return order, shared


def deep_nodes(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of suffixes that share ``depth`` words: the topmost nodes that are so deep (single suffixes: leaves)."""
    first = np.flatnonzero(shared < depth)
    return first, np.diff(np.concatenate((first, [len(shared)])))


def _trees(width: int):
    def run(table: pa.Table) -> pa.Table:
        squeeze, open_ = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        sizes = [np.frombuffer(open_.decompress(x), np.uint8).astype(np.int64) for x in table["windows"].to_pylist()]
        windows = np.concatenate(sizes)
        docs = np.frombuffer(b"".join(open_.decompress(x) for x in table["docs"].to_pylist()), np.int64)
        body = np.frombuffer(b"\n".join(open_.decompress(x) for x in table["body"].to_pylist()), np.uint8)
        hashes = hash_words(body)[2]
        words = windows + width - 1
        first = np.cumsum(words) - words
        left = np.repeat(first + words, words) - np.arange(len(hashes))
        starts = np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        order, shared = suffix_array(hashes, left, starts)
        least = np.empty(len(starts), np.int64)
        if len(starts):
            at, count = deep_nodes(shared, width)
            least[order] = np.repeat(np.minimum.reduceat(np.repeat(docs, windows)[order], at), count)
        ends = np.cumsum([int(x.sum()) for x in sizes])
        out = [squeeze.compress(least[e - int(x.sum()) : e].tobytes()) for x, e in zip(sizes, ends, strict=True)]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "vals": pa.array(out, pa.binary())})

    return run


def _covered(w: _Windows, p: dict[str, np.ndarray], table: pa.Table, n_pieces: int) -> np.ndarray:
    """Which words of the chunk a window with a smaller document covers."""
    open_ = zstandard.ZstdDecompressor()
    rows = sorted(zip(table["bucket"].to_pylist(), table["vals"].to_pylist(), strict=True))
    least = np.frombuffer(b"".join(open_.decompress(v) for _, v in rows), np.int64)
    order = np.argsort((p["key"] % U(n_pieces)).astype(np.int64), kind="stable")
    m = p["size"][p["one"]][order]
    base = np.empty(len(order), np.int64)
    base[order] = np.cumsum(m) - m
    nth = np.arange(len(p["window"])) - np.repeat(p["first"], p["size"])
    seen = least[np.repeat(base[p["own"]], p["size"]) + nth] if len(nth) else np.zeros(0, np.int64)
    hit = p["window"][seen < w.chunk.ids[w.doc[p["window"]]]]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + w.width, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_text(chunk: C.Chunk, start: np.ndarray, end: np.ndarray, doc: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    edge = np.zeros(len(chunk.buf) + 2, np.int8)
    edge[start[keep]] += 1
    edge[end[keep] + 1] -= 1
    inside = np.cumsum(edge[: len(chunk.buf)], dtype=np.int8).astype(bool)
    flat = chunk.buf.copy()
    flat[end[keep]] = 0x20
    size = np.bincount(doc[keep], weights=(end - start)[keep] + 1, minlength=len(chunk.ids)).astype(np.int64)
    stop = np.cumsum(size)
    data = flat[inside].tobytes()
    return pa.array([data[a : max(a, b - 1)].decode() for a, b in zip(stop - size, stop, strict=True)], pa.string())


def _finish(width: int, n: int, n_pieces: int, keep: list[str], kinds: list[pa.DataType]):
    def run(chunk: C.Chunk, table: pa.Table) -> pa.Table:
        w = _Windows(chunk, width)
        for k in range(len(PREFIXES)):
            w.answered(k, _level(table, k), n)
        gone = np.zeros(len(w.hash), bool)
        if (w.level >= 0).any():
            gone = _covered(w, w.pieces(), _level(table, _NODES), n_pieces)
        d = len(chunk.ids)
        words = np.bincount(w.doc, minlength=d)
        removed = np.bincount(w.doc[gone], minlength=d)
        at = np.flatnonzero(gone)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
        first = np.flatnonzero(fresh)
        base = np.cumsum(words) - words
        spans = pa.StructArray.from_arrays(
            [pa.array(at[first] - base[w.doc[at[first]]], pa.int64()), pa.array(np.diff(np.concatenate((first, [len(at)]))), pa.int64())], ["start", "n"]
        )
        offsets = np.concatenate(([0], np.cumsum(np.bincount(w.doc[at[first]], minlength=d)))).astype(np.int32)
        out = {
            "doc_id": C.id_array(chunk.ids), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_text": kept_text(chunk, w.start, w.end, w.doc, ~gone), "removed_spans": pa.ListArray.from_arrays(pa.array(offsets), spans),
        }
        return pa.table(out | {k: pa.array(chunk.row[k], t) for k, t in zip(keep, kinds, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text, removed_spans`` and the columns in ``keep``.

    ``removed_spans`` are the covered words as maximal runs (first word, number of words).
    """
    if min_words < max(PREFIXES) or min_words > 255:
        raise ValueError(f"min_words must be {max(PREFIXES)} to 255")
    from pyspark.sql.pandas.types import to_arrow_type

    extras = {f"keep_{i}": docs[k] for i, k in enumerate(keep)}
    packed = C.pack(docs, id_col, text_col, extras, name="substring-chunks")
    types = [docs.schema[k].dataType for k in keep]
    n = C.buckets_for(packed, 0.04)
    n_pieces = C.buckets_for(packed, 0.04)
    asked = packed.mapInArrow(_ask(min_words, n), C.REQUEST)
    about = C.answer(asked, _shared, np.uint32, "substring-anchors").withColumn("level", F.lit(0))
    for level in range(1, len(PREFIXES)):
        last = about.filter(F.col("level") == level - 1)
        if not last.select("vals").mapInArrow(_some_frequent, "some boolean").agg(F.max("some")).first()[0]:
            break
        asked = C.gather(packed, about, _ask_longer(min_words, n, level), C.REQUEST)
        about = about.unionByName(C.answer(asked, _shared, np.uint32, "substring-anchors").withColumn("level", F.lit(level)))
    pieces = C.gather(packed, about, _send(min_words, n, n_pieces), PIECES)
    nodes = durable(pieces.groupBy("bucket").applyInArrow(_trees(min_words), C.REPLY), "substring-nodes").withColumn("level", F.lit(_NODES))
    schema = "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,n:long>>"
    schema += "".join(f", `{k}` {t.simpleString()}" for k, t in zip(extras, types, strict=True))
    out = C.gather(packed, about.unionByName(nodes), _finish(min_words, n, n_pieces, list(extras), [to_arrow_type(t) for t in types]), schema)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", "removed_spans", *(F.col(a).alias(k) for a, k in zip(extras, keep, strict=True)))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE = {
    "op5_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS s
  FROM d WHERE len(w) >= 13),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT win.doc_id, p + j AS p FROM win JOIN least USING (s), range(0, 13) AS r(j) WHERE m < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
         ELSE coalesce((SELECT string_agg(u.w, ' ' ORDER BY u.i) FROM (SELECT unnest(d.w) AS w, unnest(range(1, len(d.w) + 1)) AS i) u WHERE NOT list_contains(ps, u.i)), '') END AS t
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""
}
