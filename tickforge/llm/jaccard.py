"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds its distinct shingles of ``n`` words (A-Z lower-cased;
with fewer words the whole sequence is the one shingle; without words it is
empty).  Two documents link when ``100 * |A & B| >= percent * |A | B|``.

1. Documents with equal sets collapse to the one with the smallest id: first in
   their chunk, which sends one row for each distinct set, then over all chunks.
2. A count sketch of fixed size says roughly how frequent a shingle is.  Each
   global order sorts by that level first and by a hash of its own second, so
   every order puts rare shingles in front.  Any order is valid for a prefix
   filter: two linked sets share one of the first ``|A| - need(|A|) + 1``
   shingles.
3. Under the first order, documents are listed by prefix shingle.  Each list
   names its smallest document the pivot and proposes (pivot, document) only.
   Of proposed pairs, those stay that share a prefix shingle under every other
   order too: the filters are intersected on 32-bit prefix shingles.  Only then
   the texts of the pairs move, and the whole sets are compared.
4. Linked pairs give first components.  Pairs of one list that lie in different
   components are the only ones that could still change anything.  The places of
   the shingle in both, and what each shares with the list's pivot, bound what
   they can share; all pairs that the bounds leave are filtered and verified.
   Components are exact, while a group of copies costs pairs in proportion to
   its size.

Null and empty texts have the empty set and link with nothing.  A null id is
larger than any other and comes back null.  Rows that share an id are one
document for the components.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm import chunks as C
from tickforge.llm.storage import durable
from tickforge.llm.words import U, fold, hash_words, mix, runs

#: Counters of the sketch (2 bytes each while counting, 1 byte as levels): its size never depends on the corpus.
SKETCH = 1 << 24
SLICES = 16
#: Hash seeds of the token orders.
ORDERS = (U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47), U(0xD1342543DE82EF95))


def shingles(hashes: np.ndarray, doc: np.ndarray, n: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document: the hashes, sorted within a document, and each document's count."""
    grams = fold(hashes, n)
    m = len(grams)
    whole = doc[:m] == doc[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
    grams, owner = grams[whole], doc[:m][whole]
    count = np.bincount(doc, minlength=docs)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.cumsum(count) - count
        extra = np.array([fold(hashes[first[i] : first[i] + count[i]], int(count[i]))[0] + U(count[i]) for i in short], U)
        grams, owner = np.concatenate((grams, mix(extra))), np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], np.bincount(owner[fresh], minlength=docs)


def need(size: np.ndarray, percent: int) -> np.ndarray:
    """Fewest shingles that a linked set must share with a set of ``size``."""
    return (percent * size + 99) // 100


def prefixes(grams: np.ndarray, size: np.ndarray, level: np.ndarray, seed: np.uint64, percent: int) -> np.ndarray:
    """Place of every shingle in its set under one order, or -1 beyond the prefix."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((mix(grams ^ seed), level[(grams >> U(40)).astype(np.int64)], owner))
    nth = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
    out = np.empty(len(grams), np.int64)
    out[order] = np.where(nth < np.repeat(size - need(size, percent) + 1, size), nth, -1)
    return out


class _Sets:
    def __init__(self, chunk: C.Chunk, n: int):
        self.chunk = chunk
        self.start, self.end, hashes, self.doc = chunk.words()
        self.grams, self.size = shingles(hashes, self.doc, n, len(chunk.ids))
        self.first = np.cumsum(self.size) - self.size

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        sums = np.concatenate((np.zeros((2, 1), U), np.cumsum(np.stack((mix(self.grams ^ U(1)), mix(self.grams ^ U(2)))), axis=1, dtype=U)), axis=1)
        a, b = sums[:, self.first + self.size] - sums[:, self.first]
        return mix(a + self.size.astype(U)), b


_ROW = np.dtype([("key", "<u8"), ("check", "<u8"), ("id", "<i8"), ("nth", "<i4")])

SETS = "chunk long, ids binary, sizes binary, sets binary, asked array<struct<bucket:int,vals:binary>>"


def collapse(s: _Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sets of a chunk: both digests, the row that stands for each (smallest id, then first), and the set of every row (-1: empty)."""
    key, check = s.digests()
    some = np.flatnonzero(s.size > 0)
    order = some[np.lexsort((s.chunk.ids[some], check[some], key[some]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    of = np.full(len(s.size), -1, np.int32)
    of[order] = np.cumsum(fresh) - 1
    one = order[fresh]
    return key[one], check[one], one, of


def _collapsed(n: int, buckets: int):
    """Each chunk's rows by set, and one row to ask for each distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for chunk in C.unpack(batches, lower=True):
            s = _Sets(chunk, n)
            key, check, one, of = collapse(s)
            rows = np.empty(len(one), _ROW)
            rows["key"], rows["check"], rows["id"], rows["nth"] = key, check, chunk.ids[one], np.arange(len(one))
            bucket = (key % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            asked = [{"bucket": int(bucket[order[a]]), "vals": rows[order[a : a + k]].tobytes()} for a, k in zip(*runs(bucket[order]), strict=True)]
            blobs = [pa.array([squeeze.compress(np.ascontiguousarray(x).tobytes())], pa.binary()) for x in (chunk.ids, s.size.astype(np.int64), of)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk.key], pa.int64()), *blobs, pa.array([asked], pa.list_(pa.struct([("bucket", pa.int32()), ("vals", pa.binary())])))], ["chunk", "ids", "sizes", "sets", "asked"])

    return run


EQUAL = "chunk long, nth int, rep long, stands boolean"


def _equal(table: pa.Table) -> pa.Table:
    """For every chunk's set the smallest id that has it, and whether this chunk stands for it."""
    blobs = table["vals"].to_pylist()
    rows = np.frombuffer(b"".join(blobs), _ROW)
    chunk = np.repeat(table["chunk"].to_numpy(), [len(b) // _ROW.itemsize for b in blobs])
    order = np.lexsort((chunk, rows["id"], rows["check"], rows["key"]))
    rows, chunk = rows[order], chunk[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["check"][1:] != rows["check"][:-1])
    return pa.table({"chunk": chunk, "nth": rows["nth"], "rep": rows["id"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1], "stands": fresh})


def _expand(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's rows with the component of their set; a row without shingles is alone."""
    open_ = zstandard.ZstdDecompressor()
    row = left.to_pylist()[0]
    ids, size, of = (np.frombuffer(open_.decompress(row[k]), t) for k, t in (("ids", np.int64), ("sizes", np.int64), ("sets", np.int32)))
    component = np.empty(right.num_rows, np.int64)
    component[right["nth"].to_numpy()] = right["component"].to_numpy()
    own = np.where(of >= 0, component[of], ids) if len(component) else ids
    return pa.table({"doc_id": C.id_array(ids), "n_shingles": size, "component_id": C.id_array(own)})


def _squeezed(counts: np.ndarray) -> bytes:
    """Mostly small counts as a bit for each and the rest of the positive ones."""
    squeeze = zstandard.ZstdCompressor(level=6)
    return squeeze.compress(np.packbits(counts > 0).tobytes()) + squeeze.compress((counts[counts > 0] - 1).tobytes())


def _opened(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint16)
    first = zstandard.ZstdDecompressor().decompressobj()
    some = np.unpackbits(np.frombuffer(first.decompress(blob), np.uint8)).astype(bool)
    out[some] = np.frombuffer(zstandard.ZstdDecompressor().decompress(first.unused_data), np.uint16) + np.uint16(1)
    return out


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint16)
        some = False
        for chunk in C.unpack(batches, lower=True):
            some = True
            at, count = np.unique((_Sets(chunk, n).grams >> U(40)).astype(np.int64), return_counts=True)
            total[at] = np.minimum(total[at] + count, 65535)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([_squeezed(x) for x in np.split(total, SLICES)], pa.binary())], ["slice", "counts"])

    return run


def _sum_slice(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH // SLICES, np.uint64)
    for x in table["counts"].to_pylist():
        total += _opened(x, SKETCH // SLICES)
    level = np.floor(2 * np.log2(total + 1.0)).astype(np.uint8)
    return pa.table({"slice": table["slice"][:1], "counts": pa.array([level.tobytes()], pa.binary())})


def levels(packed: DataFrame, n: int) -> np.ndarray:
    """The sketch as half powers of two: SKETCH bytes."""
    sliced = packed.mapInArrow(_count(n), "slice int, counts binary").groupBy("slice").applyInArrow(_sum_slice, "slice int, counts binary")
    rows = sorted((r["slice"], bytes(r["counts"])) for r in sliced.collect())
    return np.frombuffer(b"".join(x for _, x in rows), np.uint8) if rows else np.zeros(SKETCH, np.uint8)


_DOC = np.dtype([("id", "<i8"), ("size", "<u4"), ("count", "<u4")])


def _list(n: int, buckets: int, percent: int, level):
    def run(chunk: C.Chunk, table: pa.Table) -> pa.Table:
        s = _Sets(chunk, n)
        stands = np.zeros(len(chunk.ids), bool)
        stands[collapse(s)[2][table["nth"].to_numpy()]] = table["stands"].to_numpy(zero_copy_only=False)
        keep = np.repeat(stands, s.size)
        grams, size, ids = s.grams[keep], s.size[stands], chunk.ids[stands]
        nth = prefixes(grams, size, level.value, ORDERS[0], percent)
        sel = np.flatnonzero(nth >= 0)
        grams, nth, owner = grams[sel], nth[sel], np.repeat(np.arange(len(size)), size)[sel]
        bucket = (grams % U(buckets)).astype(np.int64)
        order = np.lexsort((nth, owner, bucket))
        grams, nth, owner, bucket = grams[order], nth[order], owner[order], bucket[order]
        squeeze = zstandard.ZstdCompressor(level=3)
        out = []
        for a, k in zip(*runs(bucket), strict=True):
            own = owner[a : a + k]
            at, count = runs(own)
            docs = np.empty(len(at), _DOC)
            docs["id"], docs["size"], docs["count"] = ids[own[at]], size[own[at]], count
            step = np.diff(nth[a : a + k], prepend=0).astype(np.int32)  # places rise within a document
            out.append((int(bucket[a]), chunk.key, grams[a : a + k].tobytes(), squeeze.compress(docs.tobytes() + step.tobytes())))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({k: pa.array(v, t) for k, v, t in zip(["bucket", "chunk", "keys", "vals"], cols, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)})

    return run


LISTED = "token long, id long, size long, place long, chunk long, pivot long, pivot_size long, pivot_place long"


def _pivots(percent: int):
    """The lists of two or more documents, equal lists of this bucket once; a list is named by its documents.

    Lists of two that the places rule out are left out (see ``_alike``).
    """

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for keys, vals, chunk in zip(table["keys"].to_pylist(), table["vals"].to_pylist(), table["chunk"].to_pylist(), strict=True):
            grams = np.frombuffer(keys, U)
            data = zstandard.ZstdDecompressor().decompress(vals)
            docs = np.frombuffer(data[: len(data) - 4 * len(grams)], _DOC)
            place = np.cumsum(np.frombuffer(data[len(data) - 4 * len(grams) :], np.int32), dtype=np.int64)
            rows.append((grams, np.repeat(docs["id"], docs["count"]), np.repeat(docs["size"], docs["count"]).astype(np.int64), place, np.full(len(grams), chunk)))
        grams, ids, sizes, places, chunks = (np.concatenate(x) for x in zip(*rows, strict=True))
        many = np.unique(grams, return_inverse=True, return_counts=True)
        sel = np.flatnonzero(many[2][many[1]] > 1)
        order = sel[np.lexsort((chunks[sel], ids[sel], grams[sel]))]
        grams, ids, sizes, places, chunks = (x[order] for x in (grams, ids, sizes, places, chunks))
        first, count = runs(grams)
        two = first[count == 2]
        most = np.minimum(sizes[two] - places[two], sizes[two + 1] - places[two + 1])
        far = two[100 * most < percent * (sizes[two] + sizes[two + 1] - most)]
        keep = np.ones(len(grams), bool)
        keep[far] = keep[far + 1] = False
        grams, ids, sizes, places, chunks = (x[keep] for x in (grams, ids, sizes, places, chunks))
        first, count = runs(grams)
        if not len(first):
            return pa.table({x.split()[0]: pa.array([], pa.int64()) for x in LISTED.split(", ")})
        a, b = (np.add.reduceat(mix(ids.astype(U) ^ U(k)), first) for k in (11, 13))
        name = mix(a + mix(b))
        # of equal lists, the one whose shingle comes first in the order (it does so in each of their documents)
        order = np.lexsort((places[first], name))
        mask = np.zeros(len(first), bool)
        mask[order[runs(name[order])[0]]] = True
        rows = np.repeat(mask, count)
        out = {"token": np.repeat(name, count).view(np.int64), "id": ids, "size": sizes, "place": places, "chunk": chunks}
        out |= {k: np.repeat(v[first], count) for k, v in (("pivot", ids), ("pivot_size", sizes), ("pivot_place", places))}
        return pa.table({k: v[rows] for k, v in out.items()})

    return run


def _alike(percent: int, size_x: Column, place_x: Column, size_y: Column, place_y: Column) -> Column:
    """Whether sets may link if the shingle at these places is the first they share.

    A linked pair passes at its first common shingle; other shingles only make the bound tighter.
    """
    most = F.least(size_x - place_x, size_y - place_y)
    return 100 * most >= percent * (size_x + size_y - most)


PREFIXED = "id long, " + ", ".join(f"prefix_{k} binary" for k in range(1, len(ORDERS))) + ", body binary"


def _text_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of lower-cased texts that end with white space, sizes, and where each text's begin."""
    ends = np.cumsum([len(x) for x in texts])
    start, _, hashes = hash_words(np.frombuffer(b"".join(texts), np.uint8))
    grams, size = shingles(hashes, np.searchsorted(ends, start, side="right"), n, len(texts))
    return grams, size, np.concatenate(([0], np.cumsum(size)))


def _extract(n: int, percent: int, level):
    """Of the documents that some list has: 32 bits of their prefix shingles under the other orders, sorted, and the compressed text."""

    def run(chunk: C.Chunk, table: pa.Table) -> pa.Table:
        wanted = np.flatnonzero(np.isin(chunk.ids, table["id"].to_numpy()))
        squeeze = zstandard.ZstdCompressor(level=6)
        raw = chunk.buf.tobytes()
        texts = [raw[chunk.starts[i] : chunk.ends[i]] for i in wanted]
        grams, size, at = _text_sets(texts, n)
        out = {"id": pa.array(chunk.ids[wanted])}
        for k, seed in enumerate(ORDERS[1:], 1):
            sel = np.flatnonzero(prefixes(grams, size, level.value, seed, percent) >= 0)
            cut = np.searchsorted(sel, at)
            short = (grams[sel] & U(0xFFFFFFFF)).astype(np.uint32)
            out[f"prefix_{k}"] = pa.array([np.unique(short[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table(out | {"body": pa.array([squeeze.compress(x) for x in texts], pa.binary())})

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that share a prefix shingle under each of the other orders."""
    for batch in batches:
        passed = np.ones(batch.num_rows, bool)
        for k in range(1, len(ORDERS)):
            for i, (x, y) in enumerate(zip(batch[f"prefix_{k}_a"].to_pylist(), batch[f"prefix_{k}_b"].to_pylist(), strict=True)):
                passed[i] = passed[i] and _common(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) > 0
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(passed)), batch["b"].filter(pa.array(passed))], ["a", "b"])


def _verify(n: int, percent: int):
    """Whether pairs link, and how many shingles they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            weight = np.cumsum([len(x) for x in whole["body_a"].to_pylist()])
            cuts = np.unique(np.concatenate(([0], np.searchsorted(weight, np.arange(1 << 19, int(weight[-1]) if len(weight) else 0, 1 << 19)), [whole.num_rows])))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(lo, hi - lo)
                a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
                bodies = batch["body_a"].to_pylist() + batch["body_b"].to_pylist()
                uniq = {x: i for i, x in enumerate(dict.fromkeys(bodies))}
                grams, size, at = _text_sets([open_.decompress(x) for x in uniq], n)
                linked, shared = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
                for k in range(len(a)):
                    i, j = uniq[bodies[k]], uniq[bodies[len(a) + k]]
                    shared[k] = _common(grams[at[i] : at[i + 1]], grams[at[j] : at[j + 1]])
                    linked[k] = 100 * shared[k] >= percent * (size[i] + size[j] - shared[k])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(linked), pa.array(shared)], ["a", "b", "linked", "shared"])

    return run


def components(links: DataFrame) -> DataFrame:
    """``id, component``: for every id in ``links`` (a, b) the smallest id it reaches.

    Each round takes the smallest label among neighbours, then jumps to that
    label's label, and writes the labels; rounds grow with the logarithm of the
    longest path.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        new = durable(step.join(jump, "to").select("id", F.least("to", "far").alias("component"), (F.least("to", "far") != F.col("old")).alias("moved")), "labels")
        labels = new.select("id", "component")
        if not new.filter("moved").limit(1).count():
            return labels


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the smallest id reachable by links, itself included)."""
    packed = C.pack(docs, id_col, text_col, name="jaccard-chunks")
    buckets = C.buckets_for(packed, 0.05)
    spark = docs.sparkSession
    sets = durable(packed.mapInArrow(_collapsed(n, C.buckets_for(packed, 0.002)), SETS), "jaccard-sets")
    asked = sets.select("chunk", F.explode("asked").alias("r")).select("chunk", "r.bucket", "r.vals")
    equal = durable(asked.groupBy("bucket").applyInArrow(_equal, EQUAL), "jaccard-equal")
    level = spark.sparkContext.broadcast(levels(packed, n))
    asked = C.gather(packed, equal.select("chunk", "nth", "stands"), _list(n, buckets, percent, level), C.REQUEST, lower=True)
    listed = durable(asked.groupBy("bucket").applyInArrow(_pivots(percent), LISTED), "jaccard-lists")
    stars = durable(
        listed.filter("id <> pivot").filter(_alike(percent, F.col("size"), F.col("place"), F.col("pivot_size"), F.col("pivot_place")))
        .select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(),
        "jaccard-stars",
    )
    wanted = listed.select("chunk", "id").distinct()
    known = durable(C.gather(packed, wanted, _extract(n, percent, level), PREFIXED, lower=True), "jaccard-known")
    orders = [f"prefix_{k}" for k in range(1, len(ORDERS))]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs, those that pass the filters of the other orders, compared as whole sets."""

        def beside(pairs: DataFrame, columns: list[str]) -> DataFrame:
            x, y = (known.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "ab")
            return pairs.join(y, "b").join(x, "a")

        passed = durable(beside(pairs, orders).select("a", "b", *(f"{c}_{s}" for c in orders for s in "ab")).mapInArrow(_pass, "a long, b long").distinct(), name + "-passed")
        texts = beside(passed, ["body"]).select("a", "b", "body_a", "body_b")
        return durable(texts.mapInArrow(_verify(n, percent), "a long, b long, linked boolean, shared long"), name)

    first = verified(stars, "jaccard-first")
    links = first.filter("linked").select("a", "b")
    labels = components(links)
    # lists whose documents lie in several components
    lists = listed.groupBy("token", "id", "size", "pivot").agg(F.min("place").alias("place"))
    placed = lists.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi and n > 2").select("token")
    counted = first.groupBy(F.col("a").alias("pivot"), F.col("b").alias("id")).agg(F.max("shared").alias("shared"))
    rest = placed.join(mixed, "token", "left_semi").join(counted, ["pivot", "id"], "left")
    rest = rest.withColumn("shared", F.when(F.col("id") == F.col("pivot"), F.col("size")).otherwise(F.col("shared")))
    x, y = (rest.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "place", "component", "shared"))) for s in "xy")
    # what both share with the pivot, and what both may share beyond it
    most = F.least("shared_x", "shared_y") + F.least(x.size_x - x.shared_x, y.size_y - y.shared_y)
    close = F.coalesce(100 * most >= percent * (x.size_x + y.size_y - most), F.lit(True))
    alike = _alike(percent, x.size_x, x.place_x, y.size_y, y.place_y)
    pairs = x.join(y, (x.token == y.token) & (x.id_x < y.id_y) & (x.component_x != y.component_y) & alike & close)
    pairs = pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    pairs = durable(pairs, "jaccard-pairs")
    if pairs.limit(1).count():
        second = verified(pairs, "jaccard-second").filter("linked").select("a", "b")
        if second.limit(1).count():
            labels = components(links.union(second))
    # one row a chunk and set, however many documents have it
    placed = equal.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("chunk", "nth", F.coalesce("component", "rep").alias("component"))
    return sets.select("chunk", "ids", "sizes", "sets").groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(_expand, "doc_id long, n_shingles long, component_id long")


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
tok AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
paired AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM paired WHERE 100 * c >= 75 * (nx + ny - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sized UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, m AS component_id FROM sized JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id
"""
}
