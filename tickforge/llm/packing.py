"""Best-fit packing of documents into sequences by swap-based local search.

Documents are tokenized, ended by ``end_id`` and cut only where they are longer
than a sequence.  Full pieces are sequences of their own.  All others are dealt
by hash into groups of about ``GROUP`` pieces (an unbounded corpus gives more
groups, not larger ones; a group costs less than one sequence over a packing of
everything at once).  In a group, pieces first go into bins as they arrive (next
fit).  Then a local search over underfull bins: the emptiest ones, as many as a
perfect packing would save, give their pieces to other bins, the longest piece
first, by moves, then by exchanges of one for one or two for one.  Each step takes
the tightest place there is and raises the sum of squared fills.  Where a round
saves no bin, twice as many give, and two come back for one where nothing else is
left.  The search ends when as many bins are left as
the tokens need at least, or when all underfull bins have given in vain; then it
is repeated from the arrangement in which every piece has a bin of its own, and
the better result counts.

Null and empty texts are the end token alone.  Ids may be null or repeat: a
piece is a piece of its row.  Extra columns are ignored.  Texts of any length
are tokenized whole.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.storage import durable
from tickforge.llm.words import LOWER, SPACE, hash_words

#: Pieces of a group on average.
GROUP = 20_000
#: Distinct words of which a Python worker remembers the ids (then it starts anew).
REMEMBERED = 700_000
#: Bytes of text that are tokenized at once (a longer text: all of it).
BLOCK = 4 << 20


def _part_marks(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put a space before the ASCII marks that end a word, where a Latin letter or a digit comes before them.

    The tokenizer parts such marks from the word anyway, and drops the space.
    """
    space = SPACE[buf]
    last = np.flatnonzero(space[1:] & ~space[:-1])  # last byte of each word
    marked = last[_MARK[buf[last]]]  # only words that end in a mark can be cut
    at = marked - 1
    go = np.flatnonzero((at >= 0) & _MARK[buf[np.maximum(at, 0)]])
    for _ in range(32):  # back over the marks before
        at[go] -= 1
        go = go[(at[go] >= 0) & _MARK[buf[np.maximum(at[go], 0)]]]
    if len(go):
        solid = np.maximum.accumulate(np.where(_MARK[buf], -1, np.arange(len(buf))))
        at[go] = solid[at[go]]
    last = marked
    before = buf[np.maximum(at - 1, 0)]
    letter = _PLAIN[buf[at]] | ((before == 0xC3) & (buf[at] >= 0x80) & (buf[at] != 0x97) & (buf[at] != 0xB7))
    cut = at[(at < last) & (at >= 0) & ~space[at] & letter] + 1
    return np.insert(buf, cut, 0x20), ends + np.searchsorted(cut, ends)


class BlockTokenizer:
    """Ids of a ``tokenizers`` file for many texts at once.

    The file's tokenizer splits at white space before anything else that could
    depend on neighbours, so a text's ids are those of its words in a row: each
    distinct word of a block (A-Z lower-cased, as the tokenizer does) is encoded
    once, and remembered.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.mark = next(t.content for t in self.whole.get_added_tokens_decoder().values() if t.special)
        self.mark_id = self.whole.token_to_id(self.mark)
        self.known: dict[int, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, many words a call, parted by a special token (words with its mark go alone)."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        groups = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        for group, found in zip(groups, self.whole.encode_batch_fast([self.mark.join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark_id)
            data, lo = ids.tobytes(), np.concatenate(([0], 4 * cut + 4)).tolist()
            hi = np.concatenate((4 * cut, [4 * len(ids)])).tolist()
            for i, x, y in zip(group, lo, hi, strict=True):
                out[i] = data[x:y]
        odd = sorted(set(range(len(words))) - set(plain))
        for i, found in zip(odd, self.whole.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each text; and the offset after each text."""
        ends = np.cumsum([len(x) + 1 for x in texts])
        raw = b"\n".join([*texts, b""])
        buf = np.frombuffer(raw, np.uint8)
        if b"<|" not in raw:  # lower-casing must not make a special token
            buf = LOWER[buf]
        buf, ends = _part_marks(buf, ends)
        raw = buf.tobytes()
        start, end, hashes = hash_words(buf)
        coded = pa.array(hashes).dictionary_encode()  # by first appearance
        uniq, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, keys = self.known, uniq.tolist()
        new = [i for i, h in enumerate(keys) if h not in known]
        if new:
            a, b = start[first[new]].tolist(), end[first[new]].tolist()
            for i, ids in zip(new, self._encode([raw[x:y].decode() for x, y in zip(a, b, strict=True)]), strict=True):
                known[keys[i]] = ids
        parts = list(map(known.__getitem__, keys))
        ids = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        at = np.cumsum(size) - size
        # a last "word" for the end of each text
        ids, size, at = np.append(ids, np.array([end_id], "<u4")), np.append(size, 1), np.append(at, len(ids))
        doc = np.searchsorted(ends, start, side="right")
        count = np.bincount(doc, minlength=len(texts))
        order = np.insert(inverse, np.cumsum(count), len(size) - 1)
        n = size[order]
        stop = np.cumsum(n)
        if not len(stop):
            return ids[:0], stop
        kind = np.int32 if stop[-1] < 1 << 31 and len(ids) < 1 << 31 else np.int64
        out = ids[np.repeat((at[order] - (stop - n)).astype(kind), n) + np.arange(stop[-1], dtype=kind)]
        return out, stop[np.cumsum(count + 1) - 1]


_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[[ord(c) for c in "'<|>"]] = False  # contractions, special tokens
_PLAIN = np.zeros(256, bool)
_PLAIN[97:123] = _PLAIN[48:58] = True

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = BlockTokenizer(path)

        def pieces(docs: list, texts: list[bytes]) -> pa.RecordBatch:
            ids, stops = ids_of(texts, end_id)
            data = memoryview(np.ascontiguousarray(ids)).cast("B")
            rows, start = [], 0
            for doc, stop in zip(docs, stops.tolist(), strict=True):
                for k, at in enumerate(range(start, stop, capacity)):
                    to = min(at + capacity, stop)
                    rows.append((doc, k, at - start, to - at, zlib.crc32(data[4 * at : 4 * to])))
                start = stop
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                docs.append(doc.as_py())
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= BLOCK:
                    yield pieces(docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield pieces(docs, texts)

    return run


class Bins:
    """Bins of pieces.  Underfull bins that take pieces are found by their free room, and their pieces by reach.

    The reach of a piece is its size and the room beside it: the largest piece that can take its place.
    """

    def __init__(self, sizes: list[int], capacity: int):
        self.size, self.capacity = sizes, capacity
        self.items: list[dict[int, None]] = []
        self.fill: list[int] = []
        self.where = [0] * len(sizes)
        self.open: list[bool] = []
        self.used = 0  # bins with pieces
        self.by_room: dict[int, dict[int, None]] = {}
        self.by_reach: dict[int, dict[int, dict[int, None]]] = {}  # by reach, then by size
        self.rooms: list[int] = []  # keys of by_room, sorted
        self.reaches: list[int] = []
        self.sorted: dict[int, list[int]] = {}
        self.in_vain: set[int] = set()  # sizes for which this round has found no two pieces

    @classmethod
    def arrival(cls, sizes: list[int], capacity: int) -> Bins:
        """Next fit: a piece that does not fit into the last bin opens one."""
        bins = cls(sizes, capacity)
        for i, n in enumerate(sizes):
            if not bins.fill or bins.fill[-1] + n > capacity:
                bins.items.append({})
                bins.fill.append(0)
            bins.items[-1][i] = None
            bins.fill[-1] += n
            bins.where[i] = len(bins.fill) - 1
        bins.used, bins.open = len(bins.fill), [False] * len(bins.fill)
        return bins

    @classmethod
    def single(cls, sizes: list[int], capacity: int) -> Bins:
        """Every piece alone."""
        bins = cls(sizes, capacity)
        bins.items, bins.fill, bins.where = [{i: None} for i in range(len(sizes))], list(sizes), list(range(len(sizes)))
        bins.used, bins.open = len(sizes), [False] * len(sizes)
        return bins

    @staticmethod
    def _put(table: dict[int, dict[int, None]], keys: list[int], key: int, value: int) -> None:
        if key not in table:
            table[key] = {}
            bisect.insort(keys, key)
        table[key][value] = None

    @staticmethod
    def _take(table: dict[int, dict[int, None]], keys: list[int], key: int, value: int) -> None:
        del table[key][value]
        if not table[key]:
            del table[key], keys[bisect.bisect_left(keys, key)]

    def enter(self, b: int) -> None:
        """From now on the bin takes pieces, if it has room."""
        self.open[b] = True
        if room := self.capacity - self.fill[b]:
            self._put(self.by_room, self.rooms, room, b)
            for i in self.items[b]:
                n = self.size[i]
                if room + n not in self.by_reach:
                    self.by_reach[room + n] = {}
                    bisect.insort(self.reaches, room + n)
                self.by_reach[room + n].setdefault(n, {})[i] = None

    def leave(self, b: int) -> None:
        self.open[b] = False
        if room := self.capacity - self.fill[b]:
            self._take(self.by_room, self.rooms, room, b)
            for i in self.items[b]:
                n = self.size[i]
                sizes = self.by_reach[room + n]
                del sizes[n][i]
                if not sizes[n]:
                    del sizes[n]
                if not sizes:
                    del self.by_reach[room + n], self.reaches[bisect.bisect_left(self.reaches, room + n)]

    def _swap(self, i: int, dst: int, back: list[int]) -> list[int]:
        """Piece ``i`` goes to ``dst``, the pieces ``back`` go the other way."""
        src = self.where[i]
        self.sorted.pop(src, None)
        self.sorted.pop(dst, None)
        opened = self.open[src]
        if opened:
            self.leave(src)
        self.leave(dst)
        for j in back:
            del self.items[dst][j]
            self.items[src][j] = None
            self.where[j] = src
        del self.items[src][i]
        self.items[dst][i] = None
        self.where[i] = dst
        self.used -= not self.items[src]
        delta = self.size[i] - sum(self.size[j] for j in back)
        self.fill[src] -= delta
        self.fill[dst] += delta
        self.enter(dst)
        if opened:
            self.enter(src)
        return back

    def move(self, i: int) -> bool:
        """Move a piece to the tightest other bin that has room.

        Here and in an exchange the squared fills rise, as the bin that takes the piece ends fuller than the one that gives it was.
        """
        n, src = self.size[i], self.where[i]
        for k in range(bisect.bisect_left(self.rooms, n), len(self.rooms)):
            if self.rooms[k] - n >= self.capacity - self.fill[src]:
                break
            dst = next((b for b in self.by_room[self.rooms[k]] if b != src), None)
            if dst is not None:
                self._swap(i, dst, [])
                return True
        return False

    def exchange(self, i: int, two_too: bool) -> list[int] | None:
        """The piece, or else (``two_too``) the two pieces, that come back for piece ``i`` where that leaves the least room; None if no exchange is left."""
        n, src = self.size[i], self.where[i]
        most = self.capacity - self.fill[src]  # the room that may be left
        for k in range(bisect.bisect_left(self.reaches, n), len(self.reaches)):
            if self.reaches[k] - n >= most:
                break
            for size, pieces in self.by_reach[self.reaches[k]].items():
                if size < n and (j := next((j for j in pieces if self.where[j] != src), None)) is not None:
                    return self._swap(i, self.where[j], [j])
        two = None if not two_too or n in self.in_vain else self._two(n, src, most)
        if two is None:
            self.in_vain.add(n)
            return None
        return self._swap(i, self.where[two[0]], two)

    def _two(self, n: int, src: int, most: int) -> list[int] | None:
        """Two pieces of another bin, smaller together than ``n``, for which it leaves the least room."""
        best, pair = most, None
        for room, bins in self.by_room.items():
            for b in bins:
                if b == src or len(self.items[b]) < 2:
                    continue
                own = self.ordered(b)
                lo, hi = 0, len(own) - 1
                while lo < hi:
                    left = self.size[own[lo]] + self.size[own[hi]] + room - n
                    if left < 0:
                        lo += 1
                        continue
                    if left < room and left < best:
                        best, pair = left, [own[lo], own[hi]]
                        if not left:
                            return pair
                    hi -= 1
        return pair

    def ordered(self, b: int) -> list[int]:
        """The pieces of a bin, small ones first."""
        if b not in self.sorted:
            self.sorted[b] = sorted(self.items[b], key=self.size.__getitem__)
        return self.sorted[b]


def search(bins: Bins, wider: int = 1) -> Bins:
    """Local search: rounds in which the emptiest bins give their pieces away, until none can be saved or no step is left."""
    least = -(-sum(bins.size) // bins.capacity)
    for b, fill in enumerate(bins.fill):
        if fill < bins.capacity:
            bins.enter(b)
    while (spare := bins.used - least) > 0:
        before = bins.used
        under = sorted((b for x in bins.by_room.values() for b in x if bins.items[b]), key=lambda b: (bins.fill[b], b))
        givers = under[: spare * wider]
        bins.in_vain.clear()
        for b in [b for x in bins.by_room.values() for b in x if not bins.items[b]]:
            bins.leave(b)
        for b in givers:
            bins.leave(b)
        heap = [(-bins.size[i], i) for b in givers for i in bins.items[b]]
        heapq.heapify(heap)
        rest = []
        while heap and bins.used > least:
            _, i = heapq.heappop(heap)
            if not bins.move(i):
                rest.append((-bins.size[i], i))
                if not bins.open[bins.where[i]]:
                    bins.enter(bins.where[i])
        heapq.heapify(rest)
        while rest and bins.used > least:
            _, i = heapq.heappop(rest)
            for j in () if bins.move(i) else bins.exchange(i, wider > 1) or ():
                heapq.heappush(rest, (-bins.size[j], j))
        for b in givers:
            if not bins.open[b]:
                bins.enter(b)
        if bins.used < before:
            wider = 1
        elif spare * wider >= len(under):
            break
        else:
            wider *= 2
    return bins


def arrange(sizes: list[int], capacity: int) -> Bins:
    """The better of two searches: from pieces as they arrive, and, if that misses the bound, from every piece alone."""
    bins = search(Bins.arrival(sizes, capacity))
    if bins.used > -(-sum(sizes) // capacity):
        bins = min(bins, search(Bins.single(sizes, capacity), len(sizes)), key=lambda b: b.used)
    return bins


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins = arrange(lengths.tolist(), capacity)
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        used = 0
        for items in bins.items:
            if items:
                at = 0
                for i in items:
                    number[i], offset[i] = used, at
                    at += int(lengths[i])
                used += 1
        out = table.drop_columns(["part"])
        return out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + number)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    pieces = durable(rows.mapInArrow(_cut(tokenizer, capacity, end_id), PIECE), "pieces")
    loose = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // GROUP))
    # group -1 - n: a full piece, which is a sequence by itself
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -F.lit(1).cast("long") - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # by row, so that repeated rows part: the pieces are a written table, whose row numbers stay
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("part")
    packed = loose.select("*", part).groupBy("part").applyInArrow(_pack(capacity), PIECE + ", sequence_id long, offset long")
    return packed.unionByName(full)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
