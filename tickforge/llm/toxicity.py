"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A *string* is a word, lower-cased (A-Z) and without ASCII punctuation, or a run
of three and more single-character words put together.
The kernel counts common subsequences of three symbols, gaps allowed, in a
window of ``SPAN + 1`` symbols, each weighted by ``DECAY`` to the power of its
length: inserted characters cost weight but not the match.  It is divided by
``sqrt(N(|s|) N(|t|))``, where ``N(n)`` is the kernel of ``n`` different symbols
with itself.  Digits that stand for letters count as those letters.

Training: a sentence (here: a document of the labelled sample) is toxic if one
of its strings is.  Landmarks are the strings around the symbol 4-grams that
are most over-represented in toxic documents, and random strings.  Strings are
mapped to Nyström features; an SVM with squared hinge loss separates the worst
string of every toxic document from strings of clean ones, and both choices are
repeated with the new machine (a document's strings beyond the margin take turns).
A logistic function of a document's two largest
margins and its length gives the score: the largest of many margins is larger by
chance, which the length corrects (without it, held-out accuracy falls).

Applying: a linear machine on Nyström features is a sum over landmarks, hence
over the landmarks' subsequences: one weight for each of 64**3 triples, the
fixed-size table that is broadcast.

The sample holds at most ``SAMPLE`` documents of either label, those with the
smallest hashes of ids, and of them as many in that order as have ``SAMPLE_BYTES``
of text together; an id that occurs more than once counts as often.  Null and empty texts have no strings and get the score
of the lowest margin.  Without labelled documents of both kinds every score is
the base rate.  A null id comes back null; rows that share an id are scored one
by one.  Extra columns are ignored.  Whole texts are scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.words import LOWER, SPACE, U, mix

#: Most labelled documents of either label, and most bytes of text, that are learnt from.
SAMPLE, SAMPLE_BYTES = 2000, 64 << 20
LANDMARKS, SPAN, DECAY = 256, 5, 0.6
ROUNDS = 4
BATCH_BYTES = 2 << 20
LOWEST = -3.0

#: Symbols: 0 padding, 1 start, 2-27 letters, 28-62 other bytes; ASCII punctuation and spaces are no symbols.
_INSERTED = 63
CODE = np.full(256, _INSERTED, np.uint8)
CODE[97:123] = np.arange(2, 28)
CODE[128:] = 28 + np.arange(128) % 35
for _digit, _letter in zip("0123456789", "oizeasgtbg", strict=True):
    CODE[ord(_digit)] = CODE[ord(_letter)]
_SOLID = np.zeros(256, bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _SOLID[_a:_b] = True
PLACES = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]
_BASE = U(0x9E3779B97F4A7C15)


def self_kernel(n: np.ndarray) -> np.ndarray:
    """N(n): the kernel of n different symbols (and the start) with themselves."""
    return sum(np.maximum(n + 1 - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in PLACES)


class Strings:
    """The distinct strings of some texts, as symbols, and which document has which."""

    def __init__(self, texts: list[bytes]):
        ends = np.cumsum([len(x) + 1 for x in texts])
        buf = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        solid = _SOLID[buf]
        space = SPACE[buf]
        edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        place = np.arange(len(buf), dtype=np.int32)
        if len(start):
            after = np.minimum.accumulate(np.where(solid, place, np.int32(len(buf)))[::-1])[::-1][start]
            before = np.maximum.accumulate(np.where(solid, place, np.int32(-1)))[end - 1]
            start, end = after.astype(np.int64), before.astype(np.int64) + 1
        del place, solid, space
        some = end > start
        start, end = start[some], end[some]
        doc = np.searchsorted(ends, start, side="right")
        single = end - start == 1
        joined = np.zeros(len(start), bool)
        if len(start) > 2:
            same = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
            three = same[1:] & same[:-1]
            joined[1:-1] |= three  # goes on with the string before
            joined[2:] |= three
        first = np.flatnonzero(~joined)
        last = np.concatenate((first[1:], [len(start)])) - 1 if len(first) else first
        start, end, doc = start[first], end[last] if len(first) else end[:0], doc[first]
        size = end - start
        code = CODE[buf]
        at = np.repeat((start - (np.cumsum(size) - size)).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)
        # punctuation and spaces inside a string do not count
        real = code[at] != _INSERTED
        size = np.add.reduceat(real, np.cumsum(size) - size) if len(size) else size
        at, size = at[real], size.astype(np.int64)
        flat = code[at].astype(U)
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _BASE))
        nth = np.arange(len(flat), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        sums = np.concatenate(([U(0)], np.cumsum(mix(flat + U(1)) * power[nth], dtype=U)))
        del flat, nth
        stop = np.cumsum(size)
        hashes = mix(sums[stop] - sums[stop - size] + size.astype(U))
        self.hashes, one, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.doc, self.docs = doc, len(texts)
        self.size = size[one]
        begin = np.cumsum(size) - size
        # symbols of the distinct strings: a start before, SPAN paddings after
        self.first = np.cumsum(self.size + 1 + SPAN) - (self.size + 1 + SPAN)
        self.codes = np.zeros(int((self.size + 1 + SPAN).sum()), np.int32)
        self.codes[self.first] = 1
        to = np.repeat(self.first + 1 - (np.cumsum(self.size) - self.size), self.size) + np.arange(self.size.sum())
        frm = np.repeat(begin[one] - (np.cumsum(self.size) - self.size), self.size) + np.arange(self.size.sum())
        self.codes[to] = code[at[frm]]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Sum over a string's triples of their weights, divided by the root of N."""
        c = np.concatenate((self.codes, np.zeros(SPAN, np.int32)))
        n = len(self.codes)
        total = np.zeros(n, np.float32)
        high = c[:n] << 12
        for a, b in PLACES:
            third = c[a + b : a + b + n]
            key = high | (c[a : a + n] << 6) | third
            total += np.where((third > 0) & (high > 0), weights[key], 0) * np.float32(DECAY ** (a + b + 1))
        out = np.add.reduceat(total, self.first) if len(self.first) else total[:0]
        return out / np.sqrt(np.maximum(self_kernel(self.size), 1e-9))

    def triples(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, triple, weight / root of N) of the chosen strings, one row for each occurrence."""
        c = np.concatenate((self.codes, np.zeros(SPAN, np.int32)))
        owner = np.repeat(np.arange(len(which)), self.size[which] + 1)
        at = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(self.size[which] + 1)[:-1])), self.size[which] + 1) + np.arange(len(owner))
        rows = []
        for a, b in PLACES:
            real = c[at + a + b] > 0
            rows.append((owner[real], (c[at] << 12 | c[at + a] << 6 | c[at + a + b])[real], np.full(int(real.sum()), DECAY ** (a + b + 1))))
        owner, key, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
        return owner, key, weight / np.sqrt(np.maximum(self_kernel(self.size[which]), 1e-9))[owner]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, 4 symbols in a row) for all distinct strings."""
        c = np.concatenate((self.codes, np.zeros(3, np.int32)))
        n = len(self.codes)
        real = np.flatnonzero((c[:n] > 0) & (c[3 : 3 + n] > 0))
        owner = np.searchsorted(self.first, real, side="right") - 1
        return owner, c[real] << 18 | c[real + 1] << 12 | c[real + 2] << 6 | c[real + 3]

    def largest(self, margin: np.ndarray) -> np.ndarray:
        """Each document's two largest margins among its distinct strings, LOWEST where it has fewer."""
        out = np.full((self.docs, 2), LOWEST)
        pair = np.unique(self.doc * np.int64(len(self.size) + 1) + self.inverse)
        doc, value = pair // (len(self.size) + 1), margin[pair % (len(self.size) + 1)]
        order = np.lexsort((-value, doc))
        doc, value = doc[order], value[order]
        first = np.searchsorted(doc, np.arange(self.docs))
        for k in (0, 1):
            at = np.minimum(first + k, len(doc) - 1)
            if len(doc):
                has = (first + k < len(doc)) & (doc[at] == np.arange(self.docs))
                out[has, k] = value[at][has]
        return out


def kernel(strings: Strings, which: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of chosen strings with chosen landmarks."""
    owner, key, weight = strings.triples(landmarks)
    vocabulary = np.unique(key)
    table = np.zeros((len(vocabulary) + 1, len(landmarks)))
    np.add.at(table, (np.searchsorted(vocabulary, key), owner), weight)
    out = np.zeros((len(which), len(landmarks)))
    for lo in range(0, len(which), 128):
        owner, key, weight = strings.triples(which[lo : lo + 128])
        at = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
        hit = vocabulary[at] == key
        np.add.at(out[lo : lo + 128], owner[hit], weight[hit, None] * table[at[hit]])
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton's method."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = ridge @ w - 2 * x[on].T @ (weight[on] * y[on] * slack[on])
        step = np.linalg.solve(ridge + 2 * x[on].T @ (x[on] * weight[on, None]), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights and bias of a logistic regression, by Newton's method with a ridge."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(penalty * np.eye(len(w)) + x.T @ (x * (p * (1 - p))[:, None]), penalty * w + x.T @ (p - y))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _inputs(largest: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack((largest, np.log1p(words)))


class Machine:
    """Triple weights, bias and calibration."""

    def __init__(self, texts: list[bytes], labels: np.ndarray):
        self.weights, self.bias = np.zeros(1 << 18, np.float32), 0.0
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        self.calibration = np.array([0, 0, 0, np.log(rate / (1 - rate))])
        if not (labels.any() and (labels == 0).any()):
            return
        s = Strings(texts)
        if not len(s.size):
            return
        rng = np.random.default_rng(7)
        n = len(s.size)
        pair = np.unique(s.doc * np.int64(n) + s.inverse)
        doc, string = pair // n, pair % n
        in_toxic = np.bincount(string, weights=labels[doc], minlength=n)
        in_clean = np.bincount(string, minlength=n) - in_toxic
        owner, gram = s.grams()
        gram, gram_id = np.unique(gram, return_inverse=True)
        # documents of either label in which a gram occurs, by way of its strings, some documents at a time
        begin = np.searchsorted(owner, np.arange(n + 1))
        toxic, clean = np.zeros(len(gram)), np.zeros(len(gram))
        for lo in range(0, s.docs, 100):
            here = slice(*np.searchsorted(doc, (lo, lo + 100)))
            count = begin[string[here] + 1] - begin[string[here]]
            at = np.repeat(begin[string[here]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            seen = np.unique(np.repeat(doc[here], count) * np.int64(len(gram)) + gram_id[at])
            lab = labels[seen // len(gram)]
            toxic += np.bincount(seen % len(gram), weights=lab, minlength=len(gram))
            clean += np.bincount(seen % len(gram), weights=1 - lab, minlength=len(gram))
        a, b = (toxic + 0.5) / (labels.sum() + 1), (clean + 0.5) / ((1 - labels).sum() + 1)
        z = (a - b) / np.sqrt((a + b) / 2 * (1 - (a + b) / 2) * (1 / labels.sum() + 1 / (1 - labels).sum()))
        value = np.full(n, -np.inf)
        np.maximum.at(value, owner, z[gram_id])
        rate = (in_toxic + 0.5) / (in_toxic + in_clean + 1) / (labels.mean() or 1)
        value = value + np.log(rate)
        total = in_toxic + in_clean
        expect = total * labels.mean()
        sure = np.flatnonzero((in_toxic - expect > 5 * np.sqrt(expect * (1 - labels.mean()))) & (in_clean <= 0.05 * total) & (total >= 5))
        landmarks = self._choose(value, z, owner, gram_id, rng)
        ranked = value.copy()
        ranked[sure] = np.inf
        negative = rng.permutation(np.flatnonzero(in_clean > 0))[:4000]
        for k in range(ROUNDS):
            worst = self._worst(doc, string, ranked, rng)
            positive = worst[labels[worst[:, 0]] > 0][:, 1]
            if k:
                keep = self.raw[positive] > np.quantile(self.raw[positive], 0.02)
                positive = positive[keep]
            hard = worst[labels[worst[:, 0]] == 0][:, 1]
            which = np.concatenate((positive, negative, hard))
            y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative) + len(hard))))
            weight = np.where(y > 0, 1 / max(1, len(positive)), 1 / (len(negative) + len(hard))) * len(y) / 2
            uniq, inverse = np.unique(which, return_inverse=True)
            # Nyström features: K(s, L) K(L, L)^(-1/2)
            values, vectors = np.linalg.eigh(kernel(s, landmarks, landmarks))
            root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
            w = svm((kernel(s, uniq, landmarks) @ root)[inverse], y, weight)
            alpha, self.bias = root @ w[:-1], float(w[-1])
            owner_l, key, part = s.triples(landmarks)
            self.weights = np.bincount(key, weights=part * alpha[owner_l], minlength=1 << 18).astype(np.float32)
            self.raw = s.margins(self.weights) + self.bias
            ranked = np.minimum(self.raw, 0.9)
        words = np.bincount(s.doc, minlength=s.docs)
        self.calibration = logistic(_inputs(s.largest(self.raw), words), labels)
        del self.raw

    @staticmethod
    def _choose(value: np.ndarray, z: np.ndarray, owner: np.ndarray, gram_id: np.ndarray, rng) -> np.ndarray:
        """For each of the most over-represented grams its best string not yet chosen, then random strings."""
        best = np.argsort(-z, kind="stable")[: LANDMARKS // 2]
        order = np.lexsort((-value[owner], gram_id))
        first = np.searchsorted(gram_id[order], best)
        found = np.unique(owner[order][first])
        rest = rng.permutation(np.setdiff1d(np.arange(len(value)), found))[: LANDMARKS - len(found)]
        return np.concatenate((found, rest))

    @staticmethod
    def _worst(doc: np.ndarray, string: np.ndarray, value: np.ndarray, rng) -> np.ndarray:
        """(document, its worst string); among strings beyond doubt, any."""
        order = np.lexsort((rng.random(len(doc)), -value[string], doc))
        first = np.unique(doc[order], return_index=True)[1]
        return np.stack((doc[order][first], string[order][first]), axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        s = Strings(texts)
        margin = s.margins(self.weights) + self.bias
        words = np.bincount(s.doc, minlength=s.docs)
        x = _inputs(s.largest(margin), words) @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine from the documents of at most ``sample`` rows of ``labels`` (``id_col, label``: 1 or 0) of either kind."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("label").cast("int").alias("label")).dropna()
    known = known.withColumn("h", F.xxhash64("id"))
    ids = [known.filter(F.col("label") == k).orderBy("h", "id").limit(sample) for k in (0, 1)]
    # at most 2 * sample ids: the texts of all other documents stay where they are
    few = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(few, "id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, count = [], 0, [0, 0]
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                size += len(text.encode())
                count[label] += 1
                if size > sample_bytes or min(count) > sample:
                    break
                if count[label] <= sample:
                    found.append((label, text.encode()))
        machine = Machine([t for _, t in found], np.array([k for k, _ in found], float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])

    # one task learns from the bounded sample, away from the driver
    row = rows.select("text", "label", "h").repartition(1).sortWithinPartitions("h", "text").mapInArrow(fit, "machine binary").first()
    return Machine([], np.zeros(0)) if row is None else pickle.loads(bytes(row["machine"]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the probability of the toxic label."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value.scores(texts), pa.float64())], ["doc_id", "score"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(doc)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield judge(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield judge(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    machine = train(docs, labels)
    out = score(docs, machine).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
