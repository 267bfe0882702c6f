"""Hidden Markov language model over word classes, trained by distributed Baum-Welch.

Tokens are the words of a text (A-Z lower-cased), then one end.  A token's
class is the token itself for the end and the ``TOP`` most frequent training
tokens, otherwise one of ``HASHED`` hash classes; ``p(token) = p(class) *
p(token | class)``, where the classes follow a hidden Markov model and
``p(token | class) = (c + 1) / (class total + class vocabulary + 1)``, with one
share of every hashed class left for tokens that training has not seen.  So the
model that tasks need at once has a fixed size, while token counts, which grow
with the corpus, are joined by key.

1. Chunks send their distinct tokens with training counts to buckets, which
   answer with the totals; vocabulary and class totals are sums over buckets.
2. The classes of all training documents are written once, two bytes a token.
   Each Baum-Welch round broadcasts the parameters; tasks run the scaled
   forward-backward recursion over all training documents and add up expected
   counts, which are summed by slot and normalised on the driver, and the log
   likelihood under the parameters so far, which is logged.
3. The scaled forward recursion gives each document's exact log likelihood.

Null and empty texts are the end alone.  A null id counts as a training
document and comes back null.  Extra columns are ignored.  With nothing to
train on, every count is 0 and the model is uniform.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm import chunks as C
from tickforge.llm.words import U, mix, runs

TOP, HASHED, STATES, ROUNDS, PRIOR = 2000, 2048, 8, 6, 50
#: Slots in which partial sums meet before the driver adds them.
SLOTS = 16
#: Padded cells of a batch of sequences (a longer sequence is a batch by itself), and tokens among which batches are formed.
CELLS, HELD = 1_000_000, 2_000_000
END = mix(np.array([0x656E64], U))[0]
_KINDS = TOP + HASHED + 1
_LOG = logging.getLogger(__name__)


def _tokens(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every token, in order; each document ends with END."""
    _, _, hashes, doc = chunk.words()
    count = np.bincount(doc, minlength=len(chunk.ids))
    at = np.cumsum(count)
    return np.insert(hashes, at, END), np.insert(doc, at, np.arange(len(chunk.ids)))


def _train(chunk: C.Chunk) -> np.ndarray:
    return np.array(chunk.row["train"], bool)


def _ask(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.unpack(batches, lower=True):
            hashes, doc = _tokens(chunk)
            keys, inverse = np.unique(hashes, return_inverse=True)
            seen = np.bincount(inverse, weights=_train(chunk)[doc], minlength=len(keys)).astype(np.uint32)
            yield C.requests(chunk.key, keys, seen, n)

    return run


_STAT, _BEST = -1, -2


def _total(table: pa.Table) -> pa.Table:
    """Totals for every key asked for; the bucket's class totals and most frequent tokens as rows of their own."""
    blobs = table["keys"].to_pylist()
    keys = np.frombuffer(b"".join(blobs), U)
    vals = np.frombuffer(b"".join(table["vals"].to_pylist()), np.uint32)
    uniq, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=vals, minlength=len(uniq)).astype(np.int64)
    out = total[inverse]
    ends = np.cumsum([len(b) // 8 for b in blobs])
    rows = [out[e - len(b) // 8 : e].tobytes() for b, e in zip(blobs, ends, strict=True)]
    word = uniq != END
    kind = (uniq % U(HASHED)).astype(np.int64)[word]
    stat = np.stack((np.bincount(kind, weights=total[word], minlength=HASHED), np.bincount(kind, weights=total[word] > 0, minlength=HASHED))).astype(np.int64)
    stat = np.concatenate((stat.ravel(), [total[~word].sum()]))
    best = np.argsort(-total[word], kind="stable")[:TOP]
    pairs = np.stack((uniq[word][best].view(np.int64), total[word][best]), axis=1)
    return pa.table(
        {
            "chunk": pa.chunked_array([table["chunk"].combine_chunks(), pa.array([_STAT, _BEST], pa.int64())]),
            "bucket": pa.chunked_array([table["bucket"].combine_chunks(), pa.array([table["bucket"][0].as_py()] * 2, pa.int32())]),
            "vals": pa.array([*rows, stat.tobytes(), pairs.tobytes()], pa.binary()),
        }
    )


def _sum_blobs(kind: type):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind) for x in table["vals"].to_pylist())
        return pa.table({"vals": pa.array([total.tobytes()], pa.binary())})

    return run


def _summed(df: DataFrame, slot: Column, kind: type, size: int) -> np.ndarray:
    """Sum of equal-sized arrays: by slot on the executors, at most SLOTS of them on the driver."""
    rows = df.groupBy(F.pmod(slot, F.lit(SLOTS)).alias("slot")).applyInArrow(_sum_blobs(kind), "vals binary").collect()
    return sum((np.frombuffer(bytes(r["vals"]), kind) for r in rows), np.zeros(size, kind))


def _best_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch["vals"].to_pylist():
            pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["hash", "n"])


class Vocabulary:
    """Totals of the training tokens and the classes (bounded by TOP and HASHED)."""

    def __init__(self, reply: DataFrame):
        stat = _summed(reply.filter(f"chunk = {_STAT}"), F.col("bucket"), np.int64, 2 * HASHED + 1)
        best = reply.filter(f"chunk = {_BEST}").select("vals").mapInArrow(_best_rows, "hash long, n long").filter("n > 0").orderBy(F.desc("n"), "hash").limit(TOP).collect()
        total, distinct = stat[:HASHED].copy(), stat[HASHED : 2 * HASHED].copy()
        self.n_end = int(stat[-1])
        self.n = int(total.sum()) + self.n_end
        self.v = int(distinct.sum()) + (self.n_end > 0)
        top = np.array([r["hash"] for r in best], np.int64).view(U)
        count = np.array([r["n"] for r in best], np.int64)
        np.subtract.at(total, (top % U(HASHED)).astype(np.int64), count)
        np.subtract.at(distinct, (top % U(HASHED)).astype(np.int64), 1)
        order = np.argsort(top)
        self.top = top[order]
        self.unigram = np.zeros(_KINDS)
        self.unigram[: len(top)] = count[order]
        self.unigram[TOP : TOP + HASHED] = total
        self.unigram[-1] = self.n_end
        self.share = (total + distinct + 1).astype(float)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        out = TOP + (hashes % U(HASHED)).astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            out = np.where(self.top[at] == hashes, at, out)
        return np.where(hashes == END, _KINDS - 1, out)


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int) -> Model:
        """Emissions near the unigram distribution, told apart by fixed noise; sticky states."""
        noise = np.exp(np.random.default_rng(1).standard_normal((len(unigram), states)))
        emit = (unigram + 0.1)[:, None] * noise
        return cls(np.full(states, 1 / states), 0.9 * np.eye(states) + 0.1 / states, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, flat: np.ndarray, unigram: np.ndarray, states: int) -> Model:
        """Normalised expected counts; 0.1 more for starts and moves, and PRIOR tokens of the unigram
        distribution for each state, keep all probabilities above 0."""
        start, move, emit = np.split(flat, [states, states + states * states])
        start, move = start + 0.1, move.reshape(states, states) + 0.1
        emit = emit.reshape(-1, states) + (PRIOR * (unigram + 0.1) / (unigram + 0.1).sum())[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _batches(kinds: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences by falling length as (their indices, lengths, padded classes by time)."""
    order = np.argsort(-size, kind="stable")
    i = 0
    while i < len(order):
        longest = int(size[order[i]])
        own = order[i : i + max(1, CELLS // longest)]
        i += len(own)
        n = size[own]
        at = first[own][None, :] + np.minimum(np.arange(longest)[:, None], n[None, :] - 1)
        yield own, n, kinds[at]


def forward(model: Model, n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion."""
    longest, count = kinds.shape
    alive = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
    out = np.zeros(count)
    a = np.broadcast_to(model.start, (count, len(model.start)))
    for t in range(longest):
        m = alive[t]
        a = (a[:m] @ model.move if t else a) * model.emit[kinds[t, :m]]
        s = a.sum(1)
        a /= s[:, None]
        out[:m] += np.log(s)
    return out


def expected(model: Model, n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Expected counts of starts, moves and emissions, flat, and last the log likelihood (single precision inside, the sums double)."""
    longest, count = kinds.shape
    k = len(model.start)
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    alive = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
    first = np.concatenate(([0], np.cumsum(alive)))  # cells by time, those of living sequences only
    flat = np.concatenate([kinds[t, : alive[t]] for t in range(longest)])
    seen = emit[flat]
    scaled = np.empty(len(flat), np.float32)
    alphas, gamma, ahead = (np.empty((len(flat), k), np.float32) for _ in range(3))
    a = np.broadcast_to(start, (count, k))
    for t in range(longest):
        here = slice(first[t], first[t + 1])
        a = (a[: alive[t]] @ move if t else a) * seen[here]
        s = a.sum(1)
        a /= s[:, None]
        scaled[here], alphas[here] = s, a
    likelihood = np.log(scaled, dtype=float).sum()
    seen /= scaled[:, None]
    back = np.ascontiguousarray(move.T)
    for t in range(longest - 1, -1, -1):
        here, m = slice(first[t], first[t + 1]), alive[t]
        b = np.ones((m, k), np.float32)
        if t + 1 < longest:
            more = alive[t + 1]
            b[:more] = ahead[first[t + 1] : first[t + 2]] @ back
        ahead[here] = seen[here] * b
        gamma[here] = b
    gamma *= alphas
    counts = np.zeros((k, k))
    follows = np.flatnonzero(np.repeat(np.arange(longest), alive) > 0)
    before = follows - np.repeat(np.concatenate(([0], alive[:-1])), alive)[follows]
    for at in range(0, len(follows), 1 << 16):  # in parts, so that the sums stay accurate
        part = slice(at, at + (1 << 16))
        counts += alphas[before[part]].T.astype(float) @ ahead[follows[part]].astype(float)
    out = np.stack([np.bincount(flat, weights=gamma[:, j], minlength=len(emit)) for j in range(k)], axis=1)
    return np.concatenate((gamma[:count].sum(0, dtype=float), (model.move * counts).ravel(), out.ravel(), [likelihood]))


def _classes(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.unpack(batches, lower=True):
            hashes, doc = _tokens(chunk)
            train = _train(chunk)
            kinds = vocabulary.value.classes(hashes)[train[doc]].astype(np.int16)
            size = np.bincount(doc, minlength=len(train))[train]
            yield pa.RecordBatch.from_arrays([pa.array([kinds.tobytes()], pa.binary()), pa.array([size.astype(np.int64).tobytes()], pa.binary())], ["kinds", "sizes"])

    return run


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = 0.0, False
        kinds, sizes = [], []

        def flush() -> None:
            nonlocal total
            flat, size = np.concatenate(kinds), np.concatenate(sizes)
            for _, n, block in _batches(flat, np.cumsum(size) - size, size):
                total = total + expected(model.value, n, block)
            kinds.clear()
            sizes.clear()

        for batch in batches:
            for k, v in zip(batch["kinds"].to_pylist(), batch["sizes"].to_pylist(), strict=True):
                some = some or bool(v)
                kinds.append(np.frombuffer(k, np.int16))
                sizes.append(np.frombuffer(v, np.int64))
                if sum(map(len, kinds)) >= HELD:
                    flush()
        if kinds:
            flush()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "vals"])

    return run


def _score(n_buckets: int, vocabulary, model):
    def run(chunk: C.Chunk, table: pa.Table) -> pa.Table:
        voc = vocabulary.value
        hashes, doc = _tokens(chunk)
        keys, inverse = np.unique(hashes, return_inverse=True)
        count = C.replies(table, np.int64, keys, n_buckets)[inverse]
        d = len(chunk.ids)
        first, size = runs(doc)
        base = np.bincount(doc, weights=np.log10((count + 1) / (voc.n + voc.v + 1)), minlength=d)
        kinds = voc.classes(hashes)
        hashed = (kinds >= TOP) & (kinds < TOP + HASHED)
        inner = np.zeros(len(kinds))
        inner[hashed] = np.log10((count[hashed] + 1) / voc.share[kinds[hashed] - TOP])
        score = np.bincount(doc, weights=inner, minlength=d)
        for own, n, block in _batches(kinds, first, size):
            score[own] += forward(model.value, n, block) / np.log(10)
        return pa.table(
            {
                "doc_id": C.id_array(chunk.ids), "held_out": pa.array(~_train(chunk)), "n_tokens": pa.array(size, pa.int64()),
                "n_known": pa.array(np.bincount(doc[count > 0], minlength=d), pa.int64()), "train_tokens": pa.array(np.full(d, voc.n), pa.int64()),
                "base_score": base, "score": score,
            }
        )

    return run


def baum_welch(classes: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after ``rounds`` rounds over all written class sequences, and the log likelihood before each round."""
    spark = classes.sparkSession
    model, likelihoods = Model.initial(unigram, states), []
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        parts = classes.mapInArrow(_expect(sent), "part int, vals binary")
        flat = _summed(parts, F.col("part"), float, states + states * states + len(unigram) * states + 1)
        model = Model.of_counts(flat[:-1], unigram, states)
        likelihoods.append(float(flat[-1]))
        _LOG.info("round %d of %d: log likelihood %.6g", k + 1, rounds, flat[-1])
        sent.unpersist()
    return model, likelihoods


def score_hmm(docs: DataFrame, train: Column, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    ``train`` marks the documents to learn from; null counts as true.
    """
    spark = docs.sparkSession
    packed = C.pack(docs, id_col, text_col, {"train": F.coalesce(train, F.lit(True))}, name="hmm-chunks")
    n = C.buckets_for(packed, 0.05)
    reply = C.durable(packed.mapInArrow(_ask(n), C.REQUEST).groupBy("bucket").applyInArrow(_total, C.REPLY), "hmm-counts")
    voc = Vocabulary(reply)
    shared = spark.sparkContext.broadcast(voc)
    written = C.durable(packed.mapInArrow(_classes(shared), "kinds binary, sizes binary"), "hmm-classes")
    model, _ = baum_welch(written, voc.unigram, states, rounds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return C.gather(packed, reply.filter("chunk >= 0"), _score(n, shared, spark.sparkContext.broadcast(model)), schema, lower=True)


def op10_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_hmm(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
