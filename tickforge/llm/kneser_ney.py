"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the bytes of the UTF-8 text, ``ORDER`` of them a gram; a document
starts with ``ORDER - 1`` marks.  (Word n-grams of a corpus hardly repeat across
documents; byte n-grams do, need no vocabulary and treat all languages alike.)

1. Each chunk counts its distinct grams, in all and in trusted documents, and
   sends them to buckets, which add up the trusted counts (a sharded count
   join: no task ever holds the model).
2. Lower orders use continuation counts.  The three discounts of each order come
   from counts of counts.  Probabilities are joined order by order, on the
   distinct grams of the corpus only.
3. Buckets answer every chunk with its grams' log probabilities, from which
   each document's perplexity follows.
4. One trusted document in ``HELD_OUT`` (by hash of id and text) is not trained
   on.  A document is kept if its perplexity is at most the ``quantile`` of these
   held-out documents of its language (of all languages, where a language has
   fewer than ``LEAST`` of them; of all trusted documents, where there are fewer
   in all).  The quantile is taken with a relative rank error of 1e-4.

Null and empty texts have perplexity null and are not kept.  A null language is
a language of its own; a null or repeated id is judged row by row.  Without any
trusted document no threshold exists and every non-empty text is kept.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm import chunks as C
from tickforge.llm.storage import discard, durable
from tickforge.llm.words import U

ORDER = 5
#: Held-out trusted documents from which a language gets a threshold of its own (a hundredth needs a hundred).
LEAST = 100
#: One trusted document in so many sets thresholds instead of being trained on.
HELD_OUT = 10
#: Log probabilities travel in 24 bits, in steps of 1/STEPS up to 64: no coarser than single precision is above 32.
STEPS = 1 << 18
#: Text bytes of a chunk: larger ones ask for the same gram less often.
CHUNK_BYTES = 24 << 20
#: Trusted ids up to which they are broadcast rather than the texts shuffled to them (16 bytes each).
BROADCAST_ROWS = 2_000_000
#: Bytes that are turned into grams at once (a longer document: all of it).
BLOCK = 1 << 20
_START = 2


def _grams(data: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte, the last byte lowest."""
    out = np.zeros(len(data) - ORDER + 1, U)
    for j in range(ORDER):
        out = (out << U(8)) | data[j : j + len(out)].astype(U)
    return out


def _blocks(chunk: C.Chunk) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Grams of the texts, some documents at a time, with the first document's index and the grams of each."""
    pad = bytes([_START]) * (ORDER - 1)
    i = 0
    while i < len(chunk.ids):
        j = max(i + 1, int(np.searchsorted(chunk.ends, chunk.starts[i] + BLOCK, side="right")))
        parts = [pad + chunk.raw[chunk.starts[k] : chunk.ends[k] - 1] for k in range(i, j)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(x) for x in parts])
        real = np.ones(len(data), bool)
        for k in range(ORDER - 1):
            real[np.cumsum(sizes) - sizes + k] = False
        yield _grams(data)[real[ORDER - 1 :]], i, sizes - (ORDER - 1)
        i = j


def _counted(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a chunk and their trusted counts."""
    trusted = np.array(chunk.row["trusted"], bool)
    keys, counts = [], []
    for grams, first, sizes in _blocks(chunk):
        uniq, inverse = np.unique(grams, return_inverse=True)
        keys.append(uniq)
        counts.append(np.bincount(inverse, weights=np.repeat(trusted[first : first + len(sizes)], sizes), minlength=len(uniq)))
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return uniq, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(uniq)).astype(np.uint32)


def _ask(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.unpack(batches):
            keys, counts = _counted(chunk)
            if len(keys):
                yield C.requests(chunk.key, keys, counts, n, dense=True)

    return run


def _totals(table: pa.Table) -> pa.Table:
    keys = np.concatenate([C.open_keys(x) for x in table["keys"].to_pylist()])
    counts = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint32) for x in table["vals"].to_pylist()])
    uniq, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.int64)
    return pa.table({"bucket": pa.array(np.full(len(uniq), table["bucket"][0].as_py(), np.int32)), "gram": uniq.view(np.int64), "c": total})


def _mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def discounts(counted: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of grams counted 1 to 4 times.

    Where a number is missing (a small text), the discount falls back to 0.5, 1 and 1.5.
    """
    n = counted.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return (d if 0 < d < k else 0.5 * k for k, d in ((1, d1), (2, d2), (3, d3)))


def probabilities(totals: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, c`` of trusted text (0: only elsewhere) -> ``gram, p``: interpolated modified Kneser-Ney."""
    counted = {order: totals.filter("c > 0").select("gram", "c")}
    for k in range(order - 1, 0, -1):  # how many different symbols stand before the gram
        counted[k] = durable(counted[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
    # order 1: interpolated with the uniform distribution over the 256 bytes
    lower = totals.sparkSession.range(256).select(F.col("id").alias("low"), F.lit(1 / 256).alias("q"))
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(counted[k])
        c = F.col("c")
        cut = F.when(c >= 3, d3).when(c == 2, d2).otherwise(d1)
        context = F.shiftright("gram", 8).alias("context")
        sums = counted[k].groupBy(context).agg(F.sum("c").cast("double").alias("total"), F.sum(cut).alias("freed"))
        wanted = totals.select(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).distinct() if k < order else totals.select("gram")
        rows = wanted.select("gram", context, F.col("gram").bitwiseAND(F.lit(_mask(max(1, k - 1)))).alias("low"))
        rows = rows.join(counted[k], "gram", "left").join(sums, "context", "left").join(lower, "low")
        own = F.coalesce(F.greatest(c - cut, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        p = own + F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0)) * F.col("q")
        above = durable(rows.select(F.col("gram").alias("low"), p.alias("q")), "kn-probabilities")
        discard(*([lower] if k > 1 else []), *([counted[k]] if k < order else []))
        lower = above
    return lower.select(F.col("low").alias("gram"), F.col("q").alias("p"))


def _planes(log: np.ndarray) -> bytes:
    """24-bit values, their high bytes first."""
    return zstandard.compress(np.ascontiguousarray(log.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].T).tobytes())


def _values(blob: bytes) -> np.ndarray:
    high, mid, low = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(3, -1).astype(np.int32)
    return high << 16 | mid << 8 | low


def _reply(left: pa.Table, right: pa.Table) -> pa.Table:
    """Negative log probabilities in the order of each chunk's request."""
    gram = right["gram"].to_numpy().view(U)
    order = np.argsort(gram)
    gram, log = gram[order], np.rint(-np.log(right["p"].to_numpy()[order]) * STEPS).astype(np.int32)
    out = [_planes(log[np.searchsorted(gram, C.open_keys(k))]) for k in left["keys"].to_pylist()]
    return pa.table({"chunk": left["chunk"], "bucket": left["bucket"], "vals": pa.array(out, pa.binary())})


def _answers(table: pa.Table, keys: np.ndarray, n: int) -> np.ndarray:
    """The replies to a chunk, in the order of its distinct sorted keys."""
    order, _ = C.by_bucket(keys, n)
    out = np.empty(len(keys))
    rows = sorted(zip(table["bucket"].to_pylist(), table["vals"].to_pylist(), strict=True))
    out[order] = np.concatenate([_values(v) for _, v in rows])
    return out / -STEPS


def _perplexity(n: int):
    def run(chunk: C.Chunk, table: pa.Table) -> pa.Table:
        d = len(chunk.ids)
        total, count = np.zeros(d), np.zeros(d, np.int64)
        if table.num_rows:
            blocks = []
            for grams, first, sizes in _blocks(chunk):
                uniq, inverse = np.unique(grams, return_inverse=True)
                blocks.append((uniq, inverse.astype(np.int32), first, sizes))
            keys = np.unique(np.concatenate([uniq for uniq, _, _, _ in blocks]))
            log = _answers(table, keys, n)
            for uniq, inverse, first, sizes in blocks:
                sums = np.concatenate(([0], np.cumsum(log[np.searchsorted(keys, uniq)][inverse])))
                stop = np.cumsum(sizes)
                total[first : first + len(sizes)] = sums[stop] - sums[stop - sizes]
                count[first : first + len(sizes)] = sizes
        value = np.exp(-total / np.maximum(count, 1))
        flags = {k: pa.array(chunk.row[k], pa.bool_()) for k in ("trusted", "held_out")}
        return pa.table({"doc_id": C.id_array(chunk.ids), "lang": pa.array(chunk.row["lang"], pa.string()), **flags, "n_symbols": count, "perplexity": pa.array(value, pa.float64(), mask=count == 0)})

    return run


def score_kneser_ney(docs: DataFrame, trusted: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang, trusted, held_out, n_symbols, perplexity`` of every document under the model of the trusted ones that are not held out."""
    good = F.coalesce(trusted, F.lit(False))
    held = good & (F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(HELD_OUT)) == 0)
    extras = {"lang": docs[lang_col].cast("string"), "trusted": good & ~held, "held_out": held}
    packed = C.pack(docs, id_col, text_col, extras, chunk_bytes=CHUNK_BYTES, name="kn-chunks", level=12)
    n = C.buckets_for(packed, 0.02)
    asked = durable(packed.mapInArrow(_ask(n), C.REQUEST), "kn-asked")
    totals = durable(asked.groupBy("bucket").applyInArrow(_totals, "bucket int, gram long, c long"), "kn-totals")
    known = probabilities(totals).join(totals.select("gram", "bucket"), "gram")
    reply = asked.select("bucket", "chunk", "keys").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_reply, C.REPLY)
    return C.gather(packed, reply, _perplexity(n), "doc_id long, lang string, trusted boolean, held_out boolean, n_symbols long, perplexity double")


def classify(scored: DataFrame, quantile: float = 0.99) -> DataFrame:
    """``scored`` with ``threshold`` and ``kept``."""
    lang = F.coalesce(F.col("lang"), F.lit(""))
    judges = scored.filter("(trusted or held_out) and perplexity is not null")

    def cut(which: Column) -> Column:
        return F.percentile_approx(F.when(which, F.col("perplexity")), quantile, 10_000)

    held, anyone = F.col("held_out"), F.lit(True)
    by_lang = judges.groupBy(lang.alias("l")).agg(F.count_if(held).alias("n"), cut(held).alias("own")).filter(F.col("n") >= LEAST).select("l", "own")
    overall = judges.agg(F.when(F.count_if(held) >= LEAST, cut(held)).otherwise(cut(anyone)).alias("overall"))
    # a written table: Spark knows its size and broadcasts it below its threshold; beyond, a skewed language is split by the adaptive join
    out = scored.withColumn("l", lang).join(durable(by_lang, "kn-languages"), "l", "left").crossJoin(F.broadcast(overall))  # one row
    out = out.withColumn("threshold", F.coalesce("own", "overall"))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).drop("l", "own", "overall")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    if labels.count() <= BROADCAST_ROWS:
        labels = F.broadcast(labels)
    scored = durable(score_kneser_ney(docs.join(labels, "doc_id", "left"), F.col("good")), "kn-scored")
    out = classify(scored)
    return out.select("doc_id", "lang", "trusted", "held_out", F.col("n_symbols").alias("n_bytes"), F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")
