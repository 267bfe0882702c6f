"""Documents to training sequences in five stages, each an operator of ``tickforge.llm``.

Every stage takes the documents that the stage before kept and, but for the
last, returns documents with the columns it was given.  Stage results are
written as Parquet and read again, so a stage's own intermediate tables can go
when the next one begins, and a stage's result when the next one is written.

In every stage null texts count as empty (quality rules reject them), rows with a
null id stay, rows that share an id are judged by themselves (near-duplicates: as
one document), and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.decontaminate import decontaminate
from tickforge.llm.jaccard import jaccard_components
from tickforge.llm.packing import pack_documents
from tickforge.llm.quality import cascade
from tickforge.llm.storage import discard, durable, remove, written
from tickforge.llm.substring import dedup_substrings

#: By application, the tables of the stage that ran last; its result has been written when the next one begins.
_before: dict[str, list[str]] = {}


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark)
        with written() as paths:
            out = fn(spark, docs, sf_dir)
        _before[spark.sparkContext.applicationId] = paths
        return out

    run.__doc__ = fn.__doc__
    return run


def _clear(spark: SparkSession) -> None:
    """Delete what the stage before has written for itself."""
    remove(spark, _before.pop(spark.sparkContext.applicationId, []))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return cascade(docs).filter("kept").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; documents without an id stay."""
    groups = jaccard_components(docs)
    gone = durable(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeat passages of documents with smaller ids; ``n_chars`` follows."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = dedup_substrings(docs, keep=rest).withColumn("text", F.col("kept_text"))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("not contaminated").select(*docs.columns)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed_sequences),
]

#: Tokenization has no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[DataFrame] = []
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(*last)  # the next stage reads what this one has written
        last = [docs]
    _clear(spark)
    return docs
