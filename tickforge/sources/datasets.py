"""Datasets for models: predictions in, enriched bars and windows of features out."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp, symbol, score`` of a folder; a key that occurs twice or a number that is not finite is an error."""
    rows = spark.read.schema("timestamp long, symbol string, score double").parquet(path)
    keys = rows.groupBy("timestamp", "symbol").agg(F.count("*").alias("n"), F.count_if(~finite(F.col("score"))).alias("bad"))
    found = keys.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("bad") > 0).alias("not_finite")).first()
    if found.repeated or found.not_finite:
        raise ValueError(f"{path}: {found.repeated} repeated keys, {found.not_finite} with numbers that are not finite")
    return rows


_HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def folder(column: str, value: object) -> str:
    """The folder that Spark gives a partition's value."""
    text = "" if value is None else str(value)
    return f"{column}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', text) or _HIVE_NULL}"


_REPORT = pa.schema([("symbol", pa.string()), ("year", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("unknown", pa.int64()), ("attempt", pa.int64())])


def _report(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _REPORT.types)], schema=_REPORT)


def _write_files(base: str):
    """Writes rows in order of symbol and timestamp to a file a symbol and year below ``base``/attempt, and returns a row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        writer, done = None, []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                symbol, year, timestamp, known = (batch.column(c) for c in ("symbol", "year", "timestamp", "_known"))
                codes = [x.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in (symbol, year)]
                cuts = np.flatnonzero(np.logical_or(*(np.diff(x) != 0 for x in codes))) + 1
                data = pa.Table.from_batches([batch]).drop_columns(["symbol", "year"])
                for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
                    key = [symbol[lo].as_py(), year[lo].as_py()]
                    if writer is None or done[-1][:2] != key:
                        if writer is not None:
                            writer.close()
                        path = f"{base}/{attempt}/{folder('symbol', key[0])}/{folder('year', key[1])}"
                        os.makedirs(path)
                        # most files are small: dictionaries cost a quarter of the time, and zstd sees repeated values anyway
                        writer = pq.ParquetWriter(f"{path}/part.parquet", data.schema, compression="zstd", use_dictionary=False)
                        done.append([*key, 0, timestamp[lo].as_py(), None, 0, attempt])
                    writer.write_table(data.slice(lo, hi - lo))
                    row = done[-1]
                    row[2] += hi - lo
                    row[4] = timestamp[hi - 1].as_py()
                    row[5] += known.slice(lo, hi - lo).null_count
                if len(done) > 1:
                    yield _report(done[:-1])
                    done = done[-1:]
        finally:
            if writer is not None:
                writer.close()
        if done:
            yield _report(done)

    return run


def _write_local(rows: DataFrame, stage: str) -> DataFrame:
    """The files and their report, written by Python workers: Spark's own writer starts ``chmod`` twice for each file of a local or mounted folder.

    A task writes below its attempt's folder; only attempts whose rows came
    through to the report are moved to their place.
    """
    spark = rows.sparkSession
    base = f"{stage}/_temporary"
    # a stated number of partitions: files cost time, not bytes, so they must not be merged by size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.repartition(n, "symbol").sortWithinPartitions("symbol", "timestamp")
    kinds = "symbol string, year int, n long, first long, last long, unknown long, attempt long"
    keyed.mapInArrow(_write_files(_path(spark, base).toUri().getPath()), kinds).write.parquet(f"{base}/report")
    report = spark.read.schema(kinds).parquet(f"{base}/report")
    here = _path(spark, stage).toUri().getPath()
    os.mkdir(f"{here}/rows")
    for (attempt,) in report.select("attempt").distinct().collect():
        for name in os.listdir(f"{here}/_temporary/{attempt}"):
            os.rename(f"{here}/_temporary/{attempt}/{name}", f"{here}/rows/{name}")
    return report.drop("attempt")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def write_enriched(bars: DataFrame, reference: DataFrame, root: str) -> DataFrame:
    """Bars with the previous close and the columns of ``reference`` (by symbol), a folder a symbol and year, and a report.

    Files are written beside the target, which is then renamed: readers see all
    of it or nothing.  The report has a row a symbol and year: rows, first and
    last timestamp, rows without a reference.
    """
    spark = bars.sparkSession
    w = Window.partitionBy("symbol").orderBy("timestamp")
    year = F.year(F.timestamp_seconds(F.col("timestamp") / 1_000_000_000))
    rows = bars.withColumns({"previous_close": F.lag("close").over(w), "year": year}).join(reference.withColumn("_known", F.lit(True)), "symbol", "left")
    rows = rows.withColumn("symbol", F.expr("nullif(symbol, '')"))  # one folder
    stage = f"{root.rstrip('/')}-{uuid.uuid4().hex}"
    files = _path(spark, stage).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getScheme() == "file":
        report = _write_local(rows, stage)
    else:
        rows.repartition("symbol", "year").sortWithinPartitions("symbol", "year", "timestamp").write.option("compression", "zstd").partitionBy("symbol", "year").parquet(f"{stage}/rows")
        kept = spark.read.option("basePath", f"{stage}/rows").schema(rows.schema).parquet(f"{stage}/rows")
        report = kept.groupBy("symbol", "year").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    report.write.parquet(f"{stage}/report")
    files.delete(_path(spark, f"{stage}/_temporary"), True)
    if not files.rename(_path(spark, stage), _path(spark, root)):
        raise RuntimeError(f"{root} exists: an enriched dataset is written once")
    return spark.read.parquet(f"{root}/report")


def windows(rows: DataFrame, columns: list[str], length: int, label: str) -> DataFrame:
    """``timestamp, symbol, features, label``: the last ``length`` rows of a symbol as one array a row, oldest first; shorter histories are left out."""
    before = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(1 - length, 0)
    items = F.collect_list(F.array(*columns)).over(before)
    return rows.select("timestamp", "symbol", items.alias("features"), F.col(label).alias("label")).filter((F.size("features") == length) & F.col("label").isNotNull())
