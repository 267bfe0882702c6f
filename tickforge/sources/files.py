"""Typed readers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.numeric import truthy

BARS = "timestamp long, symbol string, open double, high double, low double, close double, volume long"


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a cell that does not fit its type is an error."""
    return spark.read.schema(BARS).option("header", True).option("mode", "FAILFAST").csv(path)


def parquet_bars(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet files as one table, only the bar columns."""
    return spark.read.schema(BARS).parquet(*paths)


def hive_bars(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """``ticker=*/year=*`` folders; a year filter prunes folders."""
    out = spark.read.option("basePath", root).parquet(root)
    return out if years is None else out.filter(F.col("year").isin(years))


def must(value: Column, raw: Column, what: str) -> Column:
    """``value``, or an error where it is null although ``raw`` is not."""
    return F.when(raw.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), raw.cast("string")))).otherwise(value)


def reference_rows(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as typed ones: ``boolean`` tolerantly, ``long`` also from integral decimals, ``map`` from JSON."""
    out = {}
    for name, kind in kinds.items():
        raw = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        if kind == "boolean":
            out[name] = must(truthy(raw), raw, name)
        elif kind == "long":
            number = raw.try_cast("double")
            out[name] = must(F.when(number == F.floor(number), number.cast("long")), raw, name)
        elif kind == "map":
            out[name] = must(F.from_json(raw, "map<string,double>"), raw, name)
        else:
            out[name] = must(raw.try_cast(kind), raw, name)
    return rows.withColumns(out)


def calendar(rows: DataFrame) -> DataFrame:
    """Open days of ``date, is_open``."""
    return rows.select(F.to_date("date").alias("date"), truthy(F.col("is_open").cast("string")).alias("is_open")).filter("is_open").select("date").distinct()


def discover(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Files under a folder, in order of path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length").orderBy("path")
