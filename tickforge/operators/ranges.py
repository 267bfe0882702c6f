"""Running sums and neighbours in a total order without a task that sees all rows.

Rows are dealt by ranges of the order and written once (so that ranges do not
change between the passes); what a range brings from those before is a table of
at most one row a range, whose number is ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """``df`` as a written table with ``_part``, the number of the row's range; equal rows in ``order`` share one."""
    from tickforge.sources.lake import scratch

    spark = df.sparkSession
    path = scratch(spark, "ranges")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(path)


def running_sums(df: DataFrame, order: list[str], *columns: str) -> DataFrame:
    """``df`` with ``<column>_upto``, the sum of the column up to and with the row, for each of ``columns``."""
    rows = dealt(df, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in columns)).select("_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(c).over(inside).alias(f"{c}_upto") for c in columns)).join(F.broadcast(carried), "_part")
    return out.select(*df.columns, *((F.col(f"{c}_upto") + F.col(f"_{c}")).alias(f"{c}_upto") for c in columns))


def with_previous(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in ``order``, null for the first."""
    rows = dealt(df, order)
    last = rows.groupBy("_part").agg(F.max_by(F.struct(value), order).alias("_last"))
    carried = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    inside = F.lag(F.struct(value)).over(Window.partitionBy("_part").orderBy(order))
    out = rows.withColumn("_inside", inside).join(F.broadcast(carried), "_part")
    return out.select(*df.columns, F.coalesce("_inside", "_carried").getField(value).alias(name))
