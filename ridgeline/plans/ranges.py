"""Orders over all rows without a task that sees them all: rows are dealt by ranges, handled in each, and each range adds what lies before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.plans.cache import cut


def numbered_by(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the row's place, from 1, in an order over all rows. Ties must not be left: they could come in any order."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__i").alias("__f"))  # a row for each range
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", "__f", before.alias("__b"))
    # row numbers within a partition follow each other, in its order
    return dealt.join(starts, "__p").select(*df.columns, (F.col("__i") - F.col("__f") + F.col("__b") + 1).cast("int").alias(name))


def running_sum(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the same `by` up to this one, in an order without ties."""
    dealt = cut(df.repartitionByRange(by, order).withColumn("__p", F.spark_partition_id()))
    parts = dealt.groupBy(by, "__p").agg(F.sum(value).alias("__s"))  # at most groups + ranges rows
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.select(F.col(by).alias("__by"), F.col("__p").alias("__q"), before.alias("__b"))
    within = F.sum(value).over(Window.partitionBy("__p", by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt.withColumn("__r", within).join(parts, (F.col("__p") == F.col("__q")) & (F.col(by) == F.col("__by")))
    return rows.select(*df.columns, (F.col("__r") + F.col("__b")).alias(name))
