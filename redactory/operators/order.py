"""Places of rows in a full order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folders import scratch

#: Spark's row ids hold the task above this many bits and the row's place in it below.
ROW_BITS = 33


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """All rows with ``name`` (bigint from 1): their place in ``order``.

    One shuffle: rows are dealt out by ranges of the order and sorted, and a row's number
    in its range is added to the counts of the ranges before, a row for each range. The
    sorted ranges are a table in the shared folder, as a second run could draw others.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id"))
    path = scratch(spark, "order")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).withColumn("part", F.shiftright("id", ROW_BITS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return dealt.join(F.broadcast(counts), "part").select("row.*", (F.col("before") + inside + 1).cast("bigint").alias(name))
