"""Counts, histograms and percentiles over events, findings and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folders import scratch

#: Marks stand this share of a group's rows from a percentile, more than the error of their sketch (1 / ``ACCURACY``).
MARGIN, ACCURACY = 0.001, 10_000
#: Groups whose marks may be broadcast.
BROADCAST_GROUPS = 100_000

#: Upper bounds of the histograms' buckets.
BUCKETS = {
    "scan_duration_seconds": [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1],
    "batch_size": [1.0, 5.0, 10.0, 50.0, 100.0, 250.0, 500.0, 1000.0],
    "dispatch_duration_seconds": [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0],
    "rule_scan_duration_seconds": [0.000001, 0.000005, 0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01],
    "phase_scan_duration_seconds": [0.000001, 0.00001, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05],
}


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """``(by..., le, n)``: cumulative counts by upper bound, ``+Inf`` last; one partial aggregation."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*by).agg(*sums, F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return one.select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.n")


def percentiles(df: DataFrame, value: str, percents: list[int], *by: str) -> DataFrame:
    """``(by..., p, value)``: the item at ``floor(n * p / 100)`` from 0 in order, at most the last. Exact; values are numbers, dates or times.

    Mergeable sketches give marks on both sides of each percentile; rows are counted
    between marks and on them, and only the part that holds the wanted item is sorted.
    However good the marks are, the parts keep the order, so that the item is the same.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0))
    rows = df.where(F.col(value).isNotNull()).select(key.alias("key"), F.col(value).alias("value"))
    near = sorted({min(1.0, max(0.0, p / 100 + d)) for p in percents for d in (-MARGIN, MARGIN)})
    path = scratch(df.sparkSession, "percentiles")
    marks = rows.groupBy("key").agg(F.percentile_approx("value", near, ACCURACY).alias("marks"))
    marks.write.parquet(path)
    marks = df.sparkSession.read.schema(marks.schema).parquet(path)
    small = F.broadcast if marks.count() <= BROADCAST_GROUPS else lambda x: x

    mark = [F.element_at("marks", i + 1) for i in range(len(near))]
    part = sum(((F.col("value") >= m).cast("int") + (F.col("value") > m).cast("int") for m in mark), F.lit(0))
    parts = rows.join(small(marks), "key").select("key", "value", part.alias("part"))
    of_key = Window.partitionBy("key")
    counts = parts.groupBy("key", "part").count().withColumns({"n": F.sum("count").over(of_key), "before": F.sum("count").over(of_key.orderBy("part")) - F.col("count")})
    wanted = counts.select("*", F.explode(F.array(*map(F.lit, percents))).alias("p")).withColumn("at", F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1) - F.col("before"))
    wanted = wanted.where("at >= 0 AND at < count").groupBy("key", "part").agg(F.collect_list(F.struct("p", "at")).alias("wanted"))

    values = parts.join(small(wanted), ["key", "part"]).groupBy("key", "part", "value").agg(F.count("*").alias("same"), F.first("wanted").alias("wanted"))
    upto = F.sum("same").over(Window.partitionBy("key", "part").orderBy("value"))
    found = values.withColumn("upto", upto).select("key", "value", "upto", "same", F.explode("wanted").alias("w")).where("w.at < upto AND w.at >= upto - same")
    return found.select(*[F.col("key")[b].alias(b) for b in by], "w.p", "value")


def gravest(df: DataFrame, *by: str) -> DataFrame:
    """The gravest severity of each group."""
    from ..functions.text import severity_rank

    return df.groupBy(*by).agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"))


def exposition(df: DataFrame, name: str, labels: list[str], value: str = "n") -> DataFrame:
    """Lines of the text format that metric collectors read; ``streaming/server.py`` writes the lines that describe a metric."""
    safe = lambda x: F.replace(F.regexp_replace(F.col(x).cast("string"), r'([\\"])', r"\\$1"), F.lit("\n"), F.lit("\\n"))
    said = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), safe(x), F.lit('"')) for x in labels])
    return df.select(F.concat(F.lit(f"{name}{{"), said, F.lit("} "), F.col(value).cast("string")).alias("line"))
