"""The dedup window in batches against a fold by hand, with hot keys divided among tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactory.operators import dedup

SCHEMA = "a string, b int, t long, id long, row string"


def by_hand(rows, window):
    last, out = {}, []
    for a, b, t, i, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        if t is None or (a, b) not in last or t - last[a, b] >= window:
            out.append(i)
            if t is not None:
                last[a, b] = t
    return sorted(out)


@pytest.mark.parametrize(("window", "spread", "n"), [(10, 30_000, 4000), (7, 2500, 3000), (50, 400_000, 3000), (1, 300, 500)])
@pytest.mark.parametrize("hot", [10, 10**6])
def test_against_a_fold_by_hand(spark, window, spread, n, hot):
    """Sparse and dense keys, ties, keys and times that are null, times before 0, and a gap of many chunks."""
    rng = np.random.default_rng(window)
    keys = [("x", 1), ("x", None), (None, 1), ("rare", 2)]
    rows = [(*keys[min(3, int(rng.integers(0, 60)) % 20)], int(t), i, "r") for i, t in enumerate(rng.integers(-spread, spread, n))]
    rows += [("x", 1, spread * 50 + i, n + i, "r") for i in range(3 * window)] + [("x", 1, None, 10**6, "r"), ("rare", 2, None, 10**6 + 1, "r"), ("x", 1, rows[0][2], 10**6 + 2, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = dedup.in_window(df, ["a", "b"], "t", window, ["id"], hot_rows=hot)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == by_hand(rows, window)


def test_one_key_with_all_rows_is_spread_over_tasks(spark):
    rows = spark.range(60_000).select(F.lit("k").alias("a"), (F.col("id") * 3).alias("t"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be one task
    try:
        got = dedup.in_window(rows, ["a"], "t", 30, ["id"], hot_rows=1000)
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 6000 and len(sizes) >= 4 and max(sizes) < 3000


def test_empty_and_first_only(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup.in_window(none, ["a", "b"], "t", 5, ["id"]).count() == 0
    rows = [("x", None, 5, 1, "r"), ("x", None, 5, 0, "r"), ("y", 1, 7, 2, None), ("y", 1, None, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.id for r in dedup.first_only(df, ["a", "b"], "t", ["id"]).collect()) == [0, 3]
