"""A full order with places."""

from pyspark.sql import functions as F

from redactory.operators.dedup import batches
from redactory.operators.order import placed
from redactory.plans import relational

SF = "/root/testdata/sf0.001"


def test_full_order(spark):
    rows = sorted(relational.sort_desc_all(spark, SF).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > relational.sort_desc(spark, SF).count()
    assert [(r.cents, r.o_custkey) for r in rows] == sorted(((r.cents, r.o_custkey) for r in rows), key=lambda x: (-x[0], x[1]))
    assert len(rows) == spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()


def test_places_and_batches_without_groups(spark):
    df = spark.createDataFrame([(x * 37 % 1000, None if x % 10 == 0 else x % 5) for x in range(1000)], "id int, v int").repartition(5)
    true = sorted(df.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.id))
    got = sorted(placed(df, F.col("v").desc_nulls_last(), "id").collect(), key=lambda r: r.place)
    assert [(r.id, r.v, r.place) for r in got] == [(r.id, r.v, i + 1) for i, r in enumerate(true)]
    assert sorted((r.id, r.batch) for r in batches(df, 7, ["id"]).collect()) == [(i, i // 7) for i in range(1000)]
    assert batches(df.where("false"), 7, ["id"]).collect() == []
