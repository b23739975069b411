"""Dense numbers against row_number where tables are wide and have many partitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from vecflow.operators.dedup import numbered


@pytest.mark.parametrize("partitions", [4, 64, 200])
def test_numbers_of_a_wide_table(spark, partitions):
    n = 1_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        key = (F.xxhash64("id") % 1_000_000_007).alias("key")
        rows = spark.range(n).select(key, F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide"), (F.col("id") % 3).alias("part"))
        got = numbered(rows, "key", "number").select("key", "number", F.length("wide").alias("width"), "part")
        total = got.agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number"), F.sum("width")).first()
        assert tuple(total) == (n, n, 0, n - 1, 128 * n)
        out_of_order = got.withColumn("earlier", F.lag("key").over(Window.partitionBy(F.floor(F.col("number") / 10_000)).orderBy("number"))).filter("earlier > key")
        assert out_of_order.count() == 0
        edges = got.filter("number % 10000 in (0, 9999)").orderBy("number").select("key").collect()
        assert [r.key for r in edges] == sorted(r.key for r in edges)
        inner = numbered(rows, "key", "number", "part")
        want = rows.withColumn("number", F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1).select("part", "number", "key", "wide")
        digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("part", F.col("number").cast("long"), "key", "wide").cast("decimal(38,0)"))).first()
        assert digest(inner) == digest(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_of_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a"), (2, None), (2, "a"), (1, None), (None, None)], "key int, part string")
    got = numbered(rows, "key", "number").collect()
    assert sorted(r.number for r in got) == [0, 1, 2, 3, 4] and {r.number for r in got if r.key is None} == {0, 1}
    assert sorted((r.part or "", r.number) for r in numbered(rows, "key", "number", "part").collect()) == [("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1)]
    assert numbered(rows.filter("false"), "key", "number").count() == 0
