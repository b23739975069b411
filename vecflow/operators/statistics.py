"""Exact order statistics without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stored

#: Tables of up to so many rows are left to Spark's own aggregates, which hold a group's values.
SMALL = 1_000_000


def value_ranks(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n (its rows), before (the group's rows of smaller values), total: a row for each distinct
    value of each group, nulls left out.

    Rows of one value are counted before anything is sorted, so ties take no room. Distinct values are
    dealt out by ranges and written once; sums within a range and a small table of sums per range give
    each value its place. No task holds more than a range."""
    own = rows.select(F.col(group).alias("g_"), F.col(value).alias("v_")).filter("v_ is not null").groupBy("g_", "v_").agg(F.count("*").alias("n_"))
    dealt = stored(own.repartitionByRange("g_", "v_").sortWithinPartitions("g_", "v_").withColumn("range_", F.shiftright(F.monotonically_increasing_id(), 33)), "value_counts")
    sums = dealt.groupBy("g_", "range_").agg(F.sum("n_").alias("sum_"))
    of_group = Window.partitionBy("g_")
    sums = sums.select(F.col("g_").alias("of_"), F.col("range_").alias("in_"), (F.sum("sum_").over(of_group.orderBy("range_")) - F.col("sum_")).alias("start_"), F.sum("sum_").over(of_group).alias("total"))
    within = F.sum("n_").over(Window.partitionBy("g_", "range_").orderBy("v_")) - F.col("n_")
    met = dealt.withColumn("within_", within).join(sums, (F.col("range_") == F.col("in_")) & F.col("g_").eqNullSafe(F.col("of_")))
    return met.select(F.col("g_").alias("group"), F.col("v_").alias("value"), F.col("n_").alias("n"), (F.col("start_") + F.col("within_")).alias("before"), "total")


def percentiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group and a column p0, p1, .. for each share, linear between the two nearest ranks."""
    own = rows.select(F.col(group).alias("group"), F.col(value).alias("value")).filter("value is not null")
    if own.limit(SMALL + 1).count() <= SMALL:
        found = own.groupBy("group").agg(F.percentile("value", F.array(*map(F.lit, shares))).alias("p"))
        return found.select("group", *[F.col("p")[i].alias(f"p{i}") for i in range(len(shares))])
    ranks = value_ranks(own, "group", "value")
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    at = lambda place: F.max(F.when(holds(place), F.col("value")))
    columns = []
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("total") - 1)
        columns += [at(F.floor(place)).alias(f"a{i}"), at(F.ceil(place)).alias(f"b{i}"), F.first(place - F.floor(place)).alias(f"part{i}")]
    between = lambda i: F.when(F.col(f"part{i}") == 0, F.col(f"a{i}")).otherwise((1 - F.col(f"part{i}")) * F.col(f"a{i}") + F.col(f"part{i}") * F.col(f"b{i}"))
    return ranks.groupBy("group").agg(*columns).select("group", *[between(i).alias(f"p{i}") for i in range(len(shares))])


def at_floor_rank(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """group, value: the value at place floor(n * share), from 0, in ascending order."""
    own = rows.select(F.col(group).alias("group"), F.col(value).alias("value")).filter("value is not null")
    if own.limit(SMALL + 1).count() <= SMALL:
        sorted_ = own.groupBy("group").agg(F.sort_array(F.collect_list("value")).alias("v"))
        return sorted_.select("group", F.get("v", F.floor(F.size("v") * F.lit(float(share))).cast("int")).alias("value")).filter("value is not null")
    place = F.floor(F.col("total") * F.lit(float(share)))
    return value_ranks(own, "group", "value").filter((F.col("before") <= place) & (place < F.col("before") + F.col("n"))).select("group", "value")


def column_like(names: list[str], part: str) -> list[Column]:
    """The columns whose name holds a text, in any case."""
    return [F.col(c) for c in names if part.upper() in c.upper()]
