"""Relational and telemetry queries over the star schema and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import statistics
from ..operators.stores import size_columns
from ..streaming import ingest
from .tables import table


def dated_top(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("n"), "day").limit(5)


def global_aggregates(spark, d):
    l = table(spark, d, "lineitem")
    middle = statistics.percentiles(l.withColumn("all", F.lit(0)), "all", "l_quantity", [0.5]).select(F.round("p0", 6).alias("middle"))
    whole = l.agg(F.round(F.sum("l_quantity"), 4).alias("total"), F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.max("l_discount").alias("most"), F.min("l_tax").alias("least"), F.count("*").alias("n"))
    return whole.crossJoin(F.broadcast(middle))  # one row beside one row


def grouped(method: str, group: str, field: str):
    """Parametric aggregate: any of min, max, avg, count."""
    def run(spark, d):
        l = table(spark, d, "lineitem").withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
        value = getattr(F, method)(field)
        return l.groupBy(group).agg((F.round(value, 6) if method == "avg" else value).alias("value"))

    return run


def arg_max(spark, d):
    by_flag = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return by_flag.orderBy(F.desc("q"), F.desc("l_returnflag")).limit(1).select("l_returnflag", F.round("q", 4).alias("q"))


def wide_sums(spark, d):
    s = table(spark, d, "lineitem").agg(*[F.sum(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return s.unpivot([], ["l_quantity", "l_discount", "l_tax"], "name", "total").select("name", F.round("total", 4).alias("total"))


def ratios(spark, d):
    o = table(spark, d, "orders")
    late = F.avg((F.col("o_orderstatus") == "F").cast("double")) * 100
    return o.groupBy("o_orderpriority").agg(F.round(late, 4).alias("finished_percent"), F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("per_order"))


def distinct_values(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def null_audit(spark, d):
    o = table(spark, d, "documents")
    nulls = o.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in ("text", "lang", "source")], F.count("*").alias("n"))
    return nulls.crossJoin(o.select(F.md5("text").alias("h"), F.length("text").alias("chars"), "lang", "source").distinct().agg(F.count("*").alias("distinct_rows"))).withColumn("duplicates", F.col("n") - F.col("distinct_rows"))


def left_dimension(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


def inner_dimension(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.sum("spent"), 2).alias("spent"), F.count("*").alias("customers"))


def three_way(spark, d):
    """Revenue by region: filters and columns reach the scans."""
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def last_kept(spark, d):
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return last.select("o_custkey", F.col("last.o_orderkey").alias("o_orderkey"))


def clamped(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.lit(0.0)).otherwise(F.col("s_acctbal")).alias("balance"))


def dates(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias("day"), F.try_to_timestamp(F.lit("not a date")).isNull().alias("bad_is_null"))


def range_filter(spark, d):
    l = table(spark, d, "lineitem")
    return l.filter(F.col("l_quantity").between(10, 20) & (F.col("l_returnflag") != "R") & (F.col("l_discount") >= 0.02) & (F.col("l_discount") <= 0.06)).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 1.609344, 4).alias("derived"))


def category_filter(spark, d, category: str = "BUILDING"):
    """A category, or all of them."""
    c = table(spark, d, "customer")
    return c.filter((F.lit(category) == "ALL") | (F.col("c_mktsegment") == category)).select("c_custkey")


def updated(spark, d):
    p = table(spark, d, "part")
    hit = F.col("p_partkey") == 7
    return p.select("p_partkey", F.when(hit, F.lit("renamed")).otherwise(F.col("p_name")).alias("p_name"), F.when(hit, F.lit(1)).otherwise(F.col("p_size")).alias("p_size"))


def deleted(spark, d):
    return table(spark, d, "part").filter("p_partkey <> 7").select("p_partkey")


def raster(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy(F.floor(F.col("l_quantity") / 5).alias("x"), F.floor(F.col("l_extendedprice") / 10000).alias("y")).agg(F.count("*").alias("n"))


def histogram(spark, d):
    e = table(spark, d, "events")
    b = F.when(F.col("value") < 10, "a <10").when(F.col("value") < 50, "b <50").when(F.col("value") < 100, "c <100").otherwise("d 100+")
    return e.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def latency(spark, d):
    e = table(spark, d, "events")
    p = statistics.percentiles(e, "event_type", "value", [0.5, 0.95, 0.99])
    rest = e.groupBy("event_type").agg(F.avg("value").alias("mean"), (F.count("*") / F.greatest(F.sum("value"), F.lit(1e-9))).alias("rate"))
    return rest.join(p, F.col("event_type").eqNullSafe(F.col("group")), "left").select("event_type", F.round("mean", 3).alias("mean"), *[F.round(f"p{i}", 3).alias(f"p{q}") for i, q in enumerate((50, 95, 99))], F.round("rate", 6).alias("rate"))


def floor_rank(spark, d):
    """The value at place floor(n q), from 0, in ascending order."""
    return statistics.at_floor_rank(table(spark, d, "events"), "event_type", "value", 0.95).select(F.col("group").alias("event_type"), F.col("value").alias("p95"))


def rollup(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("queries"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").cast("string").alias("start"), "queries", "mean", "users")


def tumbling(spark, d):
    return ingest.tumbling(table(spark, d, "events"), "6 hours").withColumn("start", F.col("start").cast("string"))


def sliding(spark, d):
    return ingest.tumbling(table(spark, d, "events"), "12 hours", "6 hours").withColumn("start", F.col("start").cast("string"))


def sessions(spark, d):
    return ingest.sessions(table(spark, d, "events"), "2 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def plateau(spark, d):
    """First step of each user at which the running best gained less than epsilon in three steps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("step"), F.min("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"))
    gain = F.lag("best", 3).over(Window.partitionBy("user_id").orderBy("step")) - F.col("best")
    return e.withColumn("gain", gain).filter((F.col("gain") < 1e-4) & (F.col("step") >= 5)).groupBy("user_id").agg(F.min("step").alias("step"))


def history(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_type", "event_id", F.row_number().over(w).alias("r")).filter("r <= 20").select("event_type", "event_id")


def props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


def batches(spark, d):
    from ..operators.dedup import numbered

    o = numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "rn")
    return o.groupBy(F.floor(F.col("rn") / 512).alias("batch")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def set_operations(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    tag = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("operation"), "n")
    return tag(a.intersect(b), "intersect").unionByName(tag(b.exceptAll(a), "except")).unionByName(tag(a.unionByName(b), "union_all")).unionByName(tag(a.union(b).distinct(), "union"))


def sql_surface(spark, d):
    """A parameterised statement over a file."""
    return spark.sql(f"SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM parquet.`{d}/orders.parquet` WHERE o_totalprice > :least GROUP BY o_orderstatus", args={"least": 1000.0})


def renamed(spark, d):
    """Columns under other names, with a value for what is missing."""
    p = table(spark, d, "part").withColumnsRenamed({"p_partkey": "key", "p_brand": "maker"})
    return p.select("key", "maker", F.coalesce(F.col("p_size").cast("double"), F.lit(500.0)).alias("size"))


def named_columns(spark, d):
    """Columns chosen by a part of their name."""
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", *statistics.column_like(l.columns, "price"))


def sizes(spark, d):
    """What vectors of 384 values would take for each language's documents, as floats and as codes."""
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("vectors"))
    return n.select("lang", "vectors", *size_columns(F.col("vectors") * 384))


def budgeted(spark, d):
    """Up to forty orders of each priority, in order of priority, a hundred in all."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    own = o.withColumn("place", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))).filter("place <= 40")
    return own.orderBy("o_orderpriority", "o_orderkey").limit(100).select("o_orderpriority", "o_orderkey")


def half_even(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy(F.bround(F.col("l_quantity") / 4, 1).alias("quarter")).agg(F.count("*").alias("n"))


def _grouped_sql(expression: str, group: str) -> str:
    return f"SELECT {group}, {expression} AS value FROM (SELECT *, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month FROM lineitem) GROUP BY {group}"


QUERIES = {
    "date_group_topn": (dated_top, "SELECT ts::DATE AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 5"),
    "global_aggregates": (global_aggregates, "SELECT round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 6) AS mean, max(l_discount) AS most, min(l_tax) AS least, round(median(l_quantity), 6) AS middle, count(*) AS n FROM lineitem"),
    "group_dynamic_avg": (grouped("avg", "l_returnflag", "l_quantity"), _grouped_sql("round(avg(l_quantity), 6)", "l_returnflag")),
    "group_dynamic_max": (grouped("max", "year", "l_extendedprice"), _grouped_sql("max(l_extendedprice)", "year")),
    "group_dynamic_min": (grouped("min", "month", "l_extendedprice"), _grouped_sql("min(l_extendedprice)", "month")),
    "group_dynamic_count": (grouped("count", "l_linestatus", "l_tax"), _grouped_sql("count(l_tax)", "l_linestatus")),
    "group_argmax": (arg_max, "SELECT l_returnflag, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY 1 ORDER BY q DESC, l_returnflag DESC LIMIT 1"),
    "wide_sum_argmax": (wide_sums, "SELECT 'l_quantity' AS name, round(sum(l_quantity), 4) AS total FROM lineitem UNION ALL SELECT 'l_discount', round(sum(l_discount), 4) FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_tax), 4) FROM lineitem"),
    "ratio_metrics": (ratios, "SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT) * 100, 4) AS finished_percent, round(sum(o_totalprice) / count(*), 4) AS per_order FROM orders GROUP BY 1"),
    "distinct_values": (distinct_values, "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "null_audit": (null_audit, "SELECT sum((text IS NULL)::INT)::BIGINT AS text, sum((lang IS NULL)::INT)::BIGINT AS lang, sum((source IS NULL)::INT)::BIGINT AS source, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS duplicates FROM documents"),
    "dim_join_left": (left_dimension, "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name"),
    "dim_join_inner": (inner_dimension, "SELECT c_mktsegment, round(sum(spent), 2) AS spent, count(*) AS customers FROM (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "star_join_revenue": (three_way, "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1"),
    "keep_last_dedupe": (last_kept, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "clamp_negative": (clamped, "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS balance FROM supplier"),
    "cast_dates": (dates, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, try_cast('not a date' AS TIMESTAMP) IS NULL AS bad_is_null FROM orders"),
    "range_filter_derived": (range_filter, "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 1.609344, 4) AS derived FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag <> 'R' AND l_discount >= 0.02 AND l_discount <= 0.06"),
    "category_filter": (category_filter, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "crud_update": (updated, "SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'renamed' ELSE p_name END AS p_name, CASE WHEN p_partkey = 7 THEN 1 ELSE p_size END AS p_size FROM part"),
    "crud_delete": (deleted, "SELECT p_partkey FROM part WHERE p_partkey <> 7"),
    "raster_bins": (raster, "SELECT floor(l_quantity / 5)::BIGINT AS x, floor(l_extendedprice / 10000)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY ALL"),
    "fixed_histogram": (histogram, "SELECT CASE WHEN value < 10 THEN 'a <10' WHEN value < 50 THEN 'b <50' WHEN value < 100 THEN 'c <100' ELSE 'd 100+' END AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "latency_percentiles": (latency, "SELECT event_type, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(quantile_cont(value, 0.99), 3) AS p99, round(count(*) / greatest(sum(value), 1e-9), 6) AS rate FROM events GROUP BY 1"),
    "latency_floor_rank": (floor_rank, "SELECT event_type, value AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = floor(n * 0.95)"),
    "telemetry_rollup": (rollup, "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS queries, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "tumbling_windows": (tumbling, "SELECT strftime(to_timestamp(floor(epoch(ts) / 21600) * 21600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "sliding_windows": (sliding, "SELECT strftime(to_timestamp(floor(epoch(ts) / 21600) * 21600 - k * 21600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) t(k) GROUP BY ALL"),
    "session_windows": (sessions, "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS t, count(*) AS n FROM g GROUP BY user_id, g"),
    "plateau_detection": (plateau, "WITH b AS (SELECT user_id, row_number() OVER w AS step, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, lag(best, 3) OVER (PARTITION BY user_id ORDER BY step) - best AS gain FROM b) SELECT user_id, min(step)::INT AS step FROM g WHERE gain < 1e-4 AND step >= 5 GROUP BY user_id"),
    "bounded_history": (history, "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20"),
    "json_props_extract": (props, "SELECT event_id, (props->>'$.k')::INT AS k FROM events"),
    "fixed_batches": (batches, "SELECT (rn // 512)::BIGINT AS batch, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY 1"),
    "renamed_columns": (renamed, "SELECT p_partkey AS key, p_brand AS maker, coalesce(p_size::DOUBLE, 500.0) AS size FROM part"),
    "named_columns": (named_columns, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem"),
    "size_formulae": (sizes, "SELECT lang, n AS vectors, round(n * 384 * 4 / 1048576, 2) AS raw_float32_size_mb, round(n * 384 / 1048576, 2) AS quantized_size_mb, 75.0 AS ram_saving_percent FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)"),
    "budgeted_limit": (budgeted, "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 40 ORDER BY o_orderpriority, o_orderkey LIMIT 100"),
    "half_even_rounding": (half_even, "SELECT round_even(l_quantity / 4, 1) AS quarter, count(*) AS n FROM lineitem GROUP BY 1"),
    "anti_join": (anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "set_operations": (
        set_operations,
        "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT 'intersect' AS operation, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n UNION ALL SELECT 'except', (SELECT count(*) FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)) UNION ALL SELECT 'union_all', (SELECT count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)) UNION ALL SELECT 'union', (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b))",
    ),
    "sql_parameterised": (sql_surface, "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_totalprice > 1000 GROUP BY 1"),
}
QUERIES["session_windows"] = (sessions, QUERIES["session_windows"][1].replace("min(ts) AS t", "strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start"))
