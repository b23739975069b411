"""Queries that write and read files: text formats, shards, vector and code stores, logs, artefacts."""

from __future__ import annotations

import itertools
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions import text as T
from ..functions import vector as V
from ..operators import dedup as D
from ..operators import search as S
from ..operators import stores
from ..sources import html, vecfiles
from ..workspace import stored, workdir
from .tables import query_set, table, vectors
from .vectors import CENTROIDS, EDGES, I8, NEAR, PARAMETERS, ROW_CODED, WITH

#: Nodes of a graph file at most, so that a file is small beside a task's memory.
GRAPH_NODES = 4096
LINES = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
EVENTS = "event_id long, user_id long, event_type string, value double"


def csv_typed(spark, d):
    """CSV files, as many as the rows need, read with declared types."""
    uri = workdir(spark, "csv")
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("timestamp").alias("l_shipdate")).repartition("l_orderkey").write.option("header", "true").csv(uri)
    lines = spark.read.schema(LINES).option("header", "true").csv(uri)
    return lines.filter("l_quantity >= 25").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def csv_to_parquet(spark, d):
    """A table converted once: the second call finds it."""
    source, target = workdir(spark, "csv"), workdir(spark, "converted")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", "true").csv(source)
    for _ in range(2):
        spark.read.schema("c_custkey long, c_mktsegment string, c_acctbal double").option("header", "true").csv(source).write.mode("ignore").parquet(target)
    return spark.read.parquet(target)


def ndjson(spark, d):
    uri = workdir(spark, "ndjson")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.json(uri)
    return spark.read.schema(EVENTS).json(uri).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _shards(spark, d):
    """Documents in two runs, the second of which goes on in the shard that the first left open."""
    writer = stores.ShardWriter(spark, workdir(spark, "shards"), "doc_id long, source string, n_chars long", 300)
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"))
    cut = docs.agg((F.min("doc_id") + F.floor(F.count("*") / 2)).alias("cut")).first()["cut"]
    for part in (docs.filter(F.col("doc_id") < cut), docs.filter(F.col("doc_id") >= cut)):
        writer.write(part, "doc_id")
    return writer


def shard_records(spark, d):
    return _shards(spark, d).rows()


def shard_manifest(spark, d):
    return _shards(spark, d).manifest().select("shard_id", "records")


def _store(spark, d):
    store = stores.VectorStore(spark, workdir(spark, "vectors"), 64)
    v = vectors(spark, d)
    for part in ("vec_id % 2 = 0", "vec_id % 2 = 1"):
        store.append(v.filter(part), "vec_id")
    return store


def store_slice(spark, d):
    return _store(spark, d).between(90, 130).select("idx", F.round(V.norm(F.col("v").cast("array<double>")), 4).alias("norm"))


def store_gather(spark, d):
    asked = spark.sql("SELECT pos, idx FROM VALUES (0, 7L), (1, 3L), (2, 7L), (3, 150L), (4, 99999999L) AS t(pos, idx)")
    return _store(spark, d).gather(asked).select("pos", "idx", F.round(V.norm(F.col("v").cast("array<double>")), 4).alias("norm"))


def _quantized(spark, d):
    store, v = stores.QuantizedStore(spark, workdir(spark, "codes")), vectors(spark, d)
    for part in ("vec_id % 3 <> 0", "vec_id % 3 = 0"):
        store.append(v.filter(part), "vec_id", fit_on=v)
    return store


def quantized_store(spark, d):
    return _quantized(spark, d).rows().select("vector_idx", F.col("id").alias("vec_id"), F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


def quantized_manifest(spark, d):
    return _quantized(spark, d).manifest()


def dequantized(spark, d):
    back = _quantized(spark, d).decoded()
    return back.select(F.col("id").alias("vec_id"), F.round(V.total(F.col("v")), 6).alias("total"))


def flat_matrix(spark, d):
    """Vectors as a flat matrix of eight-bit codes, read back with the type its size tells."""
    v, uri = vectors(spark, d), workdir(spark, "flat")
    codes = v.select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x * 40)))).alias("c"))
    vecfiles.write_flat(codes, uri, "vec_id", "c", "<i1")
    got = vecfiles.read_flat(spark, uri, 64, columns=(8, 24))
    return got.select(F.transform("values", lambda x: x.cast("int")).alias("c")).groupBy(F.aggregate("c", F.lit(0), lambda s, x: s + x).alias("total")).agg(F.count("*").alias("n"))


def positional_gather(spark, d):
    """The neighbours of each query row by position from a flat file: of every seventh row, the first again."""
    v, uri = D.numbered(vectors(spark, d).select("vec_id", "v"), "vec_id", "idx"), workdir(spark, "flat")
    vecfiles.write_flat(v, uri, "idx", "v")
    asked = v.filter("idx % 7 = 0").select(F.col("vec_id").alias("pos"), F.explode(F.array("idx", F.col("idx") + 3, "idx")).alias("idx"))
    got = vecfiles.gathered(asked, uri, 64)
    return got.groupBy("pos", "idx").agg(F.count("*").alias("n"), F.max(F.round(V.total(F.transform("v", lambda x: x.cast("double"))), 3)).alias("total"))


def concatenated(spark, d):
    """A corpus per language, physically behind each other."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    languages = [x["lang"] for x in docs.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    members = [docs.filter(F.col("lang").eqNullSafe(x)) for x in languages]
    return stores.merged(members, workdir(spark, "merged"))


def artefacts(spark, d):
    """An index saved and loaded: the list of each row comes from the folder it lies in."""
    v, uri = vectors(spark, d), workdir(spark, "index")
    c = S.centroids_by_label(v)
    stores.save_index(S.assigned(v, c).select("vec_id", "v", F.col("cids")[0].alias("cid")), c, uri)
    shards, _, router = stores.load_index(spark, uri)
    return router.join(shards.groupBy("cid").agg(F.sum("vec_id").alias("ids")), "cid", "left").select("cid", "n", "ids")


def query_log(spark, d):
    """A line for each of some queries, appended in two runs."""
    uri, at = workdir(spark, "log"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), F.lit(10).cast("long").alias("results"))
    for part in ("item_id % 2 = 0", "item_id % 2 = 1"):
        log = stores.log_queries(asked.filter(part), uri, at)
    return log.select("name", "results")


def crud_written(spark, d):
    """An update and a delete, each written as a new version; readers see the current one."""
    uri, p = workdir(spark, "parts"), table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    now = stores.replaced(p, uri)
    hit = F.col("p_partkey") == 7
    now = stores.replaced(now.withColumns({"p_name": F.when(hit, F.lit("renamed")).otherwise(F.col("p_name")), "p_size": F.when(hit, F.lit(1)).otherwise(F.col("p_size"))}), uri)
    return stores.replaced(now.filter("p_partkey <> 9"), uri)


def partials(spark, d):
    """Partial aggregates of each month, stored, and combined later without the rows."""
    parts = stored(table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month"), "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("most")), "partials")
    return parts.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.round(F.sum("q") / F.sum("n"), 6).alias("mean"), F.max("most").alias("most"))


def ivecs(spark, d):
    """True neighbours as integer records and back."""
    v = vectors(spark, d)
    truth = S.knn(query_set(v), v, 5).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    uri = workdir(spark, "ivecs")
    vecfiles.write_records(truth, uri, "query_id", "ids", "i")
    return vecfiles.read_records(spark, uri, "i").groupBy(F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids")).agg(F.count("*").alias("n"))


def fvecs(spark, d):
    """Vectors through binary record files, split by records, and back."""
    uri = workdir(spark, "fvecs")
    vecfiles.write_records(vectors(spark, d), uri, "vec_id", "v")
    back = vecfiles.read_records(spark, uri).withColumn("v", F.col("values").cast("array<double>"))
    return back.groupBy(F.size("v").alias("dimension")).agg(F.count("*").alias("n"), F.round(F.sum(V.norm(F.col("v"))), 3).alias("norms"))


def graph_file(spark, d):
    """The neighbour graph through its binary format, files of up to GRAPH_NODES nodes, and back."""
    import pyarrow as pa

    edges = S.neighbour_graph(vectors(spark, d), 8)
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("next"))
    uri = workdir(spark, "graph")

    def write(batches):
        from pyspark import TaskContext

        part, files = TaskContext.get().partitionId(), 0
        pieces = (b.slice(a, GRAPH_NODES).to_pylist() for b in batches for a in range(0, b.num_rows, GRAPH_NODES))
        for rows in itertools.chain(pieces, [[]]):
            if rows or not files:  # a task without nodes writes an empty file
                name = f"{uri}/part-{part:05d}-{files:05d}.graph"
                with vecfiles.written(name) as f:
                    f.write(vecfiles.encode_graph({"ids": [r["src"] for r in rows]}, [r["next"] for r in rows]))
                files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]})

    def read(batches):
        for raw in (x for b in batches for x in b.column(0)):
            header, neighbours = vecfiles.decode_graph(raw.as_py())
            pairs = [(i, j) for i, some in zip(header["ids"], neighbours) for j in some]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    lists.mapInArrow(write, "files long").collect()  # a row per task
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.graph").load(uri).select("content").mapInArrow(read, "src long, dst long")


def _feeds(spark, d):
    """Feeds of up to fifty pages each, as text."""
    item = F.format_string("<item><title>Page %d & more</title><link>%s</link><description><![CDATA[<b>about</b> %d]]></description></item>", "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[<&]", ""), "page_id")
    own = table(spark, d, "pages").select(F.floor(F.col("page_id") / 50).alias("feed"), F.struct("page_id", item.alias("item")).alias("item"))
    feeds = own.groupBy("feed").agg(F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda x: x["item"]), "").alias("items"))
    return feeds.select(F.concat(F.lit("feed-"), "feed").alias("feed_url"), F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("xml"))


def rss_feed_items(spark, d):
    return html.rss_items(_feeds(spark, d)).select("feed_url", "title", "link", "description")


def rss_articles(spark, d):
    """Items once per address, joined with their pages; only articles of at least thirty words."""
    items = html.rss_items(_feeds(spark, d)).groupBy("link").agg(F.min("title").alias("item_title"))
    pages = table(spark, d, "pages").withColumn("link", F.regexp_replace("url", "[<&]", "")).groupBy("link").agg(F.min_by("page_id", "page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    parsed = html.articles(pages.select("page_id", "html")).filter("token_count >= 30")
    met = items.join(pages.drop("html"), "link").join(parsed, "page_id")
    return met.select(F.concat(F.lit("news_"), T.short_hash(F.col("link"))).alias("news_id"), T.first_filled(F.col("title"), F.col("item_title")).alias("title"), "token_count")


def rss_light(spark, d):
    """Title, description and body of each item, by the plainer rules; ids from the address or title."""
    items = html.rss_items(_feeds(spark, d), titled=True)
    pages = table(spark, d, "pages").withColumn("link", F.regexp_replace("url", "[<&]", "")).groupBy("link").agg(F.min("page_id").alias("page_id"))
    text = items.join(pages, "link", "left").join(html.bodies(table(spark, d, "pages")), "page_id", "left")
    whole = F.concat_ws("\n", "title", "description", F.nullif("body", F.lit("")))
    return text.select(T.short_hash(T.first_filled(F.col("link"), F.col("title")), "sha1").alias("id"), F.length(whole).alias("chars")).filter("chars > 10")


def raw_capture(spark, d):
    """The first five pages of each feed, their markup cut to three thousand characters."""
    from pyspark.sql import Window

    own = table(spark, d, "pages").withColumn("feed", F.floor(F.col("page_id") / 50))
    place = F.row_number().over(Window.partitionBy("feed").orderBy("page_id"))
    return own.withColumn("place", place).filter("place <= 5").select("feed", "page_id", F.md5(F.substring("html", 1, 3000)).alias("html"))


def search_cache(spark, d):
    """Previews, categories and projected unit vectors of the rows that have both, stored for a viewer."""
    v = vectors(spark, d).select(F.col("vec_id").alias("doc_id"), V.normalized(F.col("v")).alias("v"))
    docs = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.substring("text", 1, 180), "\n", " ")).alias("preview"), T.category(F.col("text")).alias("category"))
    cache = stored(docs.join(v, "doc_id").withColumn("p", V.thirds(F.col("v"))), "cache")
    return cache.select("doc_id", "preview", "category", *[F.round(F.col("p")[i], 3).alias(n) for i, n in enumerate("xyz")])


LABELLED_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{name}'" for name, words in T.CATEGORIES.items()) + f" ELSE '{T.OTHER_CATEGORY}' END"
HALVES = "(SELECT *, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS idx FROM v)"
ROUNDED = "round(sqrt(list_inner_product(v, v)), 4)"
FEED = "page_id // 50 AS feed, regexp_replace(coalesce(url, ''), '[<&]', '', 'g') AS link"

QUERIES = {
    "csv_typed_scan": (csv_typed, "SELECT year(l_shipdate)::INT AS year, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity >= 25 GROUP BY 1"),
    "csv_to_parquet": (csv_to_parquet, "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"),
    "ndjson_scan": (ndjson, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"),
    "shard_records": (shard_records, "SELECT doc_id, source, n_chars::BIGINT AS n_chars, ((row_number() OVER (ORDER BY doc_id) - 1) // 300)::BIGINT AS shard_id FROM documents"),
    "shard_manifest": (shard_manifest, "SELECT ((rn - 1) // 300)::BIGINT AS shard_id, count(*) AS records FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1"),
    "vector_store_slice": (store_slice, f"{WITH} SELECT idx, {ROUNDED} AS norm FROM {HALVES} WHERE idx >= 90 AND idx < 130"),
    "vector_store_gather": (store_gather, f"{WITH} SELECT pos, t.idx::BIGINT AS idx, {ROUNDED} AS norm FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 150), (4, 99999999)) t(pos, idx) JOIN {HALVES} h ON h.idx = t.idx"),
    "quantized_store": (quantized_store, f"{PARAMETERS} SELECT row_number() OVER (ORDER BY (vec_id % 3 = 0)::INT, vec_id) - 1 AS vector_idx, vec_id, array_to_string({I8}, ',') AS code FROM v, a"),
    "quantized_manifest": (quantized_manifest, "SELECT n AS total_vectors, 64 AS vector_dimension, round(n * 64 * 4 / 1048576, 2) AS raw_float32_size_mb, round(n * 64 / 1048576, 2) AS quantized_size_mb, 75.0 AS ram_saving_percent FROM (SELECT count(*) AS n FROM embeddings)"),
    "sq8_dequantize": (dequantized, f"{PARAMETERS} SELECT vec_id, round(list_sum(list_transform(list_zip({I8}, lows, scales), lambda z: (z[1] + 128) * z[3] + z[2])), 6) AS total FROM v, a"),
    "corpora_concatenated": (concatenated, "SELECT doc_id, lang FROM documents"),
    "flat_matrix_codes": (flat_matrix, "SELECT list_sum(list_transform((embedding::DOUBLE[])[9:24], lambda x: greatest(-127, least(127, round_even(x * 40, 0)))))::BIGINT AS total, count(*) AS n FROM embeddings GROUP BY 1"),
    "positional_gather": (positional_gather, "WITH i AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings), a AS (SELECT vec_id AS pos, unnest([idx, idx + 3, idx]) AS idx FROM i WHERE idx % 7 = 0) SELECT pos, a.idx, count(*) AS n, round(max(list_sum(v)), 3) AS total FROM a JOIN i ON i.idx = a.idx GROUP BY ALL"),
    "index_artefacts": (artefacts, f"{CENTROIDS}, {NEAR} SELECT c.cid, count(near.vec_id) AS n, sum(near.vec_id)::BIGINT AS ids FROM c LEFT JOIN near ON near.cid = c.cid AND r = 1 GROUP BY c.cid"),
    "query_log": (query_log, "SELECT 'query_1704067200_' || left(md5(text), 8) AS name, 10::BIGINT AS results FROM benchmark"),
    "crud_written": (crud_written, "SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'renamed' ELSE p_name END AS p_name, CASE WHEN p_partkey = 7 THEN 1 ELSE p_size END AS p_size FROM part WHERE p_partkey <> 9"),
    "partial_aggregates": (partials, "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity) / count(*), 6) AS mean, max(l_extendedprice) AS most FROM lineitem GROUP BY 1"),
    "ivecs_roundtrip": (
        ivecs,
        f"{WITH}, t AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(list_zip(q, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), vec_id) AS r FROM v, q), l AS (SELECT query_id, array_to_string(list(vec_id ORDER BY r), ',') AS ids FROM t WHERE r <= 5 GROUP BY 1) SELECT ids, count(*) AS n FROM l GROUP BY 1",
    ),
    "fvecs_files": (fvecs, f"{WITH} SELECT len(v)::INT AS dimension, count(*) AS n, round(sum(sqrt(list_inner_product(v, v))), 3) AS norms FROM v GROUP BY 1"),
    "graphfile_roundtrip": (graph_file, f"{EDGES} SELECT src, dst FROM s"),
    "rss_feed_items": (rss_feed_items, f"SELECT 'feed-' || feed AS feed_url, 'Page ' || page_id || ' & more' AS title, link, 'about ' || page_id AS description FROM (SELECT page_id, {FEED} FROM pages) WHERE link <> ''"),
    "rss_articles": (rss_articles, None),
    "rss_light_items": (rss_light, None),
    "raw_rss_capture": (raw_capture, "SELECT feed, page_id, md5(left(html, 3000)) AS html FROM (SELECT *, page_id // 50 AS feed, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) AS r FROM pages) WHERE r <= 5"),
    "search_cache": (
        search_cache,
        f"{WITH}, u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u FROM v) SELECT doc_id, trim(replace(left(text, 180), chr(10), ' ')) AS preview, {LABELLED_CATEGORY} AS category, round(list_avg(u[1:22]) * 30, 3) AS x, round(list_avg(u[23:44]) * 30, 3) AS y, round(list_avg(u[45:64]) * 30, 3) AS z FROM documents JOIN u ON vec_id = doc_id",
    ),
}
