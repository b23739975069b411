"""Vector queries: exact search, quantizers, inverted files, product codes, graphs, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions import vector as V
from ..operators import product_codes as C
from ..operators import search as S
from .sqlfunctions import dealt_queries, register_table_search, register_vector_search, store_vector_index
from .tables import query_set, table, vectors

K, PARTS, CODES, DIMENSION = 10, 8, 16, 64
#: Rows that a first tier of codes hands on.
POOL_ROWS = 100

WITH = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q, label AS query_label FROM v WHERE vec_id % 50 = 0)"
SQUARED = "list_sum(list_transform(list_zip(q, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
COSINE = "1 - list_inner_product(q, v) / (greatest(sqrt(list_inner_product(q, q)), 1e-12) * greatest(sqrt(list_inner_product(v, v)), 1e-12))"


def _out(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def _top(measure: str, where: str = "true", k: int = K) -> str:
    return f"{WITH} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, {measure} AS distance FROM v, q WHERE {where})) WHERE rank <= {k}"


def _exact(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        return _out(S.knn(query_set(v), v, K, metric))

    return run


def bulk(spark, d):
    v = vectors(spark, d)
    return _out(S.nearest(query_set(v), v, K))


def filtered(spark, d):
    v = vectors(spark, d)
    q = query_set(v).join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return _out(S.nearest(q.withColumnRenamed("query_label", "label"), v, K, on="label"))


def backfilled(spark, d):
    """Of the 20 nearest those of the query's label come first, the others fill up to K."""
    v = vectors(spark, d)
    q = query_set(v).join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    pool = S.knn(query_set(v), v, 20).drop("rank").join(v.select("vec_id", "label"), "vec_id").join(q.select("query_id", "query_label"), "query_id")
    own = pool.filter("label = query_label").withColumn("tier", F.lit(0))
    rest = pool.join(own.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti").withColumn("tier", F.lit(1))
    both = own.unionByName(rest)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "distance", "vec_id"))
    return both.withColumn("rank", place).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "tier")


def norms(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.inner_product(V.normalized(F.col("v")), V.normalized(F.col("v"))), 6).alias("unit"))


def _csv(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")


def row_codes(spark, d):
    c = vectors(spark, d).select("vec_id", Q.row_code(F.col("v")).alias("c"))
    return c.select("vec_id", _csv(F.col("c.code")).alias("code"), F.round("c.scale", 9).alias("scale"), F.round("c.offset", 6).alias("low"))


def decoded_rows(codes, scale, offset):
    return codes * scale[:, None] + offset[:, None]


def _row_coded(v):
    return v.select("vec_id", Q.row_code(F.col("v")).alias("c")).select("vec_id", F.col("c.code").alias("v"), "c.scale", "c.offset")


def row_adc(spark, d):
    v = vectors(spark, d)
    found = S.nearest(query_set(v), _row_coded(v), K, decode=decoded_rows, extra=("scale", "offset"))
    return _out(found.withColumn("distance", F.sqrt("distance")))


def _coded(spark, d):
    v = vectors(spark, d)
    return v.crossJoin(F.broadcast(Q.as_arrays(Q.dimension_ranges(v))))


def dimension_parameters(spark, d):
    r = Q.dimension_ranges(vectors(spark, d))
    return r.select(F.col("pos").cast("int").alias("pos"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("scale", 9).alias("scale"))


def global_range(spark, d):
    x = vectors(spark, d).select(F.array_min("v").alias("low"), F.array_max("v").alias("high"))
    return x.agg(F.round(F.min("low"), 6).alias("low"), F.round(F.max("high"), 6).alias("high"))


def codes_u8(spark, d):
    return _coded(spark, d).select("vec_id", _csv(Q.unsigned_codes(F.col("v"), F.col("lows"), F.col("scales"))).alias("code"))


def codes_i8(spark, d):
    return _coded(spark, d).select("vec_id", _csv(Q.signed_codes(F.col("v"), F.col("lows"), F.col("scales"))).alias("code"))


def reconstruction(spark, d):
    c = _coded(spark, d).withColumn("back", Q.decoded(Q.unsigned_codes(F.col("v"), F.col("lows"), F.col("scales")), F.col("lows"), F.col("scales")))
    rows = c.select((V.l2_squared(F.col("v"), F.col("back")) / F.size("v")).alias("mse"), (1 - V.cosine_distance(F.col("v"), F.col("back"))).alias("cosine"))
    return rows.agg(F.round(F.avg("mse"), 9).alias("mse"), F.round(F.avg("cosine"), 6).alias("mean_cosine"), F.count("*").alias("n"))


def u8_distance(spark, d):
    """The distance of two codes is that of the codes times the scales."""
    c = _coded(spark, d).select("vec_id", F.zip_with(Q.unsigned_codes(F.col("v"), F.col("lows"), F.col("scales")), "scales", lambda x, s: x * s).alias("v"))
    q = c.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return _out(S.nearest(q, c, K, by=F.round("distance", 9)))


def scaled_query(spark, d):
    """Inner product of scaled queries with raw codes: ranks as on decoded vectors."""
    c = _coded(spark, d)
    q = c.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.zip_with("v", "scales", lambda x, s: x * s).alias("q"))
    codes = c.select("vec_id", Q.signed_codes(F.col("v"), F.col("lows"), F.col("scales")).alias("v"))
    return _out(S.nearest(q, codes, K, "ip", by=F.round("distance", 9)))


def ivf_assign(spark, d):
    v = vectors(spark, d)
    return S.assigned(v, S.centroids_by_label(v)).select("vec_id", F.col("cids")[0].alias("cid"))


def ivf_sizes(spark, d):
    v = vectors(spark, d)
    c = S.centroids_by_label(v)
    n = S.assigned(v, c).groupBy(F.col("cids")[0].alias("cid")).agg(F.count("*").alias("n"))
    return c.select("cid").join(n, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))


def ivf_probe(spark, d):
    v = vectors(spark, d)
    return _out(S.probe(query_set(v), v, S.centroids_by_label(v), K, 3))


def lloyd(spark, d):
    """New centroids after assigning every row to the nearest old one."""
    v = vectors(spark, d)
    new = S.assigned(v, S.centroids_by_label(v)).select(F.col("cids")[0].alias("label"), "v")
    return S.centroids_by_label(new).select("cid", F.posexplode("c").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


def residuals(spark, d):
    v = vectors(spark, d)
    c = S.centroids_by_label(v)
    own = S.assigned(v, c).select("vec_id", "v", F.col("cids")[0].alias("cid")).join(F.broadcast(c), "cid")
    return own.select("vec_id", F.round(V.norm(V.residual(F.col("v"), F.col("c"))), 6).alias("residual_norm"))


def pq_encode(spark, d):
    v = vectors(spark, d)
    return C.encoded(v, S.codebook(v, PARTS, CODES, DIMENSION)).select("vec_id", _csv(F.col("codes")).alias("codes"))


def _pq_nearest(queries, coded, book, **on):
    return C.nearest_coded(queries, coded, book, K, **on)


def pq_search(spark, d):
    v = vectors(spark, d)
    book = S.codebook(v, PARTS, CODES, DIMENSION)
    return _out(_pq_nearest(query_set(v), C.encoded(v, book), book))


def pq_reranked(spark, d):
    """The hundred nearest by tables, ranked by whole vectors."""
    v = vectors(spark, d)
    book = S.codebook(v, PARTS, CODES, DIMENSION)
    pool = C.nearest_coded(query_set(v), C.encoded(v, book), book, POOL_ROWS)
    return _out(S.reranked(pool.select("query_id", "vec_id"), query_set(v), v, K))


def pq_trained(spark, d):
    """Recall of a product quantizer with a fitted codebook, behind an inverted file with fitted lists."""
    v = vectors(spark, d)
    c = S.trained_lists(v, 16)
    own = S.residuals(v, c)
    book = S.trained_codebook(own, PARTS, 256)
    asked = S.residuals(query_set(v).select(F.col("query_id").alias("vec_id"), F.col("q").alias("v")), c, 4).select(F.col("vec_id").alias("query_id"), "cid", F.col("v").alias("q"))
    return _out(_pq_nearest(asked, C.encoded(own, book, "cid"), book, on="cid"))


def pq_decode(spark, d):
    v = vectors(spark, d)
    book = S.codebook(v, PARTS, CODES, DIMENSION)
    codes = C.encoded(v, book).select("vec_id", F.posexplode("codes").alias("m", "code"))
    back = codes.join(F.broadcast(book), ["m", "code"]).groupBy("vec_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("m", "c")))["c"]).alias("back"))
    return back.join(v, "vec_id").select("vec_id", F.round(V.l2_squared(F.col("v"), F.col("back")), 6).alias("error"))


def ivf_pq(spark, d):
    """Codes of residuals within lists; a query's lookup table is of its residual for each list."""
    v = vectors(spark, d)
    c = S.centroids_by_label(v)
    own = S.residuals(v, c)
    book = S.codebook(own, PARTS, CODES, DIMENSION)
    coded = C.encoded(own, book, "cid")
    asked = S.residuals(query_set(v).select(F.col("query_id").alias("vec_id"), F.col("q").alias("v")), c, 3).select(F.col("vec_id").alias("query_id"), "cid", F.col("v").alias("q"))
    return _out(_pq_nearest(asked, coded, book, on="cid"))


def _sql_table_search(quantization: str):
    def run(spark, d):
        v = vectors(spark, d)
        register_table_search(spark)
        dealt_queries(query_set(v).select("query_id", "q")).createOrReplaceTempView("asked_vectors")
        return spark.sql(
            "SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM vector_search_of(queries => TABLE(asked_vectors), "
            f"index => '{store_vector_index(v)}', metric => 'cosine', k => {K}, quantization => '{quantization}', min_rerank_k => 40)"
        )

    return run


def sql_search(spark, d):
    """The table function vector_search for the vector of id 0."""
    v = vectors(spark, d)
    register_vector_search(spark, v)
    row = v.filter("vec_id = 0").select("v").first()
    point = F.array(*[F.lit(x) for x in row["v"]]) if row and row["v"] else F.lit(None).cast("array<double>")
    return spark.sql(f"SELECT rank, vec_id, round(distance, 6) AS distance FROM vector_search(:point, 'cosine', {K})", args={"point": point})


def _two_tier(spark, d):
    v = vectors(spark, d)
    q = query_set(v)
    pool = S.nearest(q, _row_coded(v), 30, decode=decoded_rows, extra=("scale", "offset"), by=F.sqrt("distance"))
    return v, q, S.reranked(pool.select("query_id", "vec_id"), q, v, K)


def two_tier(spark, d):
    return _out(_two_tier(spark, d)[2])


def two_tier_recall(spark, d):
    v, q, found = _two_tier(spark, d)
    return S.recall(S.knn(q, v, K), found, K)


def graph_edges(spark, d):
    return S.neighbour_graph(vectors(spark, d), 8)


def graph_degree(spark, d):
    return S.neighbour_graph(vectors(spark, d), 8).groupBy("src").agg(F.count("*").alias("degree"))


def memory_model(spark, d):
    n = table(spark, d, "embeddings").count()
    rows = [(k, int(x)) for k, x in S.index_bytes(n, DIMENSION).items()]
    return spark.createDataFrame(rows, "kind string, bytes long")


def _graph(spark, d, **options):
    """Lists by the size of the table, each with a graph of its own; queries are routed to the nearest."""
    v = vectors(spark, d)
    c = S.few_lists(S.trained_lists(v, max(1, -(-v.count() // S.SHARD_ROWS))))
    return S.graph_search(query_set(v), S.graph_index(v, c), c, K, nprobe=4, **options)


def beam(spark, d):
    return _out(_graph(spark, d))


def beam_early(spark, d):
    return _out(_graph(spark, d, tau=3))


def _features(spark, d):
    from pyspark.ml.functions import array_to_vector

    return vectors(spark, d).select("vec_id", array_to_vector("v").alias("features"))


def kmeans(spark, d):
    from pyspark.ml.clustering import KMeans

    f = _features(spark, d)
    model = KMeans(k=10, seed=42, maxIter=15, tol=1e-4, initMode="random").fit(f)
    return model.transform(f).select("vec_id", F.col("prediction").alias("cid"))


def pca(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    f = _features(spark, d)
    x = PCA(k=3, inputCol="features", outputCol="p").fit(f).transform(f).select("vec_id", vector_to_array("p").alias("p"))
    most = x.agg(F.max(F.greatest(*[F.abs(F.col("p")[i]) for i in range(3)])).alias("most"))
    return x.crossJoin(F.broadcast(most)).select("vec_id", *[F.round(F.col("p")[i] / F.col("most") * 45, 4).alias(n) for i, n in enumerate("xyz")])


def similarities(spark, d):
    v = vectors(spark, d)
    pairs = S.knn(query_set(v), v, 3)
    return pairs.select("query_id", "vec_id", F.round(V.similarity(F.sqrt("distance"), "l2"), 6).alias("from_l2"), F.round(V.similarity(F.col("distance"), "l2_squared"), 6).alias("from_l2_squared"))


PARAMETERS = f"{WITH}, x AS (SELECT generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM v), p AS (SELECT pos::INT AS pos, min(x) AS low, max(x) AS high, CASE WHEN max(x) - min(x) < 1e-8 THEN 1.0 ELSE (max(x) - min(x)) / 255 END AS scale FROM x GROUP BY pos), a AS (SELECT list(low ORDER BY pos) AS lows, list(scale ORDER BY pos) AS scales FROM p)"
U8 = "list_transform(list_zip(v, lows, scales), lambda z: greatest(0, least(255, round_even((z[1] - z[2]) / z[3], 0)))::INT)"
I8 = "list_transform(list_zip(v, lows, scales), lambda z: round_even(greatest(0, least(255, (z[1] - z[2]) / z[3])) - 128, 0)::INT)"
ROW = "SELECT vec_id, v, list_min(v) AS low, CASE WHEN list_max(v) = list_min(v) THEN 1e-8 ELSE list_max(v) - list_min(v) END AS span FROM v"
ROW_CODED = f"r AS ({ROW}), rc AS (SELECT vec_id, v, low, span / 255 AS scale, list_transform(v, lambda x: greatest(0, least(255, round_even((x - low) / span * 255, 0)))::INT) AS code FROM r)"
ADC = "sqrt(list_sum(list_transform(list_zip(q, code), lambda z: (z[1] - (z[2] * scale + low)) * (z[1] - (z[2] * scale + low)))))"
CENTROIDS = f"{WITH}, cx AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM v), cm AS (SELECT label, pos, avg(x) AS m FROM cx GROUP BY label, pos), c AS (SELECT label::INT AS cid, list(m ORDER BY pos) AS c FROM cm GROUP BY label)"
NEAR = "near AS (SELECT vec_id, v, cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cid) AS r FROM v, c)"
BOOK = f"{WITH}, book AS (SELECT m, vec_id::INT AS code, v[m * 8 + 1 : m * 8 + 8] AS c FROM v, range(8) t(m) WHERE vec_id < 16), sub AS (SELECT vec_id, m, v[m * 8 + 1 : m * 8 + 8] AS s FROM v, range(8) t(m)), enc AS (SELECT vec_id, m, code, c, s FROM (SELECT vec_id, sub.m, code, c, s, row_number() OVER (PARTITION BY vec_id, sub.m ORDER BY list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), code) AS r FROM sub JOIN book USING (m)) WHERE r = 1)"


def _rank(source: str, k: int = K, by: str = "distance") -> str:
    return f"SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}, vec_id)::INT AS rank FROM ({source})) WHERE rank <= {k}"


POOL = f"pool AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {ADC}, vec_id) AS r FROM rc, q) WHERE r <= 30)"
TIER = f"SELECT query_id, vec_id, {SQUARED} AS distance FROM pool JOIN v USING (vec_id) JOIN q USING (query_id)"
EDGES = f"{WITH}, e AS (SELECT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), b.vec_id) AS r FROM v a, v b WHERE a.vec_id <> b.vec_id) WHERE r <= 8), s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"

QUERIES = {
    "knn_exact_l2": (_exact("l2"), _top(SQUARED)),
    "knn_exact_cosine": (_exact("cosine"), _top(COSINE)),
    "knn_exact_ip": (_exact("ip"), _top("-list_inner_product(q, v)")),
    "knn_bulk_l2": (bulk, _top(SQUARED)),
    "knn_filtered_label": (filtered, _top(SQUARED, "label = query_label")),
    "knn_post_filter_backfill": (
        backfilled,
        f"{WITH}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM (SELECT query_id, vec_id, CASE WHEN label = query_label THEN 0 ELSE 1 END AS tier, {SQUARED} AS distance FROM v, q)) SELECT query_id, rank, vec_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, distance, vec_id)::INT AS rank FROM p WHERE r <= 20) WHERE rank <= {K}",
    ),
    "vector_norms": (norms, f"{WITH} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(CASE WHEN list_inner_product(v, v) > 0 THEN 1.0 ELSE 0.0 END, 6) AS unit FROM v"),
    "similarity_from_distance": (
        similarities,
        f"WITH t AS ({_top(SQUARED, k=3).replace('round(distance, 6) AS distance', 'distance')}) SELECT query_id, vec_id, round(greatest(0.0, least(1.0, 1 - sqrt(distance) * sqrt(distance) / 2)), 6) AS from_l2, round(1 - distance / 2, 6) AS from_l2_squared FROM t",
    ),
    "sq8_row_codes": (row_codes, f"{WITH}, {ROW_CODED} SELECT vec_id, array_to_string(code, ',') AS code, round(scale, 9) AS scale, round(low, 6) AS low FROM rc"),
    "sq8_row_adc_topk": (row_adc, f"{WITH}, {ROW_CODED} " + _rank(f"SELECT query_id, vec_id, {ADC} AS distance FROM rc, q")),
    "sq8_dim_params": (dimension_parameters, f"{PARAMETERS} SELECT pos, round(low, 6) AS low, round(high, 6) AS high, round(scale, 9) AS scale FROM p"),
    "sq8_global_range": (global_range, f"{WITH} SELECT round(min(list_min(v)), 6) AS low, round(max(list_max(v)), 6) AS high FROM v"),
    "sq8_dim_codes_u8": (codes_u8, f"{PARAMETERS} SELECT vec_id, array_to_string({U8}, ',') AS code FROM v, a"),
    "sq8_dim_codes_i8": (codes_i8, f"{PARAMETERS} SELECT vec_id, array_to_string({I8}, ',') AS code FROM v, a"),
    "sq8_reconstruction_error": (
        reconstruction,
        f"{PARAMETERS}, b AS (SELECT v, list_transform(list_zip({U8}, lows, scales), lambda z: z[1] * z[3] + z[2]) AS q FROM v, a) SELECT round(avg({SQUARED} / len(v)), 9) AS mse, round(avg(1 - ({COSINE})), 6) AS mean_cosine, count(*) AS n FROM b",
    ),
    "sq8_u8_distance_topk": (
        u8_distance,
        f"{PARAMETERS}, c AS (SELECT vec_id, {U8} AS code, scales FROM v, a) " + _rank("SELECT b.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(b.code, c.code, c.scales), lambda z: ((z[1] - z[2]) * z[3]) ** 2)) AS distance FROM c, c b WHERE b.vec_id % 50 = 0", by="round(distance, 9)"),
    ),
    "int8_scaled_query_topk": (
        scaled_query,
        f"{PARAMETERS}, c AS (SELECT vec_id, {I8} AS code, list_transform(list_zip(v, scales), lambda z: z[1] * z[2]) AS q FROM v, a) " + _rank("SELECT b.vec_id AS query_id, c.vec_id, -list_sum(list_transform(list_zip(b.q, c.code), lambda z: z[1] * z[2])) AS distance FROM c, c b WHERE b.vec_id % 50 = 0", by="round(distance, 9)"),
    ),
    "ivf_assign": (ivf_assign, f"{CENTROIDS}, {NEAR} SELECT vec_id, cid FROM near WHERE r = 1"),
    "ivf_shard_distribution": (ivf_sizes, f"{CENTROIDS}, {NEAR} SELECT c.cid, count(near.vec_id) AS n FROM c LEFT JOIN near ON near.cid = c.cid AND r = 1 GROUP BY c.cid"),
    "ivf_probe_topk": (ivf_probe, f"{CENTROIDS}, {NEAR} " + _rank(f"SELECT query_id, n.vec_id, {SQUARED.replace('(q, v)', '(q, n.v)')} AS distance FROM q JOIN near m ON m.vec_id = query_id AND m.r <= 3 JOIN near n ON n.cid = m.cid AND n.r = 1")),
    "ivf_lloyd_step": (lloyd, f"{CENTROIDS}, {NEAR}, y AS (SELECT cid, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM near WHERE r = 1) SELECT cid, pos::INT AS pos, round(avg(x), 6) AS x FROM y GROUP BY ALL"),
    "ivf_residual_norms": (residuals, f"{CENTROIDS}, {NEAR} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS residual_norm FROM near JOIN c USING (cid) WHERE r = 1"),
    "pq_encode": (pq_encode, f"{BOOK} SELECT vec_id, array_to_string(list(code ORDER BY m), ',') AS codes FROM enc GROUP BY vec_id"),
    "pq_decode": (pq_decode, f"{BOOK} SELECT vec_id, round(sum(list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS error FROM enc GROUP BY vec_id"),
    "pq_adc_topk": (
        pq_search,
        f"{BOOK} " + _rank("SELECT query_id, enc.vec_id, sum(list_sum(list_transform(list_zip(q[m * 8 + 1 : m * 8 + 8], c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM enc, q GROUP BY ALL", by="round(distance, 9)"),
    ),
    "pq_rerank_topk": (
        pq_reranked,
        f"{BOOK}, coded AS (SELECT query_id, enc.vec_id, sum(list_sum(list_transform(list_zip(q[m * 8 + 1 : m * 8 + 8], c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM enc, q GROUP BY ALL), pool AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS r FROM coded) WHERE r <= {POOL_ROWS}) "
        + _rank(f"SELECT query_id, vec_id, {SQUARED} AS distance FROM pool JOIN q USING (query_id) JOIN v USING (vec_id)"),
    ),
    "ivf_pq_topk": (
        ivf_pq,
        f"{CENTROIDS}, {NEAR}, res AS (SELECT vec_id, cid, r, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS d FROM near JOIN c USING (cid)), book AS (SELECT m, vec_id::INT AS code, d[m * 8 + 1 : m * 8 + 8] AS b FROM res, range(8) t(m) WHERE r = 1 AND vec_id < 16), enc AS (SELECT vec_id, cid, m, b FROM (SELECT res.vec_id, res.cid, m, b, row_number() OVER (PARTITION BY res.vec_id, m ORDER BY list_sum(list_transform(list_zip(d[m * 8 + 1 : m * 8 + 8], b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), code) AS k FROM res, book WHERE r = 1) WHERE k = 1), ask AS (SELECT vec_id AS query_id, cid, d AS q FROM res WHERE r <= 3 AND vec_id % 50 = 0) "
        + _rank("SELECT query_id, enc.vec_id, sum(list_sum(list_transform(list_zip(q[m * 8 + 1 : m * 8 + 8], b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM enc JOIN ask USING (cid) GROUP BY ALL", by="round(distance, 9)"),
    ),
    "sql_vector_search": (sql_search, f"WITH t AS ({_top(COSINE, 'query_id = 0')}) SELECT rank, vec_id, distance FROM t"),
    "sql_search_exact": (_sql_table_search("FLOAT32_EXACT"), _top(COSINE)),
    "sql_search_coded": (
        _sql_table_search("SQ8_UINT8"),
        f"{PARAMETERS}, b AS (SELECT vec_id, list_transform(list_zip({U8}, lows, scales), lambda z: z[1] * z[3] + z[2]) AS v FROM v, a), pool AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round({COSINE}, 9), vec_id) AS r FROM b, q) WHERE r <= 40) "
        + _rank(f"SELECT query_id, vec_id, {COSINE} AS distance FROM pool JOIN q USING (query_id) JOIN v USING (vec_id)"),
    ),
    "two_tier_rerank": (two_tier, f"{WITH}, {ROW_CODED}, {POOL} " + _rank(TIER)),
    "two_tier_recall": (
        two_tier_recall,
        f"{WITH}, {ROW_CODED}, {POOL}, f AS ({_rank(TIER)}), t AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {SQUARED}, vec_id) AS r FROM v, q) WHERE r <= {K}) SELECT round(count(f.vec_id) / count(*), 6) AS recall FROM t LEFT JOIN f USING (query_id, vec_id)",
    ),
    "knn_graph_edges": (graph_edges, f"{EDGES} SELECT src, dst FROM s"),
    "knn_graph_degree": (graph_degree, f"{EDGES} SELECT src, count(*) AS degree FROM s GROUP BY src"),
    "index_memory_model": (
        memory_model,
        "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'flat' AS kind, 4 * n * 64 AS bytes FROM n UNION ALL SELECT 'graph', 4 * n * 64 + 8 * n * 16 FROM n UNION ALL SELECT 'ivf_pq', 4 * 16 * 64 + 1024 * 64 + n * 16 FROM n UNION ALL SELECT 'two_tier', n * 64 + 8 * n * 16 + 8 * 64 FROM n",
    ),
    "pq_trained_topk": (pq_trained, None),
    "graph_beam_search": (beam, None),
    "graph_beam_early_exit": (beam_early, None),
    "kmeans_fit": (kmeans, None),
    "pca_project_3d": (pca, None),
}
