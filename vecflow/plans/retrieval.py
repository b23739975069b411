"""Queries of whole retrieval paths: text to vector, stored shards, federated scans, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import evaluation
from ..functions import quantize as Q
from ..functions import text as T
from ..functions import vector as V
from ..operators import dedup as D
from ..operators import embedding as E
from ..operators import indexes, stores
from ..operators import search as S
from ..streaming import ingest
from ..workspace import dealt, stored, workdir
from .tables import query_set, table, vectors
from .vectors import ADC, CENTROIDS, COSINE, EDGES, I8, NEAR, PARAMETERS, ROW, SQUARED, WITH, _csv, _out, _row_coded, decoded_rows

K = 10


def normalized_search(spark, d):
    """Inner products of unit vectors, the largest first."""
    v = vectors(spark, d).withColumn("v", V.normalized(F.col("v")))
    found = S.nearest(query_set(v), v, K, "ip")
    return found.select("query_id", "rank", "vec_id", F.round(-F.col("distance"), 6).alias("score"))


def global_codes(spark, d):
    """Unsigned codes with one range for all dimensions."""
    v = vectors(spark, d)
    ends = v.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))
    scale = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("high") - F.col("low")) / 255)
    coded = v.crossJoin(F.broadcast(ends.select("low", scale.alias("scale"))))  # one row
    code = F.transform("v", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint((x - F.col("low")) / F.col("scale")))))
    return coded.select("vec_id", _csv(code).alias("code"))


def recall_at_k(spark, d):
    """The share of the true neighbours that an inverted file finds, by how many count."""
    v = vectors(spark, d)
    truth, found = stored(S.knn(query_set(v), v, K), "truth"), stored(S.probe(query_set(v), v, S.centroids_by_label(v), K, 3), "found")
    rows = None
    for k in (1, 5, 10):
        own = S.recall(truth, found, k).select(F.lit(k).alias("k"), "recall")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def _routed(spark, d):
    """Lists as folders of a stored table, with their centroids."""
    v, uri = vectors(spark, d), workdir(spark, "routed")
    c = S.centroids_by_label(v)
    stores.save_index(S.assigned(v, c).select("vec_id", "v", F.col("cids")[0].alias("cid")), c, uri)
    shards, centroids, _ = stores.load_index(spark, uri)
    return v, shards, centroids


def routed_two_tier(spark, d):
    """Fifty rows of the three nearest lists by their codes, ranked by whole vectors."""
    v, shards, c = _routed(spark, d)
    q = query_set(v)
    asked = S.assigned(q.withColumnRenamed("q", "v"), c, 3).select("query_id", F.col("v").alias("q"), F.explode("cids").alias("cid"))
    coded = _row_coded(shards).join(shards.select("vec_id", "cid"), "vec_id")
    pool = S.nearest(asked, coded, 50, on="cid", decode=decoded_rows, extra=("scale", "offset"), by=F.sqrt("distance"))
    return _out(S.reranked(pool.select("query_id", "vec_id"), q, shards, 5))


def routed_backfill(spark, d):
    """Of forty rows of the three nearest lists those of the query's label first, the others to fill up."""
    v, shards, c = _routed(spark, d)
    asked = S.assigned(query_set(v).withColumnRenamed("q", "v"), c, 3).select("query_id", F.col("v").alias("q"), F.explode("cids").alias("cid"))
    pool = S.nearest(asked, shards, 40, on="cid")
    labels = v.select("vec_id", "label")
    met = pool.drop("rank").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    tiered = met.withColumn("tier", F.when(F.col("label") == F.col("query_label"), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "distance", "vec_id"))
    return tiered.withColumn("rank", place).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "tier")


def federated_scan(spark, d):
    """Every fifth row of each corpus (a label) by signed codes; queries as symmetric 8-bit codes."""
    v = vectors(spark, d)
    ranges = Q.as_arrays(Q.dimension_ranges(v))
    own = D.numbered(v.select("vec_id", "v", "label"), "vec_id", "local", "label").filter("local % 5 = 0")
    coded = own.crossJoin(F.broadcast(ranges)).select("vec_id", Q.signed_codes(F.col("v"), F.col("lows"), F.col("scales")).cast("array<double>").alias("v"))
    q = query_set(v).select("query_id", Q.symmetric_codes(F.col("q")).cast("array<double>").alias("q"))
    return S.nearest(q, coded, 5, "ip").select("query_id", "rank", "vec_id", (-F.col("distance")).cast("long").alias("score"))


def projected_vectors(spark, d):
    """Three coordinates of each query where no projection was fitted."""
    p = query_set(vectors(spark, d)).withColumn("p", V.thirds(F.col("q")))
    return p.select("query_id", *[F.round(F.col("p")[i], 3).alias(n) for i, n in enumerate("xyz")])


def pca_projection(spark, d):
    """A projection fitted once, applied to single vectors with the mean and components as they were stored."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, d)
    model = PCA(k=3, inputCol="f", outputCol="p").fit(v.select(array_to_vector("v").alias("f")))
    means = v.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    mean = F.broadcast(means.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda z: z["m"]).alias("mean")))  # one row, as wide as a vector
    components = [F.array(*[F.lit(float(x)) for x in row]) for row in model.pc.toArray().T]
    p = query_set(v).crossJoin(mean).withColumn("p", V.projected(F.col("q"), F.col("mean"), components, F.lit(1.0)))
    return p.select("query_id", *[F.round(F.abs(F.col("p")[i]), 4).alias(n) for i, n in enumerate("xyz")])


def embedded_texts(spark, d):
    """A unit vector for each benchmark text that depends on the text only."""
    e = E.embedded(table(spark, d, "benchmark").select("item_id", "text"), E.HashEmbedder(384), "text")
    return e.select("item_id", F.size("v").alias("dimension"), F.round(V.norm(F.col("v")), 4).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


def semantic_text(spark, d):
    """Texts as queries: cleaned, embedded, the nearest chunks of documents with their metadata."""
    engine = SemanticEngine(spark, table(spark, d, "documents"), E.TermEmbedder(256))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return engine.search(asked, 5)


class SemanticEngine:
    """Search of documents (doc_id, text, lang, source) by text. Documents are cleaned, cut into chunks
    and embedded once; the vectors are stored."""

    def __init__(self, spark, docs, embedder, index=None):
        words = dealt(docs.select("doc_id", "lang", "source", "text"), "doc_id").select("doc_id", "lang", "source", T.clean_tokens(T.cleaned(F.col("text"))).alias("w"))
        # a text's words stay where they are, chunks are made of them before rows are
        cut = F.transform(T.chunk_starts(F.size("w"), 300, 50), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("w", s + 1, F.lit(300)), " ").alias("chunk")))
        chunks = words.select("doc_id", "lang", "source", F.explode(F.when(F.size("w") > 0, cut)).alias("c"))
        keyed = chunks.select("doc_id", "lang", "source", "c.chunk", (F.col("doc_id") * 100_000 + (F.col("c.start") / 250).cast("long")).alias("vec_id"))
        self.rows = stored(E.embedded(keyed, embedder, "chunk"), "chunks")
        self.embedder, self.index = embedder, (index or indexes.FlatIndex("cosine")).fit(self.rows.select("vec_id", "v"))

    def search(self, queries, k: int, category: str | None = None):
        """query_id, rank, vec_id, doc_id, score, lang, preview; blank queries have no answers. With a
        category its chunks come first among four times as many, and others fill up."""
        asked = queries.select("query_id", T.cleaned(F.col("text")).alias("text")).filter("text <> ''")
        q = E.embedded(asked, self.embedder, "text", "q").select("query_id", "q")
        # what is found is small and stored, so that chunks need not be dealt anew to meet it
        own = self.rows.select("vec_id", "doc_id", "lang", "source", F.substring("chunk", 1, 200).alias("preview"))
        found = stored(self.index.search(q, k if category is None else max(4 * k, 25)), "found").join(own, "vec_id")
        own = F.lit(0) if category is None else F.when(F.col("source") == category, 0).otherwise(1)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "distance", "vec_id"))
        top = found.withColumn("tier", own).withColumn("rank", place).filter(F.col("rank") <= k)
        return top.select("query_id", "rank", "vec_id", "doc_id", F.bround(V.similarity(F.col("distance"), "cosine"), 4).alias("score"), T.first_filled(F.col("lang"), F.lit("N/A")).alias("lang"), "preview")


def document_pipeline(spark, d):
    """Documents cleaned and embedded, blank ones and near copies of any earlier ones dropped, the others' vectors
    stored: what came of each step."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    texts = docs.select("doc_id", F.explode(F.array(T.cleaned(F.col("text")))).alias("text"))  # a row each, so that it is cleaned once for both columns
    made = E.embedded(texts.withColumn("keys", D.band_keys(F.col("text"), tokens=T.clean_tokens)), E.HashEmbedder(64), "text")
    clean = stored(made.select("doc_id", "keys", F.col("v").cast("array<float>").alias("v")), "clean")  # texts are not moved again
    filled = clean.filter("keys is not null")  # blank texts have no words
    kept = stored(D.greedy_by_keys(filled).filter("kept").select("doc_id"), "kept")
    store = stores.VectorStore(spark, workdir(spark, "pipeline"), 64)
    # ids lie so densely in files that Spark would send tens of times their size to the driver and to all workers
    store.append(filled.join(kept.hint("merge"), "doc_id").select("doc_id", "v"), "doc_id")
    counts = clean.agg(F.count("*").alias("total_input"), F.count("keys").alias("filled"))
    return counts.crossJoin(kept.agg(F.count("*").alias("valid"))).select("total_input", F.col("valid").alias("total_valid_embedded"), (F.col("filled") - F.col("valid")).alias("total_duplicates"), F.lit(store.count()).alias("storage_written_records"))


def _graded(spark, d):
    """Each query's ten nearest with grades (2 for its own label, 1 for a neighbouring one), and for each
    query how many rows of each grade there are."""
    v = vectors(spark, d)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    found = S.knn(query_set(v), v, K + 1, "cosine").filter("query_id <> vec_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= K)
    grade = F.greatest(F.lit(0), 2 - F.abs(F.col("label") - F.col("own")))
    graded = found.join(v.select("vec_id", "label"), "vec_id").join(q, "query_id").select("query_id", "rank", F.coalesce(grade, F.lit(0)).alias("grade"))
    labels = v.groupBy("label").agg(F.count("*").alias("rows"))  # a row per label
    there = q.join(F.broadcast(labels), F.abs(F.col("label") - F.col("own")) < 2)
    counts = there.groupBy("query_id").agg(F.sum(F.when(F.col("label") == F.col("own"), F.col("rows") - 1).otherwise(0)).alias("n2"), F.sum(F.when(F.col("label") != F.col("own"), F.col("rows")).otherwise(0)).alias("n1"))
    return graded, counts.select("query_id", F.array("n2", "n1").alias("there"))


def retrieval_quality(spark, d):
    """How well cosine search finds rows of a query's label, query by query."""
    return evaluation.graded_quality(*_graded(spark, d), K)


def retrieval_summary(spark, d):
    """The means over all queries."""
    names = ("reciprocal_rank", "precision", "recall", "ndcg")
    return evaluation.graded_quality(*_graded(spark, d), K).agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def quantization_pipeline(spark, d):
    """Documents cut into chunks, embedded, coded with ranges of a bounded sample, stored with a manifest."""
    words = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    chunks = words.withColumn("start", F.explode(T.chunk_starts(F.size("w"), 300, 50))).select((F.col("doc_id") * 100_000 + (F.col("start") / 250).cast("long")).alias("chunk_id"), F.array_join(F.slice("w", F.col("start") + 1, 300), " ").alias("chunk"))
    rows = stored(E.embedded(chunks, E.HashEmbedder(64), "chunk").select("chunk_id", "v"), "chunk_vectors")
    store = stores.QuantizedStore(spark, workdir(spark, "quantized"))
    store.append(rows, "chunk_id", fit_on=rows.orderBy("chunk_id").limit(500))
    return store.manifest()


def index_comparison(spark, d):
    v = vectors(spark, d)
    return evaluation.report(evaluation.comparison(v, query_set(v), K, repeats=1), spark)


def layer_links(spark, d):
    """The same row in neighbouring layers: all rows, every fifth, every twenty-fifth."""
    ids = vectors(spark, d).select("vec_id")
    layer = lambda n, step: ids.filter(F.col("vec_id") % step == 0).select(F.concat(F.lit(f"L{n}_"), "vec_id").alias("node"), "vec_id")
    link = lambda a, b: a.join(b.withColumnRenamed("node", "to"), "vec_id").select(F.col("node").alias("from"), "to")
    return link(layer(2, 25), layer(1, 5)).unionByName(link(layer(1, 5), layer(0, 1)))


def layer_edges(spark, d):
    """The edges of the neighbour graph whose ends both lie in the middle layer."""
    edges = S.neighbour_graph(vectors(spark, d), 8).withColumn("layer", F.when((F.col("src") % 5 == 0) & (F.col("dst") % 5 == 0), 1).otherwise(0))
    return edges.filter("layer = 1").select("src", "dst")


def split_by_position(spark, d):
    """The first rows for training, the others as queries."""
    v = vectors(spark, d)
    cut = F.col("vec_id") < 150
    return v.groupBy(F.when(cut, "train").otherwise("query").alias("part")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


#: Vectors that a walk in order of id takes at once.
FAIL_BLOCK = 256


def fail_counter(spark, d):
    """For each query the step at which three rows in a row, in order of id, brought no gain of 0.1; the
    best only moves with a gain. Rows are taken block by block, for those queries that go on."""
    v = stored(D.numbered(vectors(spark, d).select("vec_id", "v"), "vec_id", "place"), "ordered")
    n = v.count()
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("fails"), F.lit(0).alias("step"), F.lit(0).alias("stopped"))
    state = stored(query_set(vectors(spark, d)).select("query_id", "q", start.alias("end")), "walks")

    def turn(a, x):
        gain = a["best"] - x["d"] >= 0.1
        fails, step = F.when(gain, 0).otherwise(a["fails"] + 1), a["step"] + 1
        went = F.struct(F.when(gain, x["d"]).otherwise(a["best"]).alias("best"), fails.alias("fails"), step.alias("step"), F.when(fails >= 3, step).otherwise(F.lit(0)).alias("stopped"))
        return F.when(a["stopped"] > 0, a).otherwise(went)

    done = None
    for first in range(0, n, FAIL_BLOCK):
        block = v.filter((F.col("place") >= first) & (F.col("place") < first + FAIL_BLOCK)).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("block"))
        measured = F.transform("block", lambda x: F.struct(x["vec_id"].alias("vec_id"), V.l2_squared(F.col("q"), x["v"]).alias("d")))
        state = state.crossJoin(F.broadcast(block))  # one row of FAIL_BLOCK vectors
        state = stored(state.select("query_id", "q", F.aggregate(measured, F.col("end"), turn).alias("end")), "walks")
        ended = state.filter("end.stopped > 0")
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("end.stopped = 0")
        if state.isEmpty():
            break
    folded = state if done is None else done.unionByName(state)
    return folded.select("query_id", F.col("end.stopped").alias("stopped"), F.round("end.best", 6).alias("best"))


def _layered(spark, v):
    from ..operators import layered

    lists = S.trained_lists(v, max(1, -(-v.count() // layered.SHARD_ROWS)))
    return layered.GraphStore(spark, workdir(spark, "layered")).create(stored(lists, "lists"))


def layered_graph(spark, d):
    """A layered graph for each list, built at once."""
    v = vectors(spark, d)
    store = _layered(spark, v)
    store.append(v, 0)
    return _out(store.search(query_set(v), K))


def layered_growth(spark, d):
    """The same graphs grown by a stream of four files, a batch each."""
    v, source = vectors(spark, d), workdir(spark, "vectors-in")
    v.select("vec_id", "v").repartition(4, "vec_id").write.parquet(source)
    store = _layered(spark, v)
    stream = spark.readStream.schema("vec_id long, v array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    store.grow(stream, workdir(spark, "vectors-state"))
    return _out(store.search(query_set(v), K))


def duplicate_stream(spark, d):
    """Documents as a stream in four runs, in order of id: which are kept, with memory over runs. The files of a
    run are as many as its rows need, and are read as one batch, so batches follow each other whatever the
    times of the files."""
    source, target, state = (workdir(spark, n) for n in ("docs-in", "docs-kept", "docs-state"))
    numbered = D.numbered(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "n")
    each = -(-numbered.count() // 4)
    for first in range(0, 4 * each, max(each, 1)):
        numbered.filter((F.col("n") >= first) & (F.col("n") < first + each)).write.mode("append").parquet(source)
        ingest.ingest(ingest.first_wins(ingest.file_stream(spark, source, "doc_id long, text string, n long")), target, state)
    return spark.read.schema("doc_id long, kept boolean").parquet(target)


def telemetry_stream(spark, d):
    """Events as a stream of files by time, windows of an hour that the watermark has passed or that wait."""
    source, target, state = (workdir(spark, n) for n in ("events-in", "windows", "events-state"))
    table(spark, d, "events").select("ts", "event_type", "value").repartitionByRange(4, "ts").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(source)
    ingest.telemetry(stream, target, state, "1 hour", "10000 days", "update")
    return ingest.latest(spark, target).select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def index_increments(spark, d):
    """Vectors that arrive as a stream, each batch added to the lists of a stored index."""
    v = vectors(spark, d)
    c = S.centroids_by_label(v)
    source, target, state = (workdir(spark, n) for n in ("vectors-in", "lists", "vectors-state"))
    for part in ("vec_id % 2 = 0", "vec_id % 2 = 1"):
        v.filter(part).select("vec_id", "v").write.mode("append").parquet(source)
        ingest.each_batch(ingest.file_stream(spark, source, "vec_id long, v array<double>"), lambda rows: S.assigned(rows, c).select("vec_id", "v", F.col("cids")[0].alias("cid")).write.mode("append").partitionBy("cid").parquet(target), state)
    lists = spark.read.schema("vec_id long, v array<double>, cid int").parquet(target)
    return lists.groupBy("cid").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def micro_batches(spark, d):
    """Documents through a stream in batches of a bounded number of files, and what is left at its end."""
    source, target, state = (workdir(spark, n) for n in ("docs-in", "docs-out", "docs-state"))
    table(spark, d, "documents").select("doc_id", "n_chars").repartition(5).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, n_chars long").option("maxFilesPerTrigger", 2).parquet(source)
    ingest.each_batch(stream, lambda rows: rows.write.mode("append").parquet(target), state)
    return spark.read.schema("doc_id long, n_chars long").parquet(target).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


GRADED = f"""{WITH}, near AS (
    SELECT query_id, query_label, label, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE}, vec_id) AS r FROM v, q WHERE vec_id <> query_id
), hits AS (
    SELECT query_id, r, coalesce(greatest(0, 2 - abs(label - query_label)), 0) AS g FROM near WHERE r <= {K}
), all_ AS (
    SELECT query_id, sum(CASE WHEN label = query_label THEN 1 ELSE 0 END) AS n2, sum(CASE WHEN abs(label - query_label) = 1 THEN 1 ELSE 0 END) AS n1 FROM v, q WHERE vec_id <> query_id GROUP BY query_id
), ideal AS (
    SELECT query_id, n1 + n2 AS n, list_sum(list_transform(range(1, {K} + 1), lambda i: CASE WHEN i <= n2 THEN 3 WHEN i <= n2 + n1 THEN 1 ELSE 0 END / log2(i + 1))) AS best FROM all_
), quality AS (
    SELECT h.query_id, coalesce(1.0 / min(r) FILTER (g > 0), 0) AS reciprocal_rank, count(*) FILTER (g > 0) / {K} AS precision,
        CASE WHEN any_value(n) > 0 THEN count(*) FILTER (g > 0) / any_value(n) ELSE 0 END AS recall, CASE WHEN any_value(best) > 0 THEN sum((pow(2, g) - 1) / log2(r + 1)) / any_value(best) ELSE 0 END AS ndcg
    FROM hits h JOIN ideal i ON i.query_id = h.query_id GROUP BY h.query_id
)"""
ROW_I = f"rows_ AS ({ROW}), rc AS (SELECT vec_id, v, low, span / 255 AS scale, list_transform(v, lambda x: greatest(0, least(255, round_even((x - low) / span * 255, 0)))::INT) AS code FROM rows_)"
PROBED = "FROM q JOIN near m ON m.vec_id = query_id AND m.r <= 3 JOIN near n ON n.cid = m.cid AND n.r = 1"

QUERIES = {
    "vector_normalized_dot": (normalized_search, f"{WITH} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, 1 - ({COSINE}) AS score FROM v, q)) WHERE rank <= {K}"),
    "sq8_global_codes": (global_codes, f"{WITH}, e AS (SELECT min(list_min(v)) AS low, max(list_max(v)) AS high FROM v) SELECT vec_id, array_to_string(list_transform(v, lambda x: greatest(0, least(255, round_even((x - low) / ((high - low) / 255), 0)))::INT), ',') AS code FROM v, e"),
    "recall_at_k": (
        recall_at_k,
        f"{CENTROIDS}, {NEAR}, t AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {SQUARED}, vec_id) AS r FROM v, q), f AS (SELECT query_id, n.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {SQUARED.replace('(q, v)', '(q, n.v)')}, n.vec_id) AS r {PROBED}) SELECT k::INT AS k, round(count(f.vec_id) / count(*), 6) AS recall FROM (VALUES (1), (5), (10)) x(k) JOIN t ON t.r <= k LEFT JOIN f ON f.query_id = t.query_id AND f.vec_id = t.vec_id AND f.r <= k GROUP BY k",
    ),
    "routed_two_tier": (
        routed_two_tier,
        f"{CENTROIDS}, {NEAR}, {ROW_I}, p AS (SELECT query_id, vec_id FROM (SELECT query_id, n.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {ADC}, n.vec_id) AS r {PROBED} JOIN rc ON rc.vec_id = n.vec_id) WHERE r <= 50) SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, {SQUARED} AS distance FROM p JOIN q USING (query_id) JOIN v USING (vec_id))) WHERE rank <= 5",
    ),
    "routed_backfill": (
        routed_backfill,
        f"{CENTROIDS}, {NEAR}, p AS (SELECT query_id, n.vec_id, {SQUARED.replace('(q, v)', '(q, n.v)')} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {SQUARED.replace('(q, v)', '(q, n.v)')}, n.vec_id) AS r {PROBED}), s AS (SELECT query_id, p.vec_id, distance, CASE WHEN a.label = b.label THEN 0 ELSE 1 END AS tier FROM p JOIN v a ON a.vec_id = p.vec_id JOIN v b ON b.vec_id = query_id WHERE r <= 40) SELECT query_id, rank, vec_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, distance, vec_id)::INT AS rank FROM s) WHERE rank <= {K}",
    ),
    "federated_scan": (
        federated_scan,
        f"{PARAMETERS}, l AS (SELECT vec_id, {I8} AS code, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS local FROM v, a), s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, code), lambda z: greatest(-127, least(127, round_even(z[1] * 127, 0))) * z[2])) AS score FROM l, q WHERE local % 5 = 0) SELECT query_id, rank, vec_id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5",
    ),
    "projected_vectors": (projected_vectors, f"{WITH} SELECT query_id, round(list_avg(q[1:22]) * 30, 3) AS x, round(list_avg(q[23:44]) * 30, 3) AS y, round(list_avg(q[45:64]) * 30, 3) AS z FROM q"),
    "pca_projection": (pca_projection, None),
    "embedded_texts": (embedded_texts, None),
    "semantic_text_search": (semantic_text, None),
    "document_pipeline": (document_pipeline, None),
    "quantization_pipeline": (quantization_pipeline, None),
    "index_comparison": (index_comparison, None),
    "layer_links": (layer_links, "SELECT 'L2_' || vec_id AS \"from\", 'L1_' || vec_id AS \"to\" FROM embeddings WHERE vec_id % 25 = 0 UNION ALL SELECT 'L1_' || vec_id, 'L0_' || vec_id FROM embeddings WHERE vec_id % 5 = 0"),
    "layer_edges": (layer_edges, f"{EDGES} SELECT src, dst FROM s WHERE src % 5 = 0 AND dst % 5 = 0"),
    "split_by_position": (split_by_position, "SELECT CASE WHEN vec_id < 150 THEN 'train' ELSE 'query' END AS part, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1"),
    "fail_counter": (
        fail_counter,
        f"{WITH.replace('WITH v', 'WITH RECURSIVE v')}, s AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS step, {SQUARED} AS d FROM v, q), w AS (SELECT query_id, 0::BIGINT AS step, 'inf'::DOUBLE AS best, 0 AS fails FROM q UNION ALL SELECT w.query_id, s.step, CASE WHEN best - d >= 0.1 THEN d ELSE best END, CASE WHEN best - d >= 0.1 THEN 0 ELSE fails + 1 END FROM w JOIN s ON s.query_id = w.query_id AND s.step = w.step + 1 WHERE fails < 3) SELECT query_id, coalesce(max(step) FILTER (fails >= 3), 0)::INT AS stopped, round(arg_max(best, step), 6) AS best FROM w GROUP BY 1",
    ),
    "index_increments": (index_increments, f"{CENTROIDS}, {NEAR} SELECT cid, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM near WHERE r = 1 GROUP BY 1"),
    "retrieval_quality": (retrieval_quality, f"{GRADED} SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM quality"),
    "retrieval_summary": (retrieval_summary, f"{GRADED} SELECT count(*) AS queries, round(avg(round(reciprocal_rank, 6)), 6) AS reciprocal_rank, round(avg(round(precision, 6)), 6) AS precision, round(avg(round(recall, 6)), 6) AS recall, round(avg(round(ndcg, 6)), 6) AS ndcg FROM quality"),
    "layered_graph_topk": (layered_graph, None),
    "layered_graph_stream": (layered_growth, None),
    "stream_first_wins": (duplicate_stream, None),
    "stream_telemetry": (telemetry_stream, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_micro_batches": (micro_batches, "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents"),
}
