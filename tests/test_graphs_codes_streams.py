"""Layered graphs that grow, distance tables, many lists, ranks under ties, streams with state."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecflow.operators import dedup, indexes, layered, product_codes, search, statistics
from vecflow.streaming import ingest
from vecflow.workspace import workdir


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    return r.normal(size=(1200, 16)) + 2 * r.normal(size=(12, 16)).repeat(100, axis=0)


@pytest.fixture(scope="module")
def vectors(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, v array<double>").cache()


def exact(points, x, k):
    return np.lexsort((np.arange(len(points)), np.square(points - x).sum(axis=1)))[:k].tolist()


def share(rows, points, k):
    hits = [r.vec_id in exact(points, points[r.query_id], k) for r in rows]
    return sum(hits) / (k * len({r.query_id for r in rows}))


def test_layers_are_connected_and_found():
    points = np.random.default_rng(6).normal(size=(1500, 8))
    graph = layered.LayeredGraph(8)
    graph.extend(np.arange(1500), points)
    assert len(graph.links) > 1 and [len(x) for x in graph.links] == sorted((len(x) for x in graph.links), reverse=True)
    for layer, nodes in enumerate(graph.links):
        assert graph.reached(layer) == set(nodes) or graph.entry not in nodes
        assert sum(len(x) > graph.most(layer) for x in nodes.values()) <= 0.02 * len(nodes) + 1
    asked = range(0, 1500, 20)

    def measured(walk):
        """Nodes that the smallest beam of recall 0.95 measures."""
        for ef in range(10, 200, 4):
            found = [walk(points[q], ef) for q in asked]
            if np.mean([len({i for _, i in best[:10]} & set(exact(points, points[q], 10))) / 10 for q, (best, _) in zip(asked, found)]) >= 0.95:
                return np.mean([n for _, n in found])

    starts, targets, entry = search._linked(points, 24)
    assert measured(lambda x, ef: graph.search(x, 10, ef)) < 0.75 * measured(lambda x, ef: search.walk(points, starts, targets, entry, x, ef))
    again = layered.LayeredGraph.unpacked(graph.packed())
    assert again.links == graph.links and again.ids == graph.ids and again.levels == graph.levels and (again.points == graph.points).all()


def test_mend_links_what_no_walk_meets():
    graph = layered.LayeredGraph(1, m=2, beam=4)
    graph.extend(np.arange(40), np.arange(40.0)[:, None])
    for nodes in graph.links:
        for i in nodes:
            nodes[i] = [j for j in nodes[i] if (j < 20) == (i < 20)]
    assert graph.reached(0) != set(range(40))
    graph.mend()
    assert graph.reached(0) == set(range(40)) and graph.search(np.array([39.0]), 1, 8)[0][0][1] == 39


def test_odd_graphs():
    empty = layered.LayeredGraph(4)
    assert empty.search(np.zeros(4), 3, 8) == ([], 0)
    same = layered.LayeredGraph(2)
    same.extend(np.array([5, 5, 7]), np.zeros((3, 2)))
    assert sorted(i for _, i in same.search(np.zeros(2), 3, 8)[0]) == [0, 1, 2]


def test_graph_grown_in_batches_finds_as_much(spark, vectors, points, monkeypatch):
    monkeypatch.setattr(layered, "SHARD_ROWS", 500)
    lists = search.trained_lists(vectors, 2)
    queries = vectors.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    once = layered.GraphStore(spark, workdir(spark, "test-graph")).create(lists)
    once.append(vectors, 0)
    source, uri, state = (workdir(spark, n) for n in ("test-in", "test-graph", "test-state"))
    grown = layered.GraphStore(spark, uri).create(lists)
    for part in range(2):  # a restart between
        vectors.filter(F.col("vec_id") % 2 == part).repartition(5, "vec_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema("vec_id long, v array<double>").option("maxFilesPerTrigger", 1).parquet(source)
        layered.GraphStore(spark, uri).grow(stream, state)
    grown.append(vectors.filter("vec_id < 0"), 99)  # nothing
    sizes = grown.shards().select("cid", "part", "n").collect()
    assert sum(x.n for x in sizes) == 1200 == once.shards().agg(F.sum("n")).first()[0] and len(sizes) >= 3 and max(x.n for x in sizes) < 1000
    recalls = [share(s.search(queries, 10, nprobe=2).collect(), points, 10) for s in (once, grown)]
    assert min(recalls) >= 0.95 and abs(recalls[0] - recalls[1]) < 0.03
    before = sum(x.n for x in sizes)
    grown.append(vectors.limit(10).withColumn("vec_id", F.col("vec_id") + 5000), 100)
    grown.append(vectors.limit(10).withColumn("vec_id", F.col("vec_id") + 5000), 100)  # tried again
    assert grown.shards().agg(F.sum("n")).first()[0] == before + 10


def test_layered_index(vectors, points):
    index = indexes.LayeredIndex().fit(vectors.filter("vec_id < 1100"))
    index.add(vectors.filter("vec_id >= 1100"))
    rows = index.search(vectors.filter("vec_id % 100 = 3").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 5).collect()
    assert share(rows, points, 5) >= 0.95 and index.memory_bytes() > 0


def test_counted_walk_by_hand():
    away = {0: 5.0, 1: 4.0, 2: 4.0, 3: 3.9, 4: 1.0, 5: 6.0, 6: 7.0, 7: 8.0}
    links = {0: [1, 2], 1: [0, 3, 4], 2: [0], 3: [], 4: [5, 6, 7], 5: [0], 6: [], 7: []}
    walk = lambda **how: layered.counted_walk(away.get, links.get, 0, 3, **how)
    assert walk(tau=9) == ([(1.0, 4), (3.9, 3), (4.0, 1)], 8)
    best, visited = walk(tau=3)  # 5, 6 and 7 fail one after the other: it ends at 7, which is not kept
    assert best == [(1.0, 4), (3.9, 3), (4.0, 1)] and visited == 8
    assert walk(tau=2) == ([(1.0, 4), (3.9, 3), (4.0, 1)], 7) and walk(tau=1) == ([(4.0, 1), (5.0, 0)], 3)
    plateau = layered.counted_walk(lambda i: 1.0, lambda i: [(i + 1) % 10_000], 0, 5)
    assert plateau == ([(1.0, 0), (1.0, 1), (1.0, 2)], 4) or plateau[1] == 4
    cycle = layered.counted_walk(lambda i: 10.0 - i, lambda i: [(i + 1) % 3], 0, 5, tau=100)
    assert cycle == ([(8.0, 2), (9.0, 1), (10.0, 0)], 3)


def test_distance_tables():
    r = np.random.default_rng(1)
    words = [r.normal(size=(7, 3)), r.normal(size=(5, 4))]
    codes = np.stack([r.integers(0, 7, 50), r.integers(0, 5, 50)], axis=1)
    q = r.normal(size=(300, 7))
    whole = np.concatenate([words[0][codes[:, 0]], words[1][codes[:, 1]]], axis=1)
    assert np.allclose(product_codes.table_distances(product_codes.distance_tables(q, words), codes), np.square(q[:, None] - whole[None]).sum(axis=2))


def test_codes_of_odd_vectors(spark):
    rows = [(1, [0.0, 0.0, 9.0]), (2, None), (3, [1.0]), (None, [0.1, 0.2, 8.0])]
    book = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [5.0, 5.0]), (1, 0, [9.0])], "m int, code int, c array<double>")
    coded = product_codes.encoded(spark.createDataFrame(rows, "vec_id long, v array<double>"), book)
    assert [(x.vec_id, x.codes) for x in coded.collect()] == [(1, [0, 0]), (2, None), (3, None), (None, [0, 0])]
    asked = spark.createDataFrame([(7, [5.0, 5.0, 9.0]), (8, None), (9, [1.0])], "query_id long, q array<double>")
    assert [(x.query_id, x.vec_id, x.distance) for x in product_codes.nearest_coded(asked, coded, book, 3).collect()] == [(7, 1, 50.0)]


def test_ivf_pq_with_reranking(vectors, points):
    index = indexes.IvfPqIndex(8, 8, 64, 6).fit(vectors)
    queries = vectors.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pool = index.search(queries, 60)
    assert share(search.reranked(pool.select("query_id", "vec_id"), queries, vectors, 10).collect(), points, 10) >= 0.9


def test_very_many_lists():
    r = np.random.default_rng(2)
    centroids, x = r.normal(size=(65_536, 8)), r.normal(size=(400, 8))
    ids = r.permutation(65_536)
    lists = product_codes.CoarseLists(ids, centroids)
    got = lists.nearest(x, 3)
    for row, p in zip(got, x):
        d = np.square(centroids - p).sum(axis=1)
        assert row.tolist() == ids[np.lexsort((ids, d))[:3]].tolist()
    tied = product_codes.CoarseLists(np.array([4, 2, 9]), np.array([[0.0], [0.0], [5.0]]))
    assert tied.nearest(np.array([[0.0], [9.0]]), 5).tolist() == [[2, 4, 9], [9, 2, 4]]


def test_mixed_lengths_are_searched_whatever_the_partitions(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=(4, 6, 6, 9)[i % 4]).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asked = df.filter("vec_id in (0, 1, 3)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    want = {q: sorted((float(np.square(np.array(v) - rows[q][1]).sum()), i) for i, v in rows if len(v) == len(rows[q][1]))[:5] for q in (0, 1, 3)}
    for parts in (1, 4, 64):
        got = search.nearest(asked, df.repartition(parts), 5).orderBy("query_id", "rank").collect()
        assert [(x.query_id, x.vec_id) for x in got] == [(q, i) for q in want for _, i in want[q]]


@pytest.mark.parametrize("small", [0, 10**6])
def test_percentiles_under_ties(spark, monkeypatch, small):
    monkeypatch.setattr(statistics, "SMALL", small)
    r = np.random.default_rng(8)
    values = {"a": r.integers(0, 3, 3000) * 1.5, "b": r.normal(size=1001), None: np.array([7.0]), "c": np.array([2.0, 2.0])}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {x.group: x for x in statistics.percentiles(df, "g", "x", [0.0, 0.5, 0.99, 1.0]).collect()}
    assert set(got) == set(values)
    for g, v in values.items():
        assert np.allclose([got[g].p0, got[g].p1, got[g].p2, got[g].p3], np.quantile(v, [0, 0.5, 0.99, 1]))
    floors = {x.group: x.value for x in statistics.at_floor_rank(df, "g", "x", 0.95).collect()}
    assert floors == {g: float(np.sort(v)[int(len(v) * 0.95)]) for g, v in values.items()}


def test_a_constant_column_takes_no_room(spark):
    df = spark.range(10_000_000).selectExpr("'all' AS g", "2.5D AS x")
    began = time.time()
    assert statistics.percentiles(df, "g", "x", [0.5]).collect()[0].p0 == 2.5
    ranks = statistics.value_ranks(df, "g", "x").collect()
    assert [(x.n, x.before, x.total) for x in ranks] == [(10_000_000, 0, 10_000_000)] and time.time() - began < 60


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("'all' AS g", "cast(id * 7919 % 1000 as double) AS x").repartition(16)
    rows = sorted((x.value, x.n, x.before, x.total) for x in statistics.value_ranks(df, "g", "x").collect())
    assert rows == [(float(i), 5, 5 * i, 5000) for i in range(1000)]


def test_first_wins_goes_on_over_batches_and_restarts(spark):
    r = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in r.integers(0, 500, 30)) for _ in range(60)]
    texts = [base[i] if i < 60 else base[r.integers(0, 60)] if r.random() < 0.7 else " ".join(f"w{x}" for x in r.integers(0, 500, 30)) for i in range(240)]
    texts[100], texts[200] = None, ""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(x.doc_id, x.kept) for x in dedup.greedy_first_wins(docs, reset_every=90).collect()}
    source, target, state = (workdir(spark, n) for n in ("test-docs", "test-kept", "test-state"))
    for a, e in ((0, 130), (130, 131), (131, 240)):
        for b in range(a, e, 60):
            docs.filter((F.col("doc_id") >= b) & (F.col("doc_id") < min(b + 60, e))).withColumn("n", F.col("doc_id")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string, n long").option("maxFilesPerTrigger", 1).parquet(source)
        ingest.ingest(ingest.first_wins(stream, reset_every=90), target, state)
    got = [(x.doc_id, x.kept) for x in spark.read.schema("doc_id long, kept boolean").parquet(target).collect()]
    assert len(got) == 240 and set(got) == want and 60 < sum(k for _, k in got) < 200


def test_telemetry_with_late_rows_and_a_restart(spark):
    def batch(rows, source):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts AS timestamp) AS ts", "event_type", "value").coalesce(1).write.mode("append").parquet(source)

    first = [("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0), (None, "a", 9.0)]
    second = [("2024-01-01 00:55:00", "a", 4.0), ("2024-01-01 04:00:00", "a", 5.0)]  # the first is late, but within the delay
    third = [("2024-01-01 00:30:00", "a", 100.0), ("2024-01-01 01:30:00", "b", 100.0), ("2024-01-01 09:00:00", "a", 6.0)]  # two behind the watermark
    schema = "ts timestamp, event_type string, value double"
    for mode in ("append", "update"):
        source, target, state = (workdir(spark, n) for n in ("test-events", "test-windows", "test-state"))
        dropped = 0
        for rows in (first, second, third):  # a run each, from the checkpoint of the one before
            batch(rows, source)
            dropped += ingest.telemetry(spark.readStream.schema(schema).parquet(source), target, state, "1 hour", "30 minutes", mode)["dropped"]
        got = sorted((str(x.start)[11:13], x.event_type, x.n, x.total) for x in ingest.latest(spark, target).collect())
        closed = [("00", "a", 3, 7.0), ("01", "b", 1, 3.0), ("04", "a", 1, 5.0)]
        assert got == (closed if mode == "append" else [*closed, ("09", "a", 1, 6.0)]) and dropped == 2
        if mode == "append":  # each window once
            assert spark.read.schema(ingest.WINDOWS).parquet(target).count() == 3
    with pytest.raises(ValueError):
        ingest.telemetry(None, "", "", "1 hour", "1 hour", "complete")


def test_graded_quality_by_hand(spark):
    from vecflow.evaluation import graded_quality

    found = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 1), (2, 1, 2), (2, 2, 2), (3, 1, 0)], "query_id long, rank int, grade int")
    there = spark.createDataFrame([(1, [1, 3]), (2, [2, 0]), (3, [0, 0]), (4, [5, 5])], "query_id long, there array<long>")
    rows = {r.query_id: r for r in graded_quality(found, there, 3).collect()}
    log = lambda r: np.log2(r + 1)
    assert rows[1].reciprocal_rank == 0.5 and rows[1].precision == 0.666667 and rows[1].recall == 0.5
    assert abs(rows[1].ndcg - (3 / log(2) + 1 / log(3)) / (3 / log(1) + 1 / log(2) + 1 / log(3))) < 1e-6
    assert (rows[2].reciprocal_rank, rows[2].recall, rows[2].ndcg) == (1.0, 1.0, 1.0)
    assert all((rows[q].reciprocal_rank, rows[q].precision, rows[q].recall, rows[q].ndcg) == (0.0, 0.0, 0.0, 0.0) for q in (3, 4))


def test_rows_are_held_until_a_lot_is_full(spark):
    source, target, state = (workdir(spark, n) for n in ("test-in", "test-lots", "test-state"))
    buffer = lambda: ingest.Buffer(spark, target, "i long, t string", 10, lambda rows: rows.withColumn("n", F.length("t")), "i")
    for a, e in ((0, 4), (4, 27), (27, 28)):  # a restart between each
        spark.range(a, e).selectExpr("id AS i", "repeat('x', cast(id as int)) AS t").coalesce(1).write.mode("append").parquet(source)
        buffer().run(spark.readStream.schema("i long, t string").parquet(source), state)
    written = lambda: spark.read.schema("i long, n int, lot long").parquet(f"{target}/written")
    assert sorted(x.i for x in written().collect()) == list(range(20)) and {x["count"] for x in written().groupBy("lot").count().collect()} == {10}
    assert buffer().close() == 8 and buffer().close() == 0
    assert sorted((x.i, x.n) for x in written().collect()) == [(i, i) for i in range(28)]


def test_settings_and_caches(spark, tmp_path):
    from vecflow.config import PipelineConfig
    from vecflow.operators import stores

    PipelineConfig(dimension=12, extra={"a": "ü"}).save_json(f"{tmp_path}/x/settings.json")
    again = PipelineConfig.from_json(f"{tmp_path}/x/settings.json")
    assert again.dimension == 12 and again.extra == {"a": "ü"} and PipelineConfig.from_dict({"none": 1, "dimension": 3}).dimension == 3
    with pytest.raises(FileNotFoundError):
        PipelineConfig.from_json(f"{tmp_path}/none.json")
    uri = f"file://{tmp_path}/cache"
    rows, there = stores.cached_vectors(spark, uri, 7)
    assert not there and rows.count() == 100 and all(abs(np.linalg.norm(x.v) - 1) < 1e-9 for x in rows.collect())
    assert stores.first_there(spark, [(uri, "cache")], 5) is None
    spark.range(200).selectExpr("id AS vec_id", "array(1.5D) AS v").write.parquet(uri)
    assert stores.cached_vectors(spark, uri, 7)[1] and stores.cached_vectors(spark, uri, 7)[0].count() == 200
    rows, place = stores.first_there(spark, [(f"file://{tmp_path}/other", "cache"), (uri, "corpus")], 4)
    assert place == uri and [x.vec_id for x in rows.orderBy("vec_id").collect()] == [0, 20, 40, 60]
