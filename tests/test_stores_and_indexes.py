"""Stores, vector files, embedders, indexes and statistics against plain computations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecflow import evaluation
from vecflow.operators import embedding, indexes, product_codes, search, statistics, stores
from vecflow.sources import vecfiles
from vecflow.workspace import workdir


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(4)
    return r.normal(size=(8, 16))[r.integers(0, 8, 900)] * 2 + r.normal(size=(900, 16))


@pytest.fixture(scope="module")
def vectors(spark, points):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, v array<double>")
    return rows.repartition(5).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def exact(points, q, k):
    d = np.square(points - points[q]).sum(axis=1)
    return np.lexsort((np.arange(len(d)), d))[:k].tolist()


def lists(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def share(got, points, k):
    return np.mean([len(set(got[q]) & set(exact(points, q, k))) / k for q in got])


def test_exact_search_has_every_tie_and_skips_odd_rows(spark, vectors, queries, points, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "CHUNK", 64)
    odd = spark.createDataFrame([(2000, None), (2001, [1.0]), (2002, [float("nan")] * 16), (None, points[0].tolist()), (2003, points[30].tolist()), (2004, points[30].tolist())], "vec_id long, v array<double>")
    got = lists(search.nearest(queries, vectors.unionByName(odd), 5))
    with_twins = lambda ids: [j for i in ids for j in ([30, 2003, 2004] if i == 30 else [i])][:5]
    assert all(got[q] == with_twins(exact(points, q, 5)) for q in range(0, 900, 30)) and got[30][:3] == [30, 2003, 2004]
    assert lists(search.nearest(queries, vectors, 5, "cosine"))[0][0] == 0
    inner = lists(search.nearest(queries, vectors, 3, "ip"))
    assert all(inner[q] == np.lexsort((np.arange(900), -points @ points[q]))[:3].tolist() for q in inner)
    assert search.nearest(queries.filter("false"), vectors, 5).count() == 0 and search.nearest(queries, vectors.filter("false"), 5).count() == 0


def test_search_within_a_key(spark, vectors, queries, points):
    keyed = vectors.withColumn("part", F.when(F.col("vec_id") != 5, F.col("vec_id") % 3))
    asked = queries.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2), F.lit(None), F.lit(77))))
    got = lists(search.nearest(asked, keyed, 4, on="part"))
    d = lambda q: [i for i in np.argsort(np.square(points - points[q]).sum(axis=1), kind="stable").tolist() if i % 3 and i != 5][:4]
    assert all(got[q] == d(q) for q in range(0, 900, 30))


def test_graph_search_depends_on_its_edges(vectors, queries, points):
    starts, targets, entry = search._linked(points, 12)
    reached, measured = zip(*(search.walk(points, starts, targets, entry, points[q], 48) for q in range(0, 900, 30)))
    found = np.mean([len({i for _, i in best[:10]} & set(exact(points, q, 10))) / 10 for q, best in zip(range(0, 900, 30), reached)])
    assert found > 0.9 and np.mean(measured) < 0.8 * len(points)
    nothing, alone = search.walk(points, np.zeros(901, int), np.zeros(0, int), entry, points[0], 48)
    assert [i for _, i in nothing] == [entry] and alone == 1  # without edges only the entry is met
    early = search.walk(points, starts, targets, entry, points[0], 48, search.EarlyExit(2, 1e-4, 4))[1]
    assert early <= measured[0]
    two = np.concatenate([points[:40], points[:40] + 1000])  # components that only the entry joins
    s, t, e = search._linked(two, 3)
    assert search.walk(two, s, t, e, two[60], 8)[0][0][1] == 60


def test_sharded_graphs(vectors, queries, points, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 200)
    c = search.few_lists(search.trained_lists(vectors, 5))
    graph = search.graph_index(vectors, c, 12)
    assert graph.agg(F.sum("n"), F.max("n")).first()[0] == 900 and graph.count() >= 5
    whole = search.graph_search(queries, graph, c, 10, nprobe=5)
    some = search.graph_search(queries, graph, c, 10, nprobe=2)
    assert share(lists(whole), points, 10) > 0.9 and share(lists(some), points, 10) > 0.6
    assert whole.agg(F.max("measured")).first()[0] <= 400


def test_trained_quantizers(vectors, points):
    book = search.trained_codebook(vectors, 4, 64)
    def error(book):
        words = book.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("code", "c")))["c"].alias("w")).orderBy("m").collect()
        codes = np.array([r.codes for r in product_codes.encoded(vectors, book).orderBy("vec_id").collect()])
        back = np.concatenate([np.array(r.w)[codes[:, r.m]] for r in words], axis=1)
        return np.square(back - points).mean()

    assert error(book) < 0.6 * error(search.codebook(vectors, 4, 16, 16))
    with pytest.raises(ValueError):
        search.trained_codebook(vectors, 4, 257)
    assert search.kmeans(points[:3], 5).shape == (5, 16)
    centroids = search.kmeans(points, 8)
    own = np.square(points[:, None] - centroids).sum(axis=2).argmin(axis=1)
    assert len(set(own.tolist())) == 8 and np.allclose(centroids[0], points[own == 0].mean(axis=0), atol=0.2)
    assert len(search.kmeans(np.array([[0.0]] * 9 + [[5.0]]), 2)) == 2


def test_indexes_keep_to_their_interface(vectors, queries, points):
    rows = evaluation.comparison(vectors, queries, 10, [indexes.FlatIndex(), indexes.IvfPqIndex(8, 8, 256, 4), indexes.GraphIndex(), indexes.TwoTierIndex()], repeats=1)
    by = {r["index"]: r for r in rows}
    assert by["flat"]["recall_percent"] == 100 and by["graph"]["recall_percent"] > 90 and by["two_tier"]["recall_percent"] > 85 and by["ivf_pq"]["recall_percent"] > 60
    assert [r["qps"] for r in rows] == sorted((r["qps"] for r in rows), reverse=True) and by["flat"]["bytes"] == 4 * 900 * 16
    assert evaluation.report(rows, vectors.sparkSession).count() == 4
    with pytest.raises(ValueError):
        indexes.FlatIndex("other")
    some = evaluation.grid(vectors, queries, 5, taus=(2,), epsilons=(1e-4,), factors=(1, 3))
    assert len(some) == 3 and max(r["recall_percent"] for r in some if r["tau"] is None) > 85
    text = stores.to_markdown(rows)
    assert text.count("\n") == 5 and "two_tier" in text and r"two\_tier" in stores.to_latex(rows) and stores.to_markdown([]) == ""


def test_vector_store(spark):
    store = stores.VectorStore(spark, workdir(spark, "test-store"), 3, capacity=5)
    batch = lambda *ids: spark.createDataFrame([(i, [float(i)] * 3) for i in ids], "id long, v array<double>")
    assert store.count() == 0 and store.append(batch(9, 4), "id") == (0, 2) and store.append(batch(1), "id") == (2, 3)
    assert [(r.idx, r.v[0]) for r in store.between(0, 9).orderBy("idx").collect()] == [(0, 4.0), (1, 9.0), (2, 1.0)]
    with pytest.raises(OverflowError):
        store.append(batch(5, 6, 7), "id")
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1, [1.0]), (2, None)], "id long, v array<double>"), "id")
    assert store.append(batch(), "id") == (3, 3) and store.count() == 3


def test_shards_go_on_where_they_ended(spark):
    writer = stores.ShardWriter(spark, workdir(spark, "test-shards"), "id long, t string", 4)
    rows = lambda a, e: spark.createDataFrame([(i, f"t{i}") for i in range(a, e)], "id long, t string")
    assert writer.manifest().count() == 0
    for a, e in ((0, 6), (6, 7), (7, 13)):
        writer.write(rows(a, e), "id")
    assert {r.shard_id: r.records for r in writer.manifest().collect()} == {0: 4, 1: 4, 2: 4, 3: 1}
    assert sorted((r.shard_id, r.id) for r in writer.rows().collect()) == [(i // 4, i) for i in range(13)]


def test_record_files_are_split(spark, tmp_path):
    x = np.arange(24, dtype="f4").reshape(6, 4)
    (tmp_path / "a.fvecs").write_bytes(vecfiles.encode_records(x, "f") + b"\x04\0\0")
    (tmp_path / "b.fvecs").write_bytes(b"")
    reader = vecfiles.RecordReader({"path": f"file://{tmp_path}", "splitbytes": "45"})
    assert [p.value[2:] for p in reader.partitions()] == [(0, 2), (2, 4), (4, 6)]
    got = vecfiles.read_records(spark, f"file://{tmp_path}/*.fvecs").orderBy("pos").collect()
    assert [r["values"] for r in got] == x.tolist()
    assert vecfiles.read_records(spark, f"file://{tmp_path}/a.fvecs", most=2).count() == 2 and vecfiles.read_records(spark, f"file://{tmp_path}/b.fvecs").count() == 0
    bundle = workdir(spark, "test-bundle")
    rows = spark.createDataFrame([(i, [float(i), 1.0], [i, i + 1]) for i in range(9)], "id long, v array<double>, near array<long>")
    vecfiles.write_records(rows, f"{bundle}/base", "id", "v")
    vecfiles.write_records(rows.filter("id < 2"), f"{bundle}/query", "id", "v")
    vecfiles.write_records(rows.filter("id < 2"), f"{bundle}/groundtruth", "id", "near", "i")
    got = vecfiles.dataset(spark, bundle, max_base=100)
    assert {k: v.count() for k, v in got.items()} == {"base": 9, "query": 2, "groundtruth": 2}
    assert sorted(r["values"] for r in got["groundtruth"].collect()) == [[0, 1], [1, 2]]


def test_embedders(spark):
    given = ["một câu", "", None, "một câu"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [np.array(r.v) for r in embedding.embedded(rows, embedding.HashEmbedder(8), "t").orderBy("i").collect()]
    seed = int(hashlib.md5("một câu".encode()).hexdigest()[:8], 16) % 2**31
    want = np.random.RandomState(seed).randn(8).astype("f4")
    assert np.allclose(got[0], want / np.linalg.norm(want)) and (got[0] == got[3]).all() and (got[1] == got[2]).all()
    words = embedding.TermEmbedder(64).encode(["a b c", "a b d", "x y z", ""])
    assert words[0] @ words[1] > 0.5 > words[0] @ words[2] and not words[3].any()
    cut = embedding.WordSegmenter(lambda t: list(t)).tokens(F.col("t"))
    plain = embedding.WordSegmenter().tokens(F.col("t"))
    one = rows.select(cut.alias("a"), plain.alias("b"), embedding.WhitespaceTokenizer().tokens(F.col("t")).alias("c")).first()
    assert one.a == list("một câu") and one.b == one.c == ["một", "câu"]


@pytest.mark.parametrize("small", [10_000, 5])
def test_percentiles_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(statistics, "SMALL", small)
    r = np.random.default_rng(1)
    groups = {"a": r.exponential(size=4001), "b": r.integers(0, 5, 2000).astype(float), "c": np.array([3.0]), None: r.normal(size=3000)}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("d", None)], "g string, x double").repartition(4)
    got = {row.group: row for row in statistics.percentiles(rows, "g", "x", [0.5, 0.95, 0.99]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose([got[g].p0, got[g].p1, got[g].p2], np.percentile(v, [50, 95, 99]))
    floors = {row.group: row.value for row in statistics.at_floor_rank(rows, "g", "x", 0.95).collect()}
    assert floors == {g: float(np.sort(v)[int(len(v) * 0.95)]) for g, v in groups.items()}


def test_flat_matrices(spark, tmp_path):
    x = np.arange(60, dtype="f4").reshape(12, 5)
    (tmp_path / "a.bin").write_bytes(x.tobytes())
    (tmp_path / "b_int8.bin").write_bytes(x.astype("i1").tobytes())
    read = lambda name, **how: [(r.pos, r["values"]) for r in vecfiles.read_flat(spark, f"file://{tmp_path}/{name}", 5, **how).orderBy("path", "pos").collect()]
    assert read("a.bin") == read("b_int8.bin") == list(enumerate(x.tolist()))
    assert read("a.bin", rows=(3, 99), columns=(1, 3)) == [(i, x[i, 1:3].tolist()) for i in range(3, 12)]
    reader = vecfiles.FlatReader({"path": f"file://{tmp_path}/a.bin", "dimension": "5", "splitbytes": "50", "from": "1"})
    assert [p.value[2:] for p in reader.partitions()] == [(1, 3), (3, 5), (5, 7), (7, 9), (9, 11), (11, 12)]
    with pytest.raises(ValueError):
        vecfiles.FlatReader({"path": "", "dimension": "5", "last": "6"})
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (2, None)], [(1, [1.0]), (2, [None])]):
        with pytest.raises(Exception, match="one length"):
            vecfiles.write_records(spark.createDataFrame(bad, "id long, v array<double>").coalesce(1), workdir(spark, "test-bad"), "id", "v")


def test_gathered_reads_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    x = np.arange(3000, dtype="f4").reshape(1000, 3)
    (tmp_path / "a.f32").write_bytes(x[:400].tobytes())
    (tmp_path / "b.f32").write_bytes(x[400:].tobytes())
    asked = [(1, 5), (2, 399), (3, 400), (4, 999), (5, 5), (6, 1000), (7, -1), (8, None), (9, 700)]
    got = vecfiles.gathered(spark.createDataFrame(asked, "pos long, idx long"), f"file://{tmp_path}", 3, gap_bytes=0).orderBy("pos").collect()
    assert [(r.pos, r.v) for r in got] == [(p, x[i].tolist()) for p, i in asked if i is not None and 0 <= i < 1000]


def test_the_newest_committed_version_counts(spark, tmp_path):
    uri = f"file://{tmp_path}/table"
    now = stores.replaced(spark.createDataFrame([(1,)], "i int"), uri)
    stores.replaced(spark.createDataFrame([(2,)], "i int"), uri)
    assert now.collect()[0].i == 1 and stores.current(spark, uri, "i int").collect()[0].i == 2
    (tmp_path / "table" / "versions" / "000001" / "_SUCCESS").unlink()  # as if its writer had died
    assert stores.current(spark, uri, "i int").collect()[0].i == 1
    assert stores.replaced(spark.createDataFrame([(3,)], "i int"), uri).collect()[0].i == 3
    assert (tmp_path / "table" / "versions" / "000002").exists()


def test_table_search_in_sql(spark, vectors, points):
    from vecflow.plans import sqlfunctions

    sqlfunctions.register_table_search(spark, embedding.TermEmbedder(16))
    uri = sqlfunctions.store_vector_index(vectors)
    rows = [(1, points[0].tolist()), (2, None), (None, points[1].tolist()), (4, [1.0]), (5, points[7].tolist())]
    spark.createDataFrame(rows, "query_id long, q array<double>").createOrReplaceTempView("asked")
    for how in ("FLOAT32_EXACT", "SQ8_UINT8"):
        got = spark.sql(f"SELECT * FROM vector_search_of(queries => TABLE(asked) PARTITION BY query_id, index => '{uri}', metric => 'l2', k => 6, quantization => '{how}', min_rerank_k => 60)").collect()
        assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (1, 5)} == {1: exact(points, 0, 6), 5: exact(points, 7, 6)} and len(got) == 12
    text = spark.sql(f"SELECT vec_id FROM vector_search_of(queries => TABLE(SELECT 1L AS query_id, embed('a b c') AS q), index => '{uri}', metric => 'cosine', k => 3, quantization => 'FLOAT32_EXACT', min_rerank_k => 0)").collect()
    assert len(text) == 3
