"""Similar pairs, signatures and the streams of duplicates that are built on them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecflow.functions import text as T
from vecflow.operators import dedup


def _texts():
    """Near copies, copies, short texts and texts of common words, under ids in no order."""
    r = np.random.default_rng(11)
    words = [f"w{x}" for x in range(400)]
    texts = [" ".join(r.choice(words, r.integers(4, 120))) for _ in range(120)]
    for i in range(60):
        own = texts[i].split()
        own[r.integers(0, len(own))] = "other"
        texts.append(" ".join(own))
    texts += [texts[3], texts[130], "a b", "b a", "a b", " a  b ", "a", "", None, None]
    texts += [" ".join(r.choice(["common", "words", "only"], 60)) for _ in range(12)]
    return list(zip(r.permutation(len(texts)).tolist(), texts))


def _sets(rows):
    first = {}
    for i, t in sorted(rows):
        if t is not None:
            first.setdefault(t, i)
    cut = {i: t.split() for t, i in first.items()}
    return {i: {" ".join(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else set(w) for i, w in cut.items() if w}


def test_similar_pairs_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_WORDS", 50)
    monkeypatch.setattr(dedup, "ORDER_SHARE", 1)
    rows = _texts()
    sets = _sets(rows)
    for threshold in (0.5, 0.75, 1.0):
        share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
        want = {(a, b, round(j, 6)) for (a, b), j in share.items() if j >= threshold}
        got = [tuple(x) for x in dedup.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) >= (2 if threshold == 1 else 30)


def test_whole_sets_are_moved_for_similar_texts_only(spark):
    """Texts of one length that share their rarest shingle pass the prefix filter, but not their sketches."""
    rows = [(i, "rare shingle here " + " ".join(f"x{i}y{j}" for j in range(300))) for i in range(40)]
    rows += [(40 + i, t.replace("y7", "z7")) for i, t in rows[:3]]
    hashes = dedup._shingle_hashes(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = spark.createDataFrame([(a, b) for a in range(43) for b in range(a + 1, 43)], "a long, b long")
    left = {tuple(x) for x in dedup._may_be_similar(pairs, dedup._sketches(hashes), 0.75).collect()}
    assert left >= {(0, 40), (1, 41), (2, 42)} and len(left) <= 6


@pytest.mark.parametrize("k", [1, 3])
def test_signatures_are_those_of_the_hash_function(spark, monkeypatch, k):
    monkeypatch.setattr(dedup, "HASH_WORDS", 64)
    docs = spark.createDataFrame([(i, t) for i, t in _texts() if i % 3 == 0] + [(9999, None), (9998, " "), (9997, "é ü ü")], "doc_id long, text string")
    words = F.array_distinct(T.shingles(T.tokens(F.col("text")), k))
    plain = docs.select("doc_id", F.explode(words).alias("t")).groupBy("doc_id").agg(F.array(*[F.min(F.xxhash64("t", F.lit(i))) for i in range(dedup.BANDS * dedup.ROWS)]).alias("m"))
    want = {x.doc_id: list(x.m) for x in plain.collect()}
    got = {x.doc_id: x.m and list(x.m) for x in docs.select("doc_id", dedup.signature(F.col("text"), k).alias("m")).collect()}
    assert {i for i, m in got.items() if m is None} == set(got) - set(want) and {i: m for i, m in got.items() if m} == want
    bands = {}
    for x in dedup.banded(docs, k).collect():
        bands.setdefault(x.doc_id, set()).add((x.band, x.bucket))
    assert set(bands) == set(want) and all(len(b) == dedup.BANDS for b in bands.values())


def test_stream_of_duplicates_runs_in_order_and_over_many_files(spark, monkeypatch):
    """Each run is behind the one before, and its files are as many as there are partitions, not one."""
    from vecflow.plans import catalogue
    from vecflow.streaming import ingest

    runs, plain = [], ingest.ingest

    def noted(stream, target, checkpoint):
        plain(stream, target, checkpoint)
        runs.append({f for f in os.listdir(sources[0]) if f.endswith(".parquet")})

    sources, read = [], ingest.file_stream
    monkeypatch.setattr(ingest, "file_stream", lambda spark, folder, schema: sources.append(folder.removeprefix("file://")) or read(spark, folder, schema))
    monkeypatch.setattr(ingest, "ingest", noted)
    small = "/root/testdata/sf0.01"
    got = catalogue.queries()["stream_first_wins"](spark, small).collect()
    want = catalogue.queries()["dedup_greedy_stream"](spark, small).collect()
    assert sorted((x.doc_id, x.kept) for x in got) == sorted((x.doc_id, x.kept) for x in want) and len(got) == 1000
    last, before = -1, set()
    for files in runs:
        n = [x.n for x in spark.read.parquet(*[f"{sources[0]}/{f}" for f in files - before]).select("n").collect()]
        assert n and min(n) == last + 1
        last, before = max(n), files
    assert len(runs) == 4 and last == 999


def test_queries_of_a_sql_search_are_dealt_over_tasks(spark, monkeypatch):
    """Eight buckets, one task for a small table, whatever the number of queries, before."""
    from vecflow.plans import catalogue, sqlfunctions

    want = sorted(map(tuple, catalogue.queries()["sql_search_coded"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(sqlfunctions, "TASK_QUERIES", 1)
    monkeypatch.setattr(sqlfunctions, "CHUNK", 60)
    rows = catalogue.queries()["sql_search_coded"](spark, "/root/testdata/sf0.001")
    assert rows.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 5
    assert sorted(map(tuple, rows.collect())) == want and len(want) == 100


def test_distances_lie_in_memory_in_bounded_blocks(monkeypatch):
    """A block of 1,024 queries and 16,384 vectors took several matrices of 134 MB."""
    import tracemalloc

    from vecflow.operators import search

    r = np.random.default_rng(2)
    q, x = r.normal(size=(1024, 8)), r.normal(size=(16_384, 8))
    q[5], x[7] = np.nan, np.nan
    x[900:903] = x[10]  # ties at the edge
    for metric in ("l2", "cosine", "ip"):
        tracemalloc.start()
        got = search._near(metric, q, x, 4)
        assert tracemalloc.get_traced_memory()[1] < 150e6
        tracemalloc.stop()
        monkeypatch.setattr(search, "PRODUCT", 1 << 30)
        whole = search._near(metric, q, x, 4)
        monkeypatch.undo()
        assert all((a == b).all() for a, b in zip(got, whole)) and len(got[0]) >= 4 * 1023


def test_graph_files_hold_a_bounded_number_of_nodes(spark, monkeypatch):
    from vecflow.plans import catalogue, stores
    from vecflow.sources import vecfiles

    want = sorted(map(tuple, catalogue.queries()["knn_graph_edges"](spark, "/root/testdata/sf0.001").collect()))
    sizes, plain = [], stores.workdir
    monkeypatch.setattr(stores, "GRAPH_NODES", 7)
    monkeypatch.setattr(stores, "workdir", lambda *a: sizes.append(plain(*a)) or sizes[-1])
    assert sorted(map(tuple, catalogue.queries()["graphfile_roundtrip"](spark, "/root/testdata/sf0.001").collect())) == want
    files = [f"{sizes[0].removeprefix('file://')}/{f}" for f in os.listdir(sizes[0].removeprefix("file://")) if f.endswith(".graph")]
    ids = [vecfiles.decode_graph(open(f, "rb").read())[0]["ids"] for f in files]
    assert max(map(len, ids)) <= 7 and sum(map(len, ids)) == 500


def test_pages_are_parsed_a_few_at_a_time(spark):
    import pyarrow as pa
    from vecflow.sources import html

    taken, plain = [], pa.array([f"<p>{i}</p>" for i in range(200)] + [None])

    class Noted:
        def __len__(self):
            return len(plain)

        def slice(self, start, n):
            taken.append(n)
            return plain.slice(start, n)

    got = html._each(Noted(), lambda t: t and t[3:-4], pa.string()).to_pylist()
    assert got == [*map(str, range(200)), None] and max(taken) <= 64


def test_csv_files_follow_the_rows(spark, monkeypatch):
    """Four files, whatever the size, before."""
    from vecflow.plans import catalogue, stores

    made, plain = [], stores.workdir
    monkeypatch.setattr(stores, "workdir", lambda *a: made.append(plain(*a)) or made[-1])
    for size, least in (("1", 20), (str(64 << 20), 1)):
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", size)
        try:
            catalogue.queries()["csv_typed_scan"](spark, "/root/testdata/sf0.001").count()
        finally:
            for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"):
                spark.conf.unset(k)
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert least <= sum(f.endswith(".csv") for f in os.listdir(made[-1].removeprefix("file://")))


def test_signatures_are_dealt_over_tasks(spark, monkeypatch):
    """One partition of the input was one task before, and a word that a text repeats was permuted each time."""
    seen, plain = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, *a: seen.append(df) or plain(df, *a))
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.first_id for x in dedup.minhash_duplicates(docs).collect()}
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # two before
    assert seen[0].rdd.getNumPartitions() >= 8 and "array_distinct" in seen[0]._jdf.queryExecution().toString()
    whole = {}
    for x in dedup.banded(docs).collect():
        whole.setdefault((x.band, x.bucket), []).append(x.doc_id)
    want = {}
    for ids in whole.values():
        for i in ids:
            if i > min(ids):
                want[i] = min(want.get(i, i), min(ids))
    assert got == want and want
    seen.clear()
    kept = {x.doc_id: x.kept for x in dedup.greedy_first_wins(docs).collect()}
    assert seen[0].rdd.getNumPartitions() >= 8 and set(kept) == {i for i, _ in rows} and all(kept[i] for i in kept if i not in want)


def test_cleaning_is_that_of_its_steps(spark):
    rows = ["a  b", "x\x1cy", "  ", "", None, "(a)", "a - b", "é\u00a0ü\u3000.", "see HTTP://x.y/z now", "WwW.a.b c", "ww. w.", "a://b", "<b>x</b> y", "‘q’ e\u0301", "a_b\u2028,c!?", "-", "٣ ४ 中"]
    c = F.col("text")
    steps = T.collapsed(T.without_special(F.regexp_replace(T.normal(T.text_or_empty(c)), T.URL, " ")))
    docs = spark.createDataFrame([(x,) for x in rows], "text string")
    for a, b, words, plain in docs.select(T.cleaned(c), steps, T.clean_tokens(T.cleaned(c)), T.tokens(steps)).collect():
        assert a == b and words == plain


def test_a_batch_of_a_store_is_made_once(spark, tmp_path):
    """It was looked at four times and made anew three times before, with texts embedded in Python each time."""
    from vecflow.operators import embedding, stores

    made = spark.sparkContext.accumulator(0)

    class Counted(embedding.HashEmbedder):
        def encode(self, texts):
            made.add(len(texts))
            return super().encode(texts)

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    store = stores.VectorStore(spark, f"file://{tmp_path}/store", 8)
    assert store.append(embedding.embedded(docs, Counted(8), "text"), "doc_id") == (0, 50) and store.count() == 50 and made.value == 50
    want = np.random.RandomState(int(__import__("hashlib").md5(b"text 7").hexdigest()[:8], 16) % 2**31).randn(8).astype(np.float32)
    assert np.allclose(store.between(7, 8).first().v, want / np.linalg.norm(want))


def test_words_are_hashed_once(monkeypatch):
    """Each occurrence of a word had its own digest before."""
    import hashlib

    from vecflow.operators import embedding

    made = []
    monkeypatch.setattr(embedding, "word_hashes", embedding._WordHashes())
    monkeypatch.setattr(embedding.hashlib, "md5", lambda b, md5=hashlib.md5: made.append(b) or md5(b))
    texts = ["a b A c", "", "b  a", "c\u3000d"] * 50
    found = embedding.TermEmbedder(16).encode(texts)
    assert sorted(made) == [b"a", b"b", b"c", b"d"]
    for most, rows in ((2, 3), (1, 1)):
        monkeypatch.setattr(embedding, "MOST_WORDS", most)
        monkeypatch.setattr(embedding, "TERM_ROWS", rows)
        assert (embedding.TermEmbedder(16).encode(texts) == found).all()
        assert len(embedding.word_hashes) <= 4
    plain = np.zeros(16, np.float32)
    for word in ("a", "b", "a", "c"):
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        plain[h % 16] += 1 if h >> 63 else -1
    assert (found[0] == plain / np.linalg.norm(plain)).all() and not found[1].any()


def test_search_of_texts_reads_found_chunks_only(spark, monkeypatch):
    """Words of a text went with each of its chunks, and all chunks were dealt anew to meet those found."""
    from vecflow.operators import embedding
    from vecflow.plans import retrieval

    docs = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(900)), "x", "s"), (1, "w5 other", None, "s"), (2, " - ", "x", "s"), (3, None, "x", "s")], "doc_id long, text string, lang string, source string").coalesce(1)
    engine = retrieval.SemanticEngine(spark, docs, embedding.TermEmbedder(32))
    rows = {r.vec_id: r.chunk for r in engine.rows.collect()}
    assert rows == {**{c: " ".join(f"w{i}" for i in range(250 * c, min(250 * c + 300, 900))) for c in range(4)}, 100_000: "w5 other"}
    found = engine.search(spark.createDataFrame([(1, "w5 other"), (2, "")], "query_id long, text string"), 2)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    top = found.orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and (top[0].vec_id, top[0].doc_id, top[0].score, top[0].lang, top[0].preview) == (100_000, 1, 1.0, "N/A", "w5 other")


def test_greedy_duplicates_know_all_documents_before(spark):
    """Memory was emptied at each 50,000th document, so what was like a document before it was kept."""
    own = F.array(2 * F.col("id"), 2 * F.col("id") + 1)
    late = F.when(F.col("id") == 50_003, F.array(F.lit(-1), F.lit(7))).when(F.col("id") == 50_005, F.array(F.lit(8), F.lit(9))).otherwise(own)
    kept = {x.doc_id: x.kept for x in dedup.greedy_by_keys(spark.range(50_010).select(F.col("id").alias("doc_id"), late.alias("keys"))).collect()}
    assert len(kept) == 50_010 and [i for i in kept if not kept[i]] == [50_003, 50_005]


def test_greedy_duplicates_in_steps_are_those_of_a_walk(spark, monkeypatch):
    """Tasks of 64 rows at most, over a long chain (documents like the one before only) and groups that overlap."""
    monkeypatch.setattr(dedup, "AT_ONCE", 64)
    r, tasks = np.random.default_rng(5), []
    plain = dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: tasks.append(name) or plain(df, name))
    chain = [[i, i + 1] for i in range(120)]
    groups = [None if i % 40 == 7 else [1000 + int(x) for x in r.integers(0, 90, 3)] for i in range(200)]
    for rows in (chain, groups, [None, [1, 2], [2, 1], [1, 2]]):
        ids = r.permutation(len(rows)).tolist() if rows is groups else list(range(len(rows)))
        seen, want = set(), {}
        for i, keys in sorted(zip(ids, rows)):
            want[i] = seen.isdisjoint(keys or ())
            seen |= set(keys or ()) if want[i] else set()
        tasks.clear()
        docs = spark.createDataFrame(list(zip(ids, rows)), "doc_id long, keys array<long>")
        got = dedup.greedy_by_keys(docs).collect()
        assert len(got) == len(rows) and {x.doc_id: x.kept for x in got} == want
        assert tasks.count("won") == 1 if len(rows) < 10 else 2 <= tasks.count("won") <= 10


def test_a_pipeline_drops_near_copies_of_documents_far_before(spark, tmp_path, monkeypatch):
    """A copy of a document of another 50,000 was kept, embedded and stored."""
    from vecflow.operators import embedding
    from vecflow.plans import retrieval

    made, plain = [], retrieval.stores.VectorStore
    monkeypatch.setattr(retrieval.stores, "VectorStore", lambda *a: made.append(plain(*a)) or made[0])
    own = F.format_string("w%d v%d u%d", "id", "id", "id")
    text = F.when(F.col("id") == 50_003, " w7  v7 u7 ").when(F.col("id") == 50_005, " - ").otherwise(own)
    spark.range(50_010).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert tuple(retrieval.document_pipeline(spark, f"file://{tmp_path}").first()) == (50_010, 50_008, 1, 50_008)
    found = {x.idx: x.v for x in made[0].rows().filter("idx in (7, 50003, 50004, 50007)").collect()}
    want = embedding.HashEmbedder(64).encode([f"w{i} v{i} u{i}" for i in (7, 50_004, 50_006, 50_009)])
    assert np.array_equal([found[i] for i in (7, 50_003, 50_004, 50_007)], want)
