"""Every query of the catalogue against its SQL, or at least its shape."""

import pytest
from compare import difference, oracle
from vecflow.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert difference(catalogue.queries()[name](spark, SMALL), db, catalogue.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["knn_exact_l2", "knn_bulk_l2", "knn_filtered_label", "sq8_row_adc_topk", "sq8_u8_distance_topk", "int8_scaled_query_topk", "ivf_probe_topk", "pq_adc_topk", "two_tier_rerank"])
def test_queries_beyond_a_block_are_answered(spark, db, monkeypatch, name):
    from vecflow.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert difference(catalogue.queries()[name](spark, SMALL), db, catalogue.oracle_sql()[name]) is None


def test_vector_search_in_sql(spark):
    from vecflow.plans.sqlfunctions import register_vector_search

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, v array<double>")
    register_vector_search(spark, rows, "find_rows")
    ask = lambda call: [tuple(r) for r in spark.sql(f"SELECT * FROM find_rows({call}) ORDER BY rank").collect()]
    assert ask("array(1D, 0D), 'l2', 2") == [(1, 1, 0.0), (2, 3, 0.0)]
    assert ask("array(0D, 2D), 'ip', 1") == [(1, 2, -2.0)] and ask("array(0D, 2D), 'cosine', 1") == [(1, 2, 0.0)]
    assert ask("NULL, 'l2', 5") == [] and ask("array(1D, 0D), 'other', 5") == [] and ask("array(1D, 0D), 'l2', 0") == []


def test_beam_search_finds_most_neighbours(spark):
    exact = {(r.query_id, r.vec_id) for r in catalogue.queries()["knn_exact_l2"](spark, SMALL).collect()}
    found = {(r.query_id, r.vec_id) for r in catalogue.queries()["graph_beam_search"](spark, SMALL).collect()}
    assert len(exact & found) >= 0.8 * len(exact)


def test_greedy_keeps_the_first_of_equal_texts(spark):
    from vecflow.operators.dedup import greedy_first_wins

    a, b = "one two three four five", "quite another text with other words"
    docs = spark.createDataFrame([(1, a), (2, a), (3, b), (4, a), (5, ""), (6, None)], "doc_id long, text string")
    assert {r.doc_id for r in greedy_first_wins(docs).collect() if r.kept} == {1, 3, 5, 6}


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_kmeans_rows_are_nearest_to_their_own_mean(spark):
    import numpy as np

    rows = {r.vec_id: r.cid for r in catalogue.queries()["kmeans_fit"](spark, SMALL).collect()}
    x = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    assert set(rows) == set(x) and len(set(rows.values())) == 10
    means = {c: np.mean([x[i] for i, own in rows.items() if own == c], axis=0) for c in set(rows.values())}
    nearest = [min(means, key=lambda c: np.square(means[c] - x[i]).sum()) == own for i, own in rows.items()]
    assert np.mean(nearest) > 0.9


def test_pca_is_that_of_the_singular_values(spark):
    import numpy as np

    rows = sorted((r.vec_id, r.x, r.y, r.z) for r in catalogue.queries()["pca_project_3d"](spark, SMALL).collect())
    x = np.array([r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()], float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want, got = x @ axes[:3].T, np.array([r[1:] for r in rows])
    want *= 45 / np.abs(want).max()
    assert all(min(np.abs(got[:, i] - want[:, i]).max(), np.abs(got[:, i] + want[:, i]).max()) < 1e-2 for i in range(3))


def test_minhash_duplicates_are_alike(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    words = {i: set((t or "").split()) for i, t in texts.items()}
    found = {r.doc_id: r.first_id for r in catalogue.queries()["minhash_near_dups"](spark, SMALL).collect()}
    assert found and all(f < i for i, f in found.items())
    alike = [len(words[i] & words[f]) / max(len(words[i] | words[f]), 1) for i, f in found.items()]
    assert sum(a >= 0.5 for a in alike) >= 0.9 * len(alike)
    first = {}
    for i in sorted(texts):
        if words[i]:
            assert first.setdefault(frozenset(words[i]), i) == i or i in found
