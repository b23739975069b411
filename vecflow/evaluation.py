"""Indexes measured against exact answers: recall, time, bytes."""

from __future__ import annotations

import time
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import search as S
from .operators.indexes import FlatIndex, GraphIndex, Index, IvfPqIndex, TwoTierIndex

WARM_UP, REPEATS = 5, 3


def percentile(values: list[float], share: float) -> float:
    """Linear between the two nearest ranks."""
    ordered = sorted(values)
    place = share * (len(ordered) - 1)
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


def evaluate(index: Index, vectors: DataFrame, queries: DataFrame, truth: DataFrame, k: int, repeats: int = REPEATS) -> dict:
    """Seconds to fit, then recall (percent) and seconds per run over all queries, after a run of a few
    to warm up. truth has rows (query_id, rank, vec_id)."""
    began = time.perf_counter()
    index.fit(vectors)
    built = time.perf_counter() - began
    index.search(queries.limit(WARM_UP), k).count()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        index.search(queries, k).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    n = queries.count()
    recall = S.recall(truth, index.search(queries, k), k).first()["recall"]
    return {
        "index": index.name,
        "recall_percent": round(100 * recall, 2),
        "build_s": round(built, 3),
        "p50_s": round(percentile(took, 0.5), 3),
        "p95_s": round(percentile(took, 0.95), 3),
        "qps": round(n / max(sum(took) / len(took), 1e-9), 2),
        "bytes": index.memory_bytes(),
    }


def graded_quality(found: DataFrame, there: DataFrame, k: int) -> DataFrame:
    """For each query of there: reciprocal_rank of the first row of a grade above 0, precision and recall of
    such rows among k, and ndcg, the discounted gain (2 ** grade - 1 over log2(rank + 1)) as a share of the
    best possible. found: query_id, rank, grade of up to k rows each; there: query_id and there, how many
    rows of each grade there are, the highest grade first, so no query meets all rows."""
    hit = F.col("grade") > 0
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    sums = found.filter(F.col("rank") <= k).groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit).alias("hits"), F.sum(gain).alias("gain"))
    top = F.size("there")
    upto = F.transform("there", lambda n, g: F.struct((top - g).alias("grade"), F.aggregate(F.slice("there", F.lit(1), g + 1), F.lit(0).cast("long"), lambda s, x: s + x).alias("last")))
    grade_at = lambda i: F.coalesce(F.get(F.filter(upto, lambda u: i <= u["last"]), F.lit(0))["grade"], F.lit(0))
    with_best = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + (F.pow(F.lit(2.0), grade_at(i)) - 1) / F.log2(i + 1))
    total = F.aggregate("there", F.lit(0).cast("long"), lambda s, x: s + x)
    own = there.select("query_id", total.alias("total"), with_best.alias("best")).join(sums, "query_id", "left")
    share = lambda x, of: F.round(F.when(of > 0, F.coalesce(x, F.lit(0)) / of).otherwise(F.lit(0.0)), 6)
    return own.select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), share(F.col("hits"), F.lit(k)).alias("precision"), share(F.col("hits"), F.col("total")).alias("recall"), share(F.col("gain"), F.col("best")).alias("ndcg"))


def comparison(vectors: DataFrame, queries: DataFrame, k: int = 10, indexes: list[Index] | None = None, repeats: int = REPEATS) -> list[dict]:
    """A report on each index, the fastest first."""
    truth = FlatIndex().fit(vectors).search(queries, k)
    some = indexes or [FlatIndex(), IvfPqIndex(), GraphIndex(), TwoTierIndex()]
    return sorted((evaluate(i, vectors, queries, truth, k, repeats) for i in some), key=lambda r: -r["qps"])


def grid(vectors: DataFrame, queries: DataFrame, k: int = 10, taus=(2, 3, 4), epsilons=(1e-5, 1e-4, 1e-3), factors=(1, 2, 3), repeats: int = 1) -> list[dict]:
    """Every combination of an early end and a pool, measured, the fastest first; without an early end
    comes a baseline."""
    truth = FlatIndex().fit(vectors).search(queries, k)
    rows = []
    for tau, epsilon, factor in [(None, 0.0, 3), *product(taus, epsilons, factors)]:
        got = evaluate(TwoTierIndex(factor=factor, tau=tau, epsilon=epsilon), vectors, queries, truth, k, repeats)
        rows.append({"tau": tau, "epsilon": epsilon, "factor": factor, **got})
    return sorted(rows, key=lambda r: -r["qps"])


def report(rows: list[dict], spark) -> DataFrame:
    """Reports as a table, the fastest first."""
    columns = "index string, recall_percent double, build_s double, p50_s double, p95_s double, qps double, bytes long"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in columns.split(", ")) for r in rows], columns).orderBy(F.desc("qps"))
