"""Exact and near duplicates, dense numbering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..workspace import dealt, parquet_batches, stored, workdir

PERMUTATIONS, BANDS, ROWS = 128, 9, 13
#: For streams (`streaming.ingest`), whose state it bounds.
RESET_EVERY = 50_000
#: Rows that one task replays at once, and the share of rows left by a step that is slow.
AT_ONCE, SLOW = 1 << 16, 0.875
SHINGLE = 3
#: One document of so many says how often shingles occur, and how many of them are known to each worker.
ORDER_SHARE, MOST_FREQUENT = 32, 1 << 20
#: An odd number of 64 bits, by which a run's numbers become one.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Values of lists that numpy works on at once.
BLOCK_WORDS = 1 << 20
#: Words that are permuted at once, so that they stay in a core's cache.
HASH_WORDS = 1 << 15


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order. The minimum is taken before the shuffle, so a key with
    many rows is no hot spot; only the winning row is carried."""
    best = rows.select(*keys, F.struct(order, *[c for c in rows.columns if c not in (*keys, order)]).alias("row_")).groupBy(*keys).agg(F.min_by("row_", F.col(f"row_.{order}")).alias("row_"))
    return best.select(*[F.col(c) if c in keys else F.col(f"row_.{c}").alias(c) for c in rows.columns])


def numbered(rows: DataFrame, order: str, name: str, within: str | None = None) -> DataFrame:
    """Dense numbers from 0 in ascending order, of all rows or within a key.

    Rows are dealt out by ranges of the order, sorted and written once with their place in the
    range, so ranges are the same for all that is read from them; a small table of counts per range
    gives each range its start. No task sees all rows. Ties are numbered in any order; nulls come
    first."""
    keys = [within] if within else []
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    dealt = stored(rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("place_", place), "numbered")
    dealt = dealt.withColumns({"range_": F.shiftright("place_", 33), "place_": F.col("place_").bitwiseAND((1 << 33) - 1)})
    counts = dealt.groupBy("range_", *keys).agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_", *[F.col(k).alias("key_") for k in keys], (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("start_"))
    met = dealt.withColumnRenamed("range_", "own_range_").join(starts, (F.col("own_range_") == F.col("range_")) & (F.col(within).eqNullSafe(F.col("key_")) if within else F.lit(True)))
    return met.select(*[c for c in rows.columns if c != name], (F.col("start_") + F.col("place_")).alias(name))


def _shingle_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, h: a number of 64 bits for each distinct shingle of a text, made of its words' numbers."""
    words = docs.select("doc_id", T.let(T.tokens(F.col("text")), lambda w: F.transform(w, lambda x: F.xxhash64(x))).alias("w"))

    def runs(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            for a, e in _runs(sizes, BLOCK_WORDS):
                n = sizes[a:e]
                x = lists.slice(a, e - a).flatten().to_numpy().astype(np.uint64)
                doc = np.repeat(np.arange(e - a), n)
                left = np.repeat(np.cumsum(n), n) - np.arange(len(x))  # words from here to the text's end
                full = x.copy()
                if len(x) >= SHINGLE:
                    for step in range(1, SHINGLE):
                        full = full * MULTIPLIER + np.roll(x, -step)
                own = np.flatnonzero((left >= SHINGLE) | (n[doc] < SHINGLE))
                h, doc = np.where(n[doc] < SHINGLE, x, full)[own], doc[own]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else own
                ends = np.r_[0, np.cumsum(np.bincount(doc[new], minlength=e - a))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(a, e - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[new].astype(np.int64)))], names=["doc_id", "h"])

    return words.mapInArrow(runs, "doc_id long, h array<long>")


def _frequent(docs: DataFrame) -> str:
    """The folder of a bounded table h, n: shingles that occur several times in a share of the documents. It
    only says in what order shingles are filed, so no result depends on it."""
    spark = docs.sparkSession
    some = _shingle_hashes(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SHARE)) == 0)).select(F.explode("h").alias("h"))
    counts = stored(some.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "frequencies")
    rows, least = 0, 2
    for n, c in sorted(((r["n"], r["c"]) for r in counts.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True):  # a row per frequency
        rows += c
        if rows > MOST_FREQUENT:
            least = n + 1
            break
    uri = workdir(spark, "frequent")
    counts.filter(F.col("n") >= least).write.parquet(uri)
    return uri


def _filed(docs: DataFrame, threshold: float) -> DataFrame:
    """t, doc_id, n, place: each text under its rarest shingles (t, of 40 bits), as many as a similar text
    must share one of, in the same order for all texts; n is how many shingles it has."""
    uri = _frequent(docs)

    def write(batches):
        known = [(t["h"].to_numpy(), t["n"].to_numpy()) for t in parquet_batches(uri, 1 << 20)]
        keys, often = (np.concatenate([np.zeros(1, np.int64), *c]) for c in zip(*known)) if known else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        order = np.argsort(keys, kind="stable")
        keys, often = keys[order], often[order]
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            for a, e in _runs(sizes, BLOCK_WORDS):
                n, flat = sizes[a:e], lists.slice(a, e - a).flatten().to_numpy()
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                count = np.where(keys[at] == flat, often[at], 0)
                doc = np.repeat(np.arange(e - a), n)
                order = np.lexsort((flat, count, doc))  # documents stay where they are
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                # similarity j needs at least ceil(j * n) shared terms, so one lies in the first n - ceil(j n) + 1
                own = np.flatnonzero(place < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n))
                doc = doc[own]
                yield pa.RecordBatch.from_arrays([pa.array(flat[order][own] & ((1 << 40) - 1)), pa.array(ids[a:e][doc]), pa.array(n[doc].astype(np.int32)), pa.array(place[own].astype(np.int32))], names=["t", "doc_id", "n", "place"])

    return _shingle_hashes(docs).mapInArrow(write, "t long, doc_id long, n int, place int")


def _runs(sizes: np.ndarray, most: int):
    """Ranges of rows that together have about so many values at most."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, e
        a = e


def _sketches(hashes: DataFrame) -> DataFrame:
    """doc_id, n, bits: how many shingles a text has, and which of 2 to 4 n places (a power of two) they take.
    A place that only one of two texts takes is a shingle that only one of them has."""

    def write(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes, out = pc.list_value_length(lists).to_pylist(), []
            for i, n in enumerate(sizes):
                width = 1 << max(3, (2 * n - 1).bit_length())
                places = np.zeros(width, np.uint8)
                places[lists[i].values.to_numpy() & (width - 1)] = 1
                out.append(np.packbits(places).tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "n", "bits"])

    return hashes.mapInArrow(write, "doc_id long, n int, bits binary")


def _may_be_similar(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs whose sketches differ in no more places than similar texts do in shingles."""

    def keep(batches):
        for batch in batches:
            own = []
            for i, (na, nb, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ba", "bb")))):
                x, y = (np.frombuffer(b, np.uint8) for b in (x, y))
                least = min(len(x), len(y))
                # the same low bits of a number are its place in a narrower sketch
                x, y = (np.bitwise_or.reduce(b.reshape(-1, least)) for b in (x, y))
                if np.bitwise_count(x ^ y).sum() * (1 + threshold) <= (1 - threshold) * (na + nb) + 1e-6:
                    own.append(i)
            yield batch.select(["a", "b"]).take(pa.array(own, pa.int64()))

    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(keep, "a long, b long")


def similar_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of distinct texts, by an inverted index of shingles with a prefix filter: each
    text is filed under its rarest shingles only, as many as a similar text must share one of. Pairs found
    so are first held against each other by sketches, so whole sets are moved for few pairs besides those
    that are similar, and texts not at all, unless very many are copies or found.

    Shingles are numbers of 64 bits: two that differ are taken as one with a chance of 2 ** -64."""
    keyed = docs.filter("text is not null").select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars"))
    groups = keyed.groupBy("digest", "chars").agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).filter("c > 1")
    copies = stored(keyed.join(groups, ["digest", "chars"]).filter("doc_id <> first").select("doc_id"), "copies")
    texts = docs.join(copies, "doc_id", "left_anti").select("doc_id", "text")
    filed = _filed(texts, threshold).repartition("t")
    side = lambda x: filed.select("t", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"))
    # at the first term that two texts share, what is left of both bounds what they can share
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    close = most * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-6
    pairs = stored(side("a").join(side("b"), "t").filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct(), "pairs")

    def among(found: DataFrame) -> DataFrame:
        """The shingles of the texts of pairs."""
        named = stored(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
        return _shingle_hashes(texts.join(named, "doc_id", "left_semi").select("doc_id", "text"))

    pairs = stored(_may_be_similar(pairs, stored(_sketches(among(pairs)).dropDuplicates(["doc_id"]), "sketches"), threshold), "pairs")
    sets = stored(among(pairs).dropDuplicates(["doc_id"]), "sets")
    whole = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    jaccard = shared / (F.size("sa") + F.size("sb") - shared)
    return whole.select("a", "b", jaccard.alias("j")).filter(F.col("j") >= threshold).select("a", "b", F.round("j", 6).alias("jaccard"))


#: Fixed values of XXH64, the hash function of Spark's xxhash64.
XXH = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
SEED = np.uint64(42)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * XXH[1]
    x = (x ^ (x >> np.uint64(29))) * XXH[2]
    return x ^ (x >> np.uint64(32))


def _hashed_int(i: int, seed: np.ndarray, out: np.ndarray | None = None, low: np.ndarray | None = None) -> np.ndarray:
    """xxhash64 of columns of which the last is the integer i and the others gave seed; in out, by way of low,
    where they are given."""
    x = np.add(seed, XXH[4] + np.uint64(4), out=out)
    x ^= np.uint64(i * int(XXH[0]) % 2**64)
    low = np.right_shift(x, np.uint64(41), out=low)
    x <<= np.uint64(23)
    x |= low
    x *= XXH[1]
    x += XXH[2]
    for shift, factor in ((33, XXH[1]), (29, XXH[2])):
        x ^= np.right_shift(x, np.uint64(shift), out=low)
        x *= factor
    x ^= np.right_shift(x, np.uint64(32), out=low)
    return x


def _hashed_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The same of a column of longs."""
    own = (seed + (XXH[4] + np.uint64(8))) ^ (_rotated(x * XXH[1], 31) * XXH[0])
    return _mixed(_rotated(own, 27) * XXH[0] + XXH[3])


def minima(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of xxhash64(word, i) for each i below BANDS * ROWS (a column), of the words of each row. flat
    has the rows' words behind each other, as xxhash64(word); every row has some."""
    least = np.empty((len(sizes), BANDS * ROWS), np.int64)
    ends = np.cumsum(sizes)
    for a, e in _runs(sizes, HASH_WORDS):
        begin = ends[a] - sizes[a]
        seeds = flat[begin : ends[e - 1]].view(np.uint64)
        starts, out, low = ends[a:e] - sizes[a:e] - begin, np.empty_like(seeds), np.empty_like(seeds)
        for i in range(BANDS * ROWS):
            least[a:e, i] = np.minimum.reduceat(_hashed_int(i, seeds, out, low).view(np.int64), starts)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    """xxhash64 of the ROWS minima of each band (a column)."""
    own = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    out = np.full((len(least), BANDS), SEED)
    for r in range(ROWS):
        out = _hashed_long(own[:, :, r], out)
    return out


def _grams(words: Column, k: int) -> Column:
    """T.shingles without nested lambdas, which Spark does not take in the argument of a Python function."""
    if k <= 1:
        return words
    out = words
    for step in range(1, k):
        out = F.zip_with(out, F.slice(words, step + 1, F.greatest(F.size(words) - step, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) < k, words).otherwise(F.filter(out, lambda x: x.isNotNull()))


def _per_text(words: Column, k: int, change) -> Column:
    """change(minima) of the k-grams of each text's words; null for a text without words. Words are parted and
    hashed once, in the JVM, and each different one of a text is taken once; the permutations are numpy's."""

    @F.arrow_udf("array<long>")
    def found(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = sizes > 0
        if not own.any():
            return pa.nulls(len(words), pa.list_(pa.int64()))
        rows = change(minima(words.flatten().to_numpy(zero_copy_only=False), sizes[own])).astype(np.int64)
        ends = np.r_[0, np.cumsum(np.where(own, rows.shape[1], 0))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows.ravel()), mask=pa.array(~own))

    return found(F.array_distinct(F.transform(_grams(words, k), lambda t: F.xxhash64(t))))


def signature(text: Column, k: int = 1) -> Column:
    """The MinHash signature of a text's word k-grams, row by row; null for a text without words."""
    return _per_text(T.tokens(text), k, lambda least: least)


def banded(docs: DataFrame, k: int = 1) -> DataFrame:
    """doc_id, band, bucket: MinHash signatures of word k-grams in bands."""
    own = docs.select("doc_id", _per_text(T.tokens(F.col("text")), k, _bands).alias("buckets"))
    # from an inner explode Spark infers a filter on the buckets, which would be made a second time for it
    return own.select("doc_id", F.posexplode_outer("buckets").alias("band", "bucket")).filter("band is not null")


def band_keys(text: Column, k: int = 1, tokens=T.tokens) -> Column:
    """The buckets of a text's bands as numbers, row by row (as `banded`, with the band hashed in); null for a
    text without words, which tokens gives."""
    numbers = np.concatenate([_hashed_int(b, np.full(1, SEED)) for b in range(BANDS)])
    return _per_text(tokens(text), k, lambda least: _hashed_long(_bands(least), numbers))


def minhash_duplicates(docs: DataFrame, k: int = 1) -> DataFrame:
    """doc_id, first_id: documents that share a band's bucket with an earlier one, with the least such."""
    own = stored(banded(dealt(docs.select("doc_id", "text"), "doc_id"), k), "bands")  # read twice
    first = own.groupBy("band", "bucket").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return own.join(first, ["band", "bucket"]).filter("first_id < doc_id").groupBy("doc_id").agg(F.min("first_id").alias("first_id"))


def greedy_first_wins(docs: DataFrame, k: int = 1, reset_every: int | None = None) -> DataFrame:
    """doc_id, kept: in order of id, a document is dropped if it shares a bucket with any earlier one that
    was kept. With reset_every, memory is emptied every so many documents."""
    keyed = dealt(docs.select("doc_id", "text"), "doc_id").select("doc_id", band_keys(F.col("text"), k).alias("keys"))
    return greedy_by_keys(stored(keyed, "keys"), reset_every)


def greedy_by_keys(keyed: DataFrame, reset_every: int | None = None) -> DataFrame:
    """The same of doc_id, keys (as `band_keys` gives them), which is read twice.

    A document with the keys of an earlier one is dropped: what the first is dropped for, drops it too.
    Only what shares a key with another is compared, all at once (`_first_wins`)."""
    rows = numbered(keyed.select("doc_id", "keys"), "doc_id", "n")
    if reset_every is not None:  # keys of two epochs are not the same
        rows = rows.withColumn("keys", F.transform("keys", lambda x: F.xxhash64(x, F.floor((F.col("n") + 1) / reset_every))))
    firsts = stored(rows.filter("keys is not null").groupBy("keys").agg(F.min("n").alias("n")), "firsts")
    spread = firsts.select("n", F.explode(F.array_distinct("keys")).alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    met = stored(spread.join(shared, "key", "left_semi").select("n", "key"), "met")
    lost = met.select("n").distinct().join(_first_wins(met), "n", "left_anti")
    won = firsts.select("n").join(lost, "n", "left_anti").withColumn("won", F.lit(True))
    return rows.select("doc_id", "n", F.col("keys").isNull().alias("blank")).join(won, "n", "left").select("doc_id", F.coalesce("won", "blank").alias("kept"))


def _first_wins(rows: DataFrame) -> DataFrame:
    """n: those documents of n, key (each pair once) that are kept in order of n.

    The first of all its keys is kept, whatever came before, and all others of its keys are dropped; what is
    left begins anew. Where long chains of documents make that slow, the earliest AT_ONCE rows are replayed by
    one task, and so is the rest when it is no more than that."""

    def replay(part: pa.Table) -> pa.Table:
        part = part.sort_by("n")
        n, keys = part["n"].to_numpy(), part["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        seen: set[int] = set()
        kept = []
        for a, e in zip(starts, np.r_[starts[1:], len(n)]):
            own = keys[a:e].tolist()
            if seen.isdisjoint(own):
                kept.append(n[a])
                seen.update(own)
        return pa.table({"n": pa.array(kept, pa.int64())})

    replayed = lambda part: part.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(replay, "n long")
    found, before, left = None, None, rows.count()
    while True:
        if left <= AT_ONCE:
            won = replayed(rows)
        elif before is not None and left > SLOW * before:
            end = rows.agg(F.percentile_approx("n", AT_ONCE / left, 100_000)).first()[0]
            won = replayed(rows.filter(F.col("n") <= end))
        else:
            first = rows.groupBy("key").agg(F.min("n").alias("n")).groupBy("n").agg(F.count("*").alias("first"))
            won = rows.groupBy("n").agg(F.count("*").alias("own")).join(first, "n").filter("own = first").select("n")
        won = stored(won, "won")
        found = won if found is None else found.unionByName(won)
        if left <= AT_ONCE:
            return found
        taken = rows.join(won, "n", "left_semi").select("key")
        gone = rows.join(taken, "key", "left_semi").select("n").distinct()  # the kept ones among them
        rows = stored(rows.join(gone, "n", "left_anti"), "met")
        before, left = left, rows.count()
