"""Document fingerprints by consistent weighted sampling, as DataFrame expressions only.

A text's terms are its words in lower case, weighted by how often they occur. For each of SAMPLES
samples a term has two gamma variates and a uniform one, all functions of the term and the sample's
number; the weight is brought down to one of the term's own grid points, and the term with the
least resulting value is the sample, together with its grid point. Two texts have the same sample
with a probability equal to their generalised Jaccard similarity (sum of minima over sum of maxima
of the weights), so the share of equal samples estimates it.

A null text is an empty one; an empty text has one empty term. Rows with a null id come first; rows
that repeat an id follow each other in a fixed order. Rows that repeat id and text are one document
(told by 128 bits of a hash of both), whose next one is another document; each of them gets the
document's result. A single document is its own next one. An empty table gives an empty result.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import partitions_for, stored

SAMPLES = 64
#: Terms whose value is above so many times the mean of a text's least one are passed over: the least one is
#: above it with chance exp(-REACH), 4e-18.
REACH = 40.0
#: A sample in the fingerprint: so many bits of a hash of term and grid point.
SAMPLE_BITS = 24
TEXT_BYTES = 8 << 20
_UNIT = float(2**31)


def terms(text: Column) -> Column:
    """A hash of each word, in order."""
    return F.transform(F.split(F.trim(F.lower(text)), "[ \\n\\t\\r]+"), lambda w: F.xxhash64(w))


def _uniforms(h: Column) -> tuple[Column, Column]:
    """Two numbers above 0 and below 1 from a hash."""
    low = (h.bitwiseAND(0x7FFFFFFF) + 1).cast("double") / (_UNIT + 1)
    high = (F.shiftrightunsigned(h, 33) + 1).cast("double") / (_UNIT + 1)
    return low, high


def draws(term: Column, k: Column) -> list[Column]:
    """What the k-th sample has of a term: ab and cd, of two uniform numbers each, whose -log are gamma
    variates of shape 2; a uniform number u; a hash h."""
    (a, b), (c, d) = (_uniforms(F.xxhash64(term, 3 * k + i)) for i in (0, 1))
    h = F.xxhash64(term, 3 * k + 2)
    return [(a * b).alias("ab"), (c * d).alias("cd"), (h.bitwiseAND(0x7FFFFFFF).cast("double") / _UNIT).alias("u"), F.shiftrightunsigned(h, 31).alias("h")]


#: At most a term's value times its weight: -log(x) is 2 (1 - x) / (1 + x) or more. The other factor is at
#: least ab; at weight one it is ab ** (1 - u), a geometric mean of 1 and ab, above their harmonic one.
LEAST = "2 * (1 - cd) / (1 + cd) * if(single, ab / (u * ab + 1 - u), ab)"


def sample(log_weight: Column) -> Column:
    """The sample's value in the high bits, its identity in the low ones, from the columns of draws and their
    logarithms r and g; the least one counts. A null weight gives none."""
    r, g, uniform, h = (F.col(x) for x in "rguh")
    point = F.floor(log_weight / r + uniform)
    value = g - r * (point - uniform + 1)
    identity = (h + point * 0x9E3779).bitwiseAND((1 << SAMPLE_BITS) - 1)
    return F.shiftleft(((F.greatest(F.least(value, F.lit(60.0)), F.lit(-60.0)) + 64) * _UNIT).cast("long"), SAMPLE_BITS).bitwiseOR(identity)


def successors(docs: DataFrame) -> DataFrame:
    """The columns of rows (doc_id, key, ..) and next_key, in ascending doc_id and key; the last one's
    next is the first. Only ids and sizes are sorted; partitions meet at their ends."""
    placed = stored(docs.repartitionByRange("doc_id", "key").withColumn("part", F.spark_partition_id()), "order")
    within = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "key")
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "key"))["key"].alias("key"))
    ends = Window.partitionBy(F.lit(0)).orderBy("part")
    all_ = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("part", F.coalesce(F.lead("key").over(ends), F.first("key").over(all_)).alias("first_of_next"))
    return placed.withColumn("inner_next", F.lead("key").over(within)).join(F.broadcast(following), "part").select(*docs.columns, F.coalesce("inner_next", "first_of_next").alias("next_key"))  # a row per partition


def signatures(edits: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """key, fingerprint and edited_fingerprint of rows (key, text, edited) that are partitioned by
    key; no row leaves its partition. A term's variates serve both texts.

    A term of weight w in a text of total weight W has a value that is exponentially distributed with rate
    w, the text's least value has rate W. A term whose value is above REACH / W is the sample only if all
    are, which has the chance exp(-REACH): where a bound without logarithms (LEAST) says so, the term is
    passed over. A text of few words has no such terms."""
    mark = lambda words, side: F.transform(words, lambda h: F.shiftleft(F.shiftright(h, 1), 1) + side)
    lists = edits.select("key", mark(terms(F.col("text")), 0).alias("t0"), mark(terms(F.col("edited")), 1).alias("t1"))
    sized = lists.select("key", F.size("t0").alias("w0"), F.size("t1").alias("w1"), F.concat("t0", "t1").alias("both"))
    # no list is empty; explode would split each text a second time to check that
    words = sized.select("key", "w0", "w1", F.explode_outer("both").alias("term"))
    edited = F.col("term").bitwiseAND(1)
    weights = words.groupBy("key", "w0", "w1", F.shiftright("term", 1).alias("term")).agg(F.sum(1 - edited).alias("n0"), F.sum(edited).alias("n1"))
    # a term that a text does not have has no weight there
    logs = [F.log(F.nullif(F.col(n), F.lit(0)).cast("double")).alias(f"log{i}") for i, n in enumerate(("n0", "n1"))]
    reach = (REACH * F.greatest(F.col("n0") / F.col("w0"), F.col("n1") / F.col("w1"))).alias("reach")
    single = (F.greatest("n0", "n1") == 1).alias("single")
    rows = weights.select("key", "term", *logs, reach, single, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    near = rows.select("*", *draws(F.col("term"), F.col("k"))).filter(f"{LEAST} <= reach")
    drawn = near.select("key", "k", "log0", "log1", (-F.log("ab")).alias("r"), F.log(-F.log("cd")).alias("g"), "u", "h")
    parts = drawn.groupBy("key", "k").agg(*[F.min(sample(F.col(f"log{i}"))).alias(f"s{i}") for i in (0, 1)])
    # hexadecimal, of fixed length; the samples of a document are collected, at most so many as there are
    hexed = lambda s: F.lpad(F.lower(F.hex(F.coalesce(s, F.lit(0)).bitwiseAND((1 << SAMPLE_BITS) - 1))), SAMPLE_BITS // 4, "0")
    found = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("s0", "s1")))).alias("found"))
    text = lambda s: F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: hexed(F.element_at("found", k)[s])))
    return found.select("key", text("s0").alias("fingerprint"), text("s1").alias("edited_fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that two fingerprints have in common."""
    n = SAMPLE_BITS // 4
    at = lambda f, k: F.substring(f, n * k + 1, n)
    return sum((at(a, k) == at(b, k)).cast("int") for k in range(samples)) / F.lit(float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each
    document, the document with its last quarter replaced by the next one's beginning, and the next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(" "), "text"))))
    known = rows.groupBy("doc_id", "key").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    order = stored(successors(known), "successors")
    # only key and text move, once: whatever uses them has the same columns and so the same exchange
    own = rows.select("key", "text").repartition(partitions_for(docs, TEXT_BYTES), "key").dropDuplicates(["key"])
    # what each document gives to the one before it: only that much of it is moved
    asked = order.select(F.col("next_key").alias("key"), F.col("key").alias("before"), F.floor(F.col("n_chars") / 4).cast("int").alias("n"))
    heads = own.join(asked, "key").select(F.col("before").alias("key"), F.expr("substring(text, 1, n)").alias("head"))
    edits = own.join(heads, "key").select("key", "text", F.expr("concat(substring(text, 1, cast(length(text) - floor(length(text) / 4) as int)), head)").alias("edited"))
    prints = signatures(edits, samples)
    found = stored(edits.select("key", F.sha2("edited", 256).alias("edited_sha256")).join(prints, "key"), "fingerprints")
    following = order.join(found.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("next")), "next_key").select("key", "doc_id", "n_chars", "copies", "next")
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return found.join(following, "key").withColumn("copy", each).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next"), samples).alias("near_next"),
    )
