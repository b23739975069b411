"""Text queries: cleaning, chunks, ids, exact and near duplicates, quality, federation, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from .tables import table

SPLIT = r"[\s\x1c-\x1f]+"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+'), lambda x: x <> '')"
COLLAPSE = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'))"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _mapped(build, name: str = "result"):
    def run(spark, d):
        return _docs(spark, d).select("doc_id", build(F.col("text")).alias(name))

    return run


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def chunks(spark, d):
    words = _docs(spark, d).select("doc_id", "text", T.tokens(F.col("text")).alias("w"))
    starts = words.withColumn("start", F.explode(T.chunk_starts(F.size("w"), 300, 50)))
    return starts.select("doc_id", (F.col("start") / 250).cast("int").alias("chunk_index"), F.least(F.lit(300), F.size("w") - F.col("start")).alias("token_count"), F.when(F.size("w") <= 300, F.col("text")).otherwise(F.array_join(F.slice("w", F.col("start") + 1, 300), " ")).alias("chunk")).withColumn("chunk", F.md5("chunk"))


def shingle_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.array_distinct(T.shingles(T.tokens(F.col("text")), 3))).cast("long").alias("n"))


def titles(spark, d):
    first, second = T.line(F.col("text"), 1), T.line(F.col("text"), 2)
    return _docs(spark, d).select("doc_id", F.substring(first, 1, 120).alias("title"), F.substring(F.coalesce(second, first), 1, 300).alias("summary"))


def ids(spark, d):
    t = F.substring("text", 1, 200)
    return _docs(spark, d).select("doc_id", F.concat(F.lit("hf_"), T.short_hash(t)).alias("sha256_id"), T.short_hash(t, "sha1").alias("sha1_id"), T.short_hash(t, "md5").alias("md5_id"))


def streamed(spark, d):
    clean = _docs(spark, d).filter(F.length("text") >= 50).withColumn("clean", T.collapsed(F.col("text"))).withColumn("token_count", T.token_count(F.col("clean"))).filter("token_count >= 20")
    return clean.select("doc_id", F.concat(F.lit("hf_"), T.short_hash(F.substring("clean", 1, 200))).alias("record_id"), F.col("token_count").cast("long").alias("token_count"))


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id and 128 bits and the length of each text, which stand for it where it would be a key."""
    return docs.select("doc_id", F.md5("text").alias("h"), F.length("text").alias("chars"))


def exact_first(spark, d):
    return D.first_of(_hashed(_docs(spark, d)), ["h", "chars"], "doc_id").select("doc_id")


def prefix_first(spark, d):
    return D.first_of(_docs(spark, d).withColumn("h", F.sha2(F.substring("text", 1, 250), 256)), ["h"], "doc_id").select("doc_id", "h")


def dedup_stats(spark, d):
    n = F.count("*")
    return _hashed(_docs(spark, d)).groupBy("h", "chars").agg(n.alias("c")).agg(F.sum("c").alias("seen"), F.sum(F.col("c") - 1).alias("duplicates"), F.count("*").alias("kept"))


def jaccard_pairs(spark, d):
    """Distinct texts that share a rare shingle and three quarters of all."""
    return D.similar_pairs(_docs(spark, d), 0.75)


def minhash(spark, d):
    return D.minhash_duplicates(_docs(spark, d))


def greedy(spark, d):
    return D.greedy_first_wins(_docs(spark, d))


def classified(spark, d):
    return _docs(spark, d).select("doc_id", T.category(F.col("text")).alias("category"))


def quality(spark, d):
    n = T.token_count(F.col("text"))
    return _docs(spark, d).filter((F.length("text") >= 60) & (n >= 25)).select("doc_id", n.cast("long").alias("token_count"))


def buckets(spark, d):
    n = T.token_count(F.col("text"))
    b = F.when(n > 300, "Long").when(n > 150, "Medium").otherwise("Short")
    return _docs(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def prefix_scan(spark, d):
    return _docs(spark, d).filter(F.col("text").startswith("The")).orderBy("doc_id").select("doc_id", F.regexp_replace(F.substring("text", 1, 180), "\n", " ").alias("preview"), "source")


def stride_sample(spark, d):
    return D.numbered(_docs(spark, d).select("doc_id"), "doc_id", "pos").filter("pos % 5 = 0").select("doc_id", "pos")


def even_sample(spark, d):
    n, take = F.col("n"), 50
    size = _docs(spark, d).agg(F.count("*").alias("n"))
    want = size.select(F.explode(F.sequence(F.lit(0), F.lit(take - 1))).alias("i"), "n").select(F.floor(F.col("i") * (n - 1) / (take - 1)).alias("pos")).distinct()
    return D.numbered(_docs(spark, d).select("doc_id"), "doc_id", "pos").join(F.broadcast(want), "pos", "left_semi").select("doc_id", "pos")


def hash_sample(spark, d):
    return _docs(spark, d).select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100)


def labelled(spark, d):
    j = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


def members(spark, d):
    """A virtual union of corpora, one per language, with global positions."""
    own = D.numbered(_docs(spark, d).select("lang", "doc_id"), "doc_id", "local", "lang")
    counts = own.groupBy("lang").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own, offsets


def offsets(spark, d):
    return members(spark, d)[1].select("lang", F.col("first"), (F.col("first") + F.col("n")).alias("last"), "n")


def union(spark, d):
    own, off = members(spark, d)
    return own.join(F.broadcast(off), "lang").select((F.col("first") + F.col("local")).alias("global_idx"), F.col("lang").alias("corpus_source"), "doc_id")


def located(spark, d):
    """Every seventh global position, and the corpus whose half-open interval holds it."""
    off = members(spark, d)[1]
    total = off.agg(F.sum("n").cast("long").alias("total"))
    asked = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(7).cast("long"))).alias("g"))
    return asked.join(F.broadcast(off), (F.col("g") >= F.col("first")) & (F.col("g") < F.col("first") + F.col("n"))).select("g", "lang", (F.col("g") - F.col("first")).alias("local"))


def gather(spark, d):
    """Requested positions in their order; a repeated request is answered again."""
    asked = spark.sql("SELECT pos, g FROM VALUES (0, 15L), (1, 0L), (2, 15L), (3, 40L) AS t(pos, g)")
    return asked.join(union(spark, d), F.col("g") == F.col("global_idx")).select("pos", "g", "corpus_source", "doc_id")


def shards(spark, d):
    own = D.numbered(_docs(spark, d).select("doc_id", "n_chars"), "doc_id", "rn").withColumn("shard_id", F.floor(F.col("rn") / 300))
    return own.groupBy("shard_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"))


def sequential(spark, d):
    return D.numbered(_docs(spark, d).select("doc_id"), "doc_id", "vector_idx").select("doc_id", "vector_idx")


def manifest(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("records"), F.sum(F.octet_length("text")).alias("bytes")).withColumn("mb", F.round(F.col("bytes") / 1048576, 2))


def generated(spark, d):
    n = 1000
    texts = F.array(*[F.lit(x) for x in ("alpha beta", "gamma delta", "epsilon zeta")])
    return spark.range(n).select(F.col("id"), F.element_at(texts, (F.col("id") % 3 + 1).cast("int")).alias("template"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("key"))


def pages_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.collapsed(T.without_tags(F.col("html")))).alias("text_md5"))


def articles(spark, d):
    from ..sources.html import articles as parse

    return parse(table(spark, d, "pages"))


def page_ids(spark, d):
    own = table(spark, d, "pages")
    return D.first_of(own, ["url"], "page_id").select("page_id", F.concat(F.lit("news_"), T.short_hash(F.col("url"))).alias("news_id"))


def stripped(spark, d):
    """Text of pages as a parser reads it."""
    return table(spark, d, "pages").select("page_id", F.md5(T.collapsed(T.normal(F.coalesce("html", F.lit(""))))).alias("text_md5"))


def numbered_stream(spark, d):
    """Ids that count all rows; rows without text are left out afterwards."""
    own = D.numbered(_docs(spark, d).select("doc_id", "text"), "doc_id", "idx").filter("text is not null and text <> ''")
    return own.select("doc_id", F.format_string("hf_train_%08d", "idx").alias("record_id"))


def sources_stream(spark, d):
    """Two sources behind each other, cleaned and filtered alike."""
    both = _docs(spark, d).select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text").unionByName(table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), "text"))
    clean = both.filter(F.length("text") >= 50).withColumn("clean", T.collapsed(F.col("text"))).filter(T.token_count(F.col("clean")) >= 20)
    return clean.select("source", "id", F.concat(F.lit("hf_"), T.short_hash(F.substring("clean", 1, 200))).alias("record_id"))


def legal_stream(spark, d):
    """The first of the texts that begin alike once they are cleaned."""
    own = _docs(spark, d).filter(F.length("text") >= 60).withColumn("clean", T.cleaned_lines(F.col("text"))).filter(T.token_count(F.col("clean")) >= 25)
    keyed = own.select("doc_id", F.sha2(F.substring("clean", 1, 250), 256).alias("h"))
    return D.first_of(keyed, ["h"], "doc_id").select("doc_id", "h")


def chained(spark, d):
    """Up to thirty benchmark texts first, then documents, a hundred records in all."""
    first = table(spark, d, "benchmark").orderBy("item_id").limit(30).select(F.lit(0).alias("turn"), F.col("item_id").alias("id"))
    rest = _docs(spark, d).orderBy("doc_id").limit(100).select(F.lit(1).alias("turn"), F.col("doc_id").alias("id"))
    return first.unionByName(rest).orderBy("turn", "id").limit(100)


def prefix_by_source(spark, d):
    """The first twenty texts of each source that begin with a word, with their places in the corpus."""
    own = D.numbered(_docs(spark, d).select("doc_id", "source", "text"), "doc_id", "line").filter(F.col("text").startswith("The"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("line"))
    return own.withColumn("place", place).filter("place <= 20").select("source", (F.col("line") + 1000).alias("global_idx"))


def corpus_stride(spark, d):
    """Every fifth document of each corpus, counted from its first."""
    return D.numbered(_docs(spark, d).select("doc_id", "lang"), "doc_id", "pos", "lang").filter("pos % 5 = 0").select("lang", "doc_id")


def gather_metadata(spark, d):
    """Metadata of requested positions, once for each position."""
    asked = spark.sql("SELECT g FROM VALUES (15L), (0L), (15L), (40L) AS t(g)").distinct()
    met = asked.join(union(spark, d), F.col("g") == F.col("global_idx")).join(_docs(spark, d).select("doc_id", "source", "n_chars"), "doc_id")
    return met.select("g", "corpus_source", "doc_id", "source", "n_chars")


def file_ids(spark, d):
    given = spark.sql("SELECT id, address FROM VALUES (1, 'https://drive.example/file/d/a_B-9/view'), (2, 'https://drive.example/uc?export=x/id=Zz1&y'), (3, 'plain_id'), (4, 'https://drive.example/none') AS t(id, address)")
    return given.select("id", T.file_id(F.col("address")).alias("file_id"))


def escaped(spark, d):
    given = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("it's a \\ \"quote\": "), F.col("text")).alias("text"))
    return given.select("item_id", T.sql_escaped(F.col("text")).alias("escaped"))


def preview_or_text(spark, d):
    """An empty preview counts as missing."""
    own = _docs(spark, d).withColumn("preview", F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.substring("text", 1, 20)))
    return own.select("doc_id", F.md5(T.first_filled(F.col("preview"), F.col("text"))).alias("shown"))


def case_search(spark, d):
    p = table(spark, d, "part")
    needle = "steel"
    return p.filter(F.lower("p_name").contains(needle) | F.lower("p_type").contains(needle)).select("p_partkey")


CATEGORY_CASES = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{name}'" for name, words in T.CATEGORIES.items())
NUMBERED = "(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)"
OFFSETS = "o AS (SELECT lang, n, coalesce(sum(n) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))"
UNION = f"{OFFSETS}, u AS (SELECT first + local AS global_idx, lang AS corpus_source, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS local FROM documents) JOIN o USING (lang))"
SPACED = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}]+'"
TOKENS = f"list_filter(regexp_split_to_array(text, {SPACED}), lambda x: x <> '')"
COLLAPSED = f"trim(regexp_replace(text, {SPACED}, ' ', 'g'))"

QUERIES = {
    "strip_urls": (_mapped(lambda c: digest(T.without_urls(c))), r"SELECT doc_id, sha256(regexp_replace(text, '(?i)https?://\S+|www\.\S+', ' ', 'g')) AS result FROM documents"),
    "strip_special": (_mapped(lambda c: digest(T.without_special(c))), r"SELECT doc_id, sha256(regexp_replace(text, '[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}.,!?]', ' ', 'g')) AS result FROM documents"),
    "collapse_whitespace": (_mapped(lambda c: digest(T.collapsed(c))), f"SELECT doc_id, sha256({COLLAPSED}) AS result FROM documents"),
    "clean_text_full": (
        _mapped(lambda c: digest(T.cleaned(c))),
        rf"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g')), '(?i)https?://\S+|www\.\S+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}.,!?]', ' ', 'g'), {SPACED}, ' ', 'g'))) AS result FROM documents",
    ),
    "clean_text_lines": (
        _mapped(lambda c: digest(T.cleaned_lines(c))),
        r"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS result FROM documents",
    ),
    "token_counts": (_mapped(lambda c: T.token_count(c).cast("long")), f"SELECT doc_id, len({TOKENS})::BIGINT AS result FROM documents"),
    "wikitext_clean": (_mapped(lambda c: digest(T.wikitext(F.concat(F.lit("{{box}}[[a|b]] <ref>x</ref>"), c)))), rf"SELECT doc_id, sha256(trim(regexp_replace('b ' || text, {SPACED}, ' ', 'g'))) AS result FROM documents"),
    "previews": (_mapped(lambda c: T.preview(c, 160)), "SELECT doc_id, CASE WHEN length(text) > 160 THEN left(text, 160) || '...' ELSE text END AS result FROM documents"),
    "chunk_documents": (
        chunks,
        f"WITH w AS (SELECT doc_id, text, {TOKENS} AS w FROM documents), s AS (SELECT *, unnest(CASE WHEN len(w) <= 300 THEN [0] ELSE list_filter(range(0, len(w), 250), lambda s: s = 0 OR len(w) - s >= 75) END) AS start FROM w) SELECT doc_id, (start // 250)::INT AS chunk_index, least(300, len(w) - start)::INT AS token_count, md5(CASE WHEN len(w) <= 300 THEN text ELSE array_to_string(w[start + 1 : start + 300], ' ') END) AS chunk FROM s",
    ),
    "shingle_counts": (shingle_counts, f"WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents) SELECT doc_id, len(list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END))::BIGINT AS n FROM w"),
    "first_line_title": (titles, "SELECT doc_id, left(string_split(text, chr(10))[1], 120) AS title, left(coalesce(string_split(text, chr(10))[2], string_split(text, chr(10))[1]), 300) AS summary FROM documents"),
    "content_hash_ids": (ids, "SELECT doc_id, 'hf_' || left(sha256(left(text, 200)), 16) AS sha256_id, left(sha1(left(text, 200)), 16) AS sha1_id, left(md5(left(text, 200)), 8) AS md5_id FROM documents"),
    "record_stream": (streamed, f"SELECT doc_id, 'hf_' || left(sha256(left(c, 200)), 16) AS record_id, len(list_filter(regexp_split_to_array(c, {SPACED}), lambda x: x <> ''))::BIGINT AS token_count FROM (SELECT doc_id, {COLLAPSED} AS c FROM documents WHERE length(text) >= 50) WHERE len(list_filter(regexp_split_to_array(c, {SPACED}), lambda x: x <> '')) >= 20"),
    "exact_dedup_first_wins": (exact_first, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"),
    "dedup_prefix_hash": (prefix_first, "SELECT min(doc_id) AS doc_id, sha256(left(text, 250)) AS h FROM documents GROUP BY 2"),
    "dedup_stats": (dedup_stats, "SELECT count(*) AS seen, (count(*) - count(DISTINCT text))::BIGINT AS duplicates, count(DISTINCT text) AS kept FROM documents"),
    "jaccard_near_dup_pairs": (
        jaccard_pairs,
        f"WITH t AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), w AS (SELECT doc_id, {TOKENS} AS w FROM t), s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL) SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.75",
    ),
    "minhash_near_dups": (minhash, None),
    "dedup_greedy_stream": (greedy, None),
    "classify_category": (classified, f"SELECT doc_id, CASE {CATEGORY_CASES} ELSE '{T.OTHER_CATEGORY}' END AS category FROM documents"),
    "quality_filter": (quality, f"SELECT doc_id, len({TOKENS})::BIGINT AS token_count FROM documents WHERE length(text) >= 60 AND len({TOKENS}) >= 25"),
    "length_bucket": (buckets, f"SELECT CASE WHEN len({TOKENS}) > 300 THEN 'Long' WHEN len({TOKENS}) > 150 THEN 'Medium' ELSE 'Short' END AS bucket, count(*) AS n FROM documents GROUP BY 1"),
    "prefix_scan": (prefix_scan, "SELECT doc_id, replace(left(text, 180), chr(10), ' ') AS preview, source FROM documents WHERE starts_with(text, 'The')"),
    "stride_sample": (stride_sample, f"SELECT doc_id, rn AS pos FROM {NUMBERED} WHERE rn % 5 = 0"),
    "linspace_sample": (even_sample, f"SELECT doc_id, rn AS pos FROM {NUMBERED} WHERE rn IN (SELECT floor(i * (n - 1) / 49)::BIGINT FROM range(50) t(i), (SELECT count(*) AS n FROM documents))"),
    "hash_sample": (hash_sample, "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100"),
    "label_quality_join": (labelled, "SELECT lang, quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL"),
    "corpus_offsets": (offsets, f"WITH {OFFSETS} SELECT lang, first, first + n AS last, n FROM o"),
    "federated_union": (union, f"WITH {UNION} SELECT global_idx, corpus_source, doc_id FROM u"),
    "global_index_locate": (located, f"WITH {OFFSETS} SELECT g, lang, g - first AS local FROM range(0, (SELECT count(*) FROM documents), 7) t(g) JOIN o ON g >= first AND g < first + n"),
    "batch_gather": (gather, f"WITH {UNION} SELECT pos, g, corpus_source, doc_id FROM (VALUES (0, 15), (1, 0), (2, 15), (3, 40)) t(pos, g) JOIN u ON g = global_idx"),
    "shard_writer_layout": (shards, f"SELECT (rn // 300)::BIGINT AS shard_id, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id FROM {NUMBERED} GROUP BY 1"),
    "sequential_ids": (sequential, f"SELECT doc_id, rn AS vector_idx FROM {NUMBERED}"),
    "manifest": (manifest, "SELECT source, count(*) AS records, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / 1048576, 2) AS mb FROM documents GROUP BY source"),
    "generated_corpus": (generated, "SELECT id, ['alpha beta', 'gamma delta', 'epsilon zeta'][id % 3 + 1] AS template, left(sha256(id::VARCHAR), 16) AS key FROM range(1000) t(id)"),
    "html_strip_regex": (pages_stripped, f"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), {SPACED}, ' ', 'g'))) AS text_md5 FROM pages"),
    "html_article_parse": (articles, None),
    "page_url_ids": (page_ids, "SELECT min(page_id) AS page_id, 'news_' || left(sha256(url), 16) AS news_id FROM pages GROUP BY url"),
    "nfc": (_mapped(lambda c: digest(T.nfc(F.concat(c, F.lit("e\u0301 \u1100\u1161 \u212b"))))), "SELECT doc_id, sha256(nfc_normalize(text || 'e\u0301 \u1100\u1161 \u212b')) AS result FROM documents"),
    "html_strip": (stripped, None),
    "text_stream_ids": (numbered_stream, f"SELECT doc_id, 'hf_train_' || lpad(rn::VARCHAR, 8, '0') AS record_id FROM {NUMBERED} WHERE text <> ''"),
    "multi_source_stream": (sources_stream, f"SELECT source, id, 'hf_' || left(sha256(left(c, 200)), 16) AS record_id FROM (SELECT source, id, {COLLAPSED} AS c FROM (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark) WHERE length(text) >= 50) WHERE len(list_filter(regexp_split_to_array(c, {SPACED}), lambda x: x <> '')) >= 20"),
    "legal_stream": (
        legal_stream,
        rf"SELECT min(doc_id) AS doc_id, h FROM (SELECT doc_id, c, sha256(left(c, 250)) AS h FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS c FROM documents WHERE length(text) >= 60)) WHERE len(list_filter(regexp_split_to_array(c, {SPACED}), lambda x: x <> '')) >= 25 GROUP BY h",
    ),
    "chained_source": (chained, "SELECT turn, id FROM (SELECT * FROM (SELECT 0 AS turn, item_id AS id FROM benchmark ORDER BY id LIMIT 30) UNION ALL SELECT * FROM (SELECT 1, doc_id FROM documents ORDER BY doc_id LIMIT 100)) ORDER BY turn, id LIMIT 100"),
    "prefix_scan_by_source": (prefix_by_source, f"SELECT source, rn + 1000 AS global_idx FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn) AS r FROM {NUMBERED} WHERE starts_with(text, 'The')) WHERE r <= 20"),
    "stride_sample_by_corpus": (corpus_stride, "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 5 = 0"),
    "batch_gather_metadata": (gather_metadata, f"WITH {UNION} SELECT g, corpus_source, doc_id, source, n_chars FROM (VALUES (15), (0), (40)) t(g) JOIN u ON g = global_idx JOIN documents USING (doc_id)"),
    "file_ids": (file_ids, "SELECT * FROM (VALUES (1, 'a_B-9'), (2, 'Zz1'), (3, 'plain_id'), (4, 'https://drive.example/none')) t(id, file_id)"),
    "sql_escape": (escaped, "SELECT item_id, replace(replace(replace(t, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(39), chr(39) || chr(39)) AS escaped FROM (SELECT item_id, 'it' || chr(39) || 's a ' || chr(92) || ' ' || chr(34) || 'quote' || chr(34) || ': ' || text AS t FROM benchmark)"),
    "first_filled": (preview_or_text, "SELECT doc_id, md5(coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN left(text, 20) END, ''), nullif(text, ''), '')) AS shown FROM documents"),
    "crud_search": (case_search, "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_type), 'steel')"),
}
