"""The operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables
and columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecflow.llm import lsh_forest, mixing, multi_index, packing, pii, queries, suffix_dedup, token_store, toxicity, warc, weighted_sampling
from vecflow.llm.storage import workdir

WORDS = [f"{a}{b}" for a in "ka lo mi ne su ta vo re".split() for b in "rin tol bek dan sor".split()]
SCHEMA = "doc_id long, text string, score string, toxicity string, topic string, uid string, source string, lang string"


def texts(n=40, seed=1):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(30, 120))) + "." for _ in range(n)]
    near = base[0].split()
    near[50 % len(near)] = "changed"
    return [*base, base[0], " ".join(near), "", None, "don't <|endoftext|>\tstop", "é" * 30_000, "one two"]


@pytest.fixture(scope="module")
def docs(spark):
    own = texts()
    rows = [(i, t, "x", "x", "x", "x", f"s{i % 3}" if i % 7 else None, "en") for i, t in enumerate(own)]
    rows += [(None, "no id here but words enough to be five", "x", "x", "x", "x", "s1", None), rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    uri = workdir(spark, "test-tokens")
    token_store.write_tokens(docs, uri, path, 2)
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]
    want, start = [], 0
    for i, x in sorted(local(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        a = np.array(ids(x), "<u4")
        want.append((i, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    assert sorted(map(tuple, token_store.token_digests(spark, uri).collect()), key=str) == sorted(want, key=str)
    assert token_store.read_document(uri, 5)[0].tolist() == ids(dict(local(docs))[5]) and token_store.read_document(uri, 999) == []
    uri = workdir(spark, "test-tokens")
    token_store.write_tokens(empty, uri, path, 2)
    assert token_store.token_digests(spark, uri).count() == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(5)
    rows = []
    for i in range(400):
        bad = i % 3 == 0
        s = [" ".join(r.choice(WORDS) for _ in range(8)) for _ in range(6)]
        if bad:
            s[r.randrange(6)] += " horrid" + r.choice(["ly", "er", "est"])
        rows.append((i, ". ".join(s), int(bad)))
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = own.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    model = toxicity.fit(own.drop("toxic"), labels)
    got = toxicity.with_toxicity(own, model).filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([x.toxicity.predicted == x.toxic for x in got]) > 0.95
    hit = next(x for x in got if x.toxic and x.toxicity.predicted)
    assert any("horrid" in hit.text[s.start : s.end] for s in hit.toxicity.offending)
    rest = toxicity.with_toxicity(docs, model).collect()
    assert len(rest) == docs.count() and all(x.toxicity.score == 0 for x in rest if not x.text)
    assert toxicity.with_toxicity(empty, toxicity.fit(empty, empty.select("doc_id", F.lit(1).alias("toxic")))).count() == 0


def test_multi_index(spark):
    x = np.random.default_rng(3).normal(size=(600, 32))
    x[7] = x[11]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000, None, "x"), (1001, [0.0] * 32, "x"), (1002, [float("nan")] * 32, "x"), (None, x[0].tolist(), "x"), (1003, [1.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in multi_index.search(table, F.col("vec_id") % 50 == 0, 5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = set(np.lexsort((np.arange(600), -s))[:5].tolist())
        hits += len(best & {v for _, v, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s[v] - c) < 1e-12 for _, v, c in got[q])
    assert hits >= 0.9 * 60 and 1000 not in got
    assert multi_index.search(table.filter("false"), F.lit(True), 5).count() == 0


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_lsh_forest(spark, docs, empty, monkeypatch):
    base = texts(30, 2)
    r = random.Random(9)
    long = [" ".join(r.choice(WORDS) for _ in range(200))]
    for i in range(40):
        w = long[0].split()
        w[r.randrange(200)] = f"new{i}"
        long.append(" ".join(w))
    own = spark.createDataFrame([(i, t) for i, t in enumerate(base + long)], "doc_id long, text string")
    sets = [shingle_set(t) for t in base + long]
    links = [sum(i != j and bool(a) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    for block in (1024, 8):  # the second splits nodes and groups
        monkeypatch.setattr(lsh_forest, "BLOCK", block)
        got = {x.doc_id: x for x in lsh_forest.joined(own).collect()}
        assert [got[i].n_links for i in range(len(sets))] == links
        assert {got[i].class_id for i in range(len(base), len(sets))} == {len(base)}
    monkeypatch.undo()
    kept = lsh_forest.deduplicated(docs)
    assert kept.columns == docs.columns
    left = [x.doc_id for x in kept.collect()]
    assert 0 in left and 40 not in left and 41 not in left and left.count(3) == 1 and 42 in left and 43 in left and None in left
    assert lsh_forest.joined(empty).count() == 0 and lsh_forest.deduplicated(empty).count() == 0


def test_suffix_dedup(spark, docs, empty):
    own = [t for t in texts(25, 3)]
    own[4] = own[1][:40] + own[2][10:90] + "é" + own[1][20:]
    rows = [(i, t) for i, t in enumerate(own)]
    got = {x.doc_id: x for x in suffix_dedup.deduplicated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for i, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        mine = set()
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
            mine.add(b[k : k + 50])
        seen |= mine
        spans = sum(1 for s in bytes(gone).split(b"\0") if s)
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, kept)
    rest = suffix_dedup.deduplicated_bytes(docs).collect()
    assert len(rest) == docs.count() and sum(x.n_removed for x in rest if x.doc_id == 3) == 0
    assert suffix_dedup.deduplicated_bytes(empty).count() == 0


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pii(spark, docs, empty):
    own = ["card 4673763317067198, bad 4673763317067199.", "4673-7633-1706-7198", "a.b1@mail.example.com twice a.b1@mail.example.com", "on 2024-02-29 not 2023-02-29", "1.2.3.4 and 300.1.1.1", "plain text, nothing", "DE89370400440532013000", "+1 (285) 555-0658"]
    got = [x.text for x in pii.with_pseudonyms(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert all(len(a) == len(b) for a, b in zip(own, got))
    card = re.search(r"\d{16}", got[0]).group()
    assert luhn(card) and card != "4673763317067198" and "4673763317067199" in got[0] and got[1].replace("-", "") == card
    mails = re.findall(r"\S+@mail\.example\.com", got[2])
    assert mails[0] == mails[1] != "a.b1@mail.example.com"
    assert "2023-02-29" in got[3] and "2024-02-29" not in got[3] and "300.1.1.1" in got[4] and got[5] == own[5]
    assert got[6][:2] == "DE" and int(re.sub("[A-Z]", lambda m: str(ord(m.group()) - 55), got[6][4:] + got[6][:4])) % 97 == 1
    assert got[7].startswith("+1 (")
    ips = spark.range(0, 156 * 90 * 100, 37).select(pii.permuted_number(F.col("id"), (F.lit(156 * 90).cast("long"), F.lit(100).cast("long")), "k", "ip").alias("d"))
    assert ips.distinct().count() == ips.count()
    days = spark.range(0, 150 * 487, 61).select(pii.permuted_number(F.col("id"), pii.DAYS, "k", "date").alias("d"))
    assert days.distinct().count() == days.count() and days.filter("d < 0 or d >= 150 * 487").count() == 0
    rest = pii.with_pseudonyms(docs, "k")
    assert rest.columns == docs.columns and [x for x in local(rest) if x[0] == 43][0][1] is None
    assert pii.with_pseudonyms(empty, "k").count() == 0


def test_mixing(spark, docs, empty):
    r = random.Random(4)
    rows = [(i, " ".join(["word"] * r.randint(5, 60)) + (" @x" if i % 5 == 0 else ""), f"s{i % 4 if i % 3 else 0}", "en" if i % 2 else "fr") for i in range(3000)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells = own.withColumns({"topic": mixing.topic_of(F.col("text")), "tokens": mixing.token_count(F.col("text"))}).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = mixing.raked(cells).toPandas()
    for m in mixing.MARGINS:
        by = raked.groupby(m)[["tokens", "weight"]].sum()
        share = by["tokens"] ** 0.5 / (by["tokens"] ** 0.5).sum()
        assert np.allclose(by["weight"], share, atol=1e-6)
    got = mixing.mixed(own).toPandas()
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert abs((got["n_tokens"]).sum() - 0.5 * total) < 0.05 * total and (got["probability"] <= 1).all()
    assert abs((got["n_tokens"] * got["token_weight"]).sum() - total) < 0.08 * total
    rest = mixing.mixed(docs, keep=1.0)
    assert rest.count() == docs.count() and rest.columns.count("topic") == 1
    assert mixing.mixed(empty).count() == 0


def jaccard(a, b):
    x, y = collections.Counter(a.lower().split()), collections.Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_weighted_sampling(spark, docs, empty):
    r = random.Random(8)
    own = [" ".join(" ".join([f"w{r.randrange(3000)}"] * r.randint(1, 4)) for _ in range(r.randint(20, 100))) for _ in range(60)]
    own += [own[0], "", "é" * 3000, "one two"]
    got = {x.doc_id: x for x in weighted_sampling.fingerprints(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    error = []
    for i, t in enumerate(own):
        nxt = own[(i + 1) % len(own)]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(t.split()) > 5:
            error.append((got[i].near_edited - jaccard(t, edited), got[i].near_next - jaccard(t, nxt)))
    assert np.abs(np.mean(error, axis=0)).max() < 0.06
    assert got[0].fingerprint == got[60].fingerprint
    rest = weighted_sampling.fingerprints(docs).collect()
    assert len(rest) == docs.count()
    twice = [x for x in rest if x.doc_id == 3]  # one row repeats id and text
    assert len(twice) == 2 and twice[0] == twice[1]
    assert weighted_sampling.fingerprints(empty).count() == 0


def test_warc(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a", page), (2, "http://b\r\nX: y", page), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "n", page), (7, "é", "ü" * 80)]
    uri = workdir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")), uri)
    got = {x.page_id: x for x in warc.page_records(warc.read_archives(spark, uri)).collect()}
    assert len(got) == 7 and got[2].record_type == "revisit" and got[2].refers_to == 1 and got[None].refers_to == 1
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
    assert got[5].record_type == got[4].record_type == got[3].record_type == "response"
    archives = warc.read_archives(spark, uri, payload=False)
    few = archives.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http"))
    assert few.count() == 1 and archives.filter("payload is not null").count() == 0
    plain = warc.WarcReader({"path": uri})
    raw = b"".join(warc.record({"WARC-Type": t, "WARC-Record-ID": f"<urn:page:{t}>"}, b"H: 1\r\n\r\nbody") for t in ("response", "other"))
    path = workdir(spark, "test-warc-plain")
    with warc.new_file(f"{path}/a.warc") as f:
        f.write(raw)
    assert [r["payload"] for r in plain.stream(f"{path}/a.warc")] == [b"body", None]


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.packed_documents(docs, path, 1, 256).toPandas()
    want = collections.Counter()
    for i, x in local(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 256)):
            want[(-1 if i is None else i, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()))] += 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert collections.Counter(tuple(int(v) for v in r) for r in got[cols].fillna(-1).itertuples(index=False)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 256 and (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 256 + 1
    assert packing.packed_documents(empty, path, 1, 256).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 3, 3, 2, 2, 2, 1] * 10)
    bins = np.arange(len(lengths))  # the worst start: a bin each
    better = packing.improve(lengths, bins, 12, patience=200)
    assert better.max() + 1 <= -(-lengths.sum() // 12) + 1 and np.bincount(better, lengths).max() <= 12


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_by_pieces_equals_the_library(name, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from vecflow.llm import tokens

    path = public_tokenizers.path(name)
    rng = random.Random(5)
    signs = [*"ab Z'0. \n\n -|,é¿ñ", "<|endoftext|>", "'s", "n't", "  ", " | ", "\t", "\x01", "中"]
    texts = ["".join(rng.choices(signs[: rng.choice([17, len(signs)])], k=rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "'", "a  ", "  a", "x" * 100 + " y" * 500, "don 't can't " * 40]
    library = Tokenizer.from_file(path)
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.MemoEncoder(path).encode(texts) == expected
    monkeypatch.setattr(tokens, "RUN_CHARACTERS", 64)  # many runs, and a memo that starts anew
    assert tokens.MemoEncoder(path, memo_limit=50).encode(texts) == expected
    assert tokens.MemoEncoder(path).encode([]) == []
