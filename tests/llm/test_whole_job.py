"""Cases in which operators once did less than the whole job."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from vecflow.llm import lsh_forest, pii, weighted_sampling
from vecflow.llm.shingles import shingle_sets


def test_lsh_forest_finds_pairs_that_share_no_long_prefix(spark):
    r = random.Random(6)
    rows = []
    while len(rows) < 12:
        a = [f"w{r.randrange(10**6)}" for _ in range(94)]
        b = a.copy()
        b[30], b[60] = "other", "another"  # 80 shared shingles of 100
        x, y = shingle_sets(pa.array([" ".join(a), " ".join(b)]))
        same = (lsh_forest.signature(x) == lsh_forest.signature(y)).reshape(lsh_forest.TREES, lsh_forest.LABEL)
        if not same[:, :6].all(axis=1).any():
            assert len(np.intersect1d(x, y)) == 80 and len(np.union1d(x, y)) == 100
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = lsh_forest.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == [(i, i - i % 2, 1) for i in range(12)]


def test_fingerprints_are_near_for_each_document(spark):
    r = random.Random(4)
    words = [[f"w{r.randrange(50000)}" for _ in range(r.randint(40, 200))] for _ in range(80)]
    texts = [" ".join(w) for w in words]
    for i in range(1, 80, 2):  # the next document, changed in a fifth of its words or less
        w = words[i - 1].copy()
        for k in range(r.randrange(len(w) // 5)):
            w[k] = f"new{k}"
        texts[i] = " ".join(w)
    got = {x.doc_id: x for x in weighted_sampling.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    error = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        for estimate, other in ((got[i].near_edited, t[: len(t) - q] + nxt[:q]), (got[i].near_next, nxt)):
            x, y = collections.Counter(t.split()), collections.Counter(other.split())
            true = sum((x & y).values()) / sum((x | y).values())
            if true > 0.2:
                error.append(estimate - true)
    assert len(error) > 100 and np.sqrt(np.mean(np.square(error))) < 0.07 and np.abs(error).max() < 0.23


def test_pii_beside_other_numbers(spark):
    card, account = "4673763317067198", "ES9121000418450200051332"
    own = [f"{card} 12/26", f"12 {card}", "4673-7633-1706-7198 123", "4222222222222 4673 7633 1706 7198 12/26", f"{account} EUR", f"{card} 12-05-2024", "on 03/25/2024", "25/03/2024", "31/31/2024", "12/31/1800"]
    got = [x.text for x in pii.with_pseudonyms(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    alone = [x.text for x in pii.with_pseudonyms(spark.createDataFrame(list(enumerate([card, account])), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert alone[0] != card and alone[1] != account
    assert got[0] == f"{alone[0]} 12/26" and got[1] == f"12 {alone[0]}" and got[2].replace("-", "") == f"{alone[0]} 123"
    assert not got[3].startswith("4222222222222 ") and got[3][14:].replace(" ", "") == f"{alone[0]}12/26"
    assert got[4] == f"{alone[1]} EUR" and got[5].startswith(alone[0] + " ") and not got[5].endswith(" 12-05-2024")
    month, day, year = got[6][3:].split("/")
    assert got[6] != own[6] and int(month) <= 12 < int(day) and 1900 <= int(year) < 2100
    assert got[7] != own[7] and got[8:] == own[8:]
    days = spark.range(0, 365 * 40).select(F.date_format(F.expr("date_add(date'1990-01-01', cast(id as int))"), "MM/dd/yyyy").alias("text")).filter("substring(text, 4, 2) > 12")
    assert pii.with_pseudonyms(days, "k").distinct().count() == days.count()


def test_warc_of_elsewhere(spark, tmp_path):
    import gzip
    import time

    from vecflow.llm import warc

    r = random.Random(11)
    text = lambda n: "".join(r.choices("abcdefghij <>", k=n)).encode()

    def record(i, kind, body):
        return warc.record({"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{i}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": f"http://site{i % 3}/{i}"}, body)

    records, want = [], []
    for i in range(3000):
        kind = ("warcinfo", "request", "response", "metadata", "resource", "conversion")[i % 6]
        payload = text(r.choice([0, 10, 5000])) if i % 50 else b"\x1f\x8b\x08" + text(300_000)
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) if kind == "response" else b""
        records.append(record(i, kind, http + payload))
        want.append((f"urn:x:{i}", kind, payload if kind in ("response", "resource", "conversion") else None))
    (tmp_path / "a.warc").write_bytes(b"".join(records[:1000]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(warc.member(x) for x in records[1000:2000]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records[2000:])) + b"\0" * 100)
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc.gz").write_bytes(warc.member(record(9999, "resource", b"x" * 5000))[:-2000])  # cut off
    read = warc.read_archives(spark, f"file://{tmp_path}")
    got = [(x.record_id, x.record_type, None if x.payload is None else bytes(x.payload)) for x in read.collect()]
    assert sorted(g for g in got if g[0] != "urn:x:9999") == sorted(want, key=lambda x: x)
    some = read.filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://site2")).select("record_id").collect()
    assert sorted(x.record_id for x in some) == sorted(w[0] for w in want if w[1] == "response" and int(w[0][6:]) % 3 == 2)
    # splits of a compressed file hold each record once
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "b.warc.gz").write_bytes((tmp_path / "b.warc.gz").read_bytes())
    reader = warc.WarcReader({"path": f"file://{tmp_path}/one", "resync": "true", "splitBytes": "100000"})
    parts = reader.partitions()
    found = [x["record_id"] for s in parts for x in reader.stream(s.file, s.start, s.end)]
    assert len(parts) > 10 and sorted(found) == sorted(w[0] for w in want[1000:2000])

    def seconds(times):
        (tmp_path / f"long{times}.warc.gz").write_bytes((tmp_path / "b.warc.gz").read_bytes() * times)
        narrow = warc.WarcReader({"path": f"file://{tmp_path}", "payload": "false"})
        narrow.tests.append(("record_type", "in", {"nothing"}))
        began = time.process_time()
        assert not list(narrow.stream(f"file://{tmp_path}/long{times}.warc.gz"))
        return time.process_time() - began

    assert seconds(16) < 8 * seconds(4) + 0.5  # linear


def test_warc_of_no_rows_and_of_repeated_rows(spark):
    from vecflow.llm import warc
    from vecflow.llm.storage import workdir

    schema = "page_id long, url string, html string, first long, n long"
    uri = workdir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], schema), uri)
    assert warc.page_records(warc.read_archives(spark, uri)).count() == 0
    uri, html = workdir(spark, "test-warc"), "z" * 150
    rows = [(2, "a", html), (2, "a", html), (3, None, html), (None, None, html), (None, None, None), (4, "b", None), (4, "b", None), (5, "c", "y" * 3_000_000)]
    rows += [(i, "u", "same" * 50) for i in range(100, 800)]  # a hot payload
    warc.write_archives(spark.createDataFrame([(*r, 7, 7) for r in rows], schema), uri)
    got = collections.Counter((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.page_records(warc.read_archives(spark, uri)).collect())
    want = [(2, 150, "response", None)] * 2 + [(3, 150, "revisit", 2), (None, 150, "revisit", 2), (None, 0, "response", None), (5, 3_000_000, "response", None)] + [(4, 0, "response", None)] * 2
    want += [(i, 200, "response" if i == 100 else "revisit", None if i == 100 else 100) for i in range(100, 800)]
    assert got == collections.Counter(want)


def feistel_text(value, key, kind, back=False):
    """The permutation of strings written again, and its inverse."""
    import hashlib

    def shifted(part, stream, sign):
        out = ""
        for i, c in enumerate(part):
            k = sign * int(stream[(2 * i) % 64 : (2 * i) % 64 + 2], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + n:
                    c = chr((ord(c) - ord(first) + k) % n + ord(first))
                    break
            out += c
        return out

    stream = lambda turn, half: hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()
    n = len(value) // 2
    a, b = value[:n], value[n:]
    for turn in range(8, 0, -1) if back else range(1, 9):
        a, b = (shifted(b, stream(turn, a), -1), a) if back else (b, shifted(a, stream(turn, b), 1))
    return a + b


def test_pseudonyms_have_an_inverse(spark):
    r = random.Random(7)
    values = ["".join(r.choice("0123456789abcXYZ.-") for _ in range(r.randint(2, 24))) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.permuted_text(F.col("v"), "k", "any").alias("p")).collect()
    assert all(x.p == feistel_text(x.v, "k", "any") and feistel_text(x.p, "k", "any", back=True) == x.v for x in got)


def test_social_security_and_telephone_numbers_stay_in_their_domain(spark):
    r = random.Random(8)
    valid = lambda d: not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000")
    numbers = list({f"{r.randrange(10**9):09d}" for _ in range(4000)})
    own = [f"{d[:3]}-{d[3:5]}-{d[5:]}" for d in numbers]
    got = [x.text for x in pii.with_pseudonyms(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for d, before, after in zip(numbers, own, got):
        if not valid(d):
            assert after == before
            continue
        new = feistel_text(d, "k", "ssn")
        while not valid(new):
            new = feistel_text(new, "k", "ssn")
        assert after.replace("-", "") == new
        while True:  # the inverse walks back
            new = feistel_text(new, "k", "ssn", back=True)
            if valid(new):
                break
        assert new == d
    stay = ["1999 2000 2001", "12 3456 7890", "123 456 7890", "223-156-7890", "+012345678", "+123", "10.2024.300.400"]
    change = ["+1 (285) 555-0658", "(285) 555-0658", "285-555-0658", "030 1234 5678", "+4930123456789", "+44 20 7946 0958"]
    got = [x.text for x in pii.with_pseudonyms(spark.createDataFrame(list(enumerate(stay + change)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[: len(stay)] == stay
    for before, after in zip(change, got[len(stay) :]):
        assert before != after and re.sub(r"\d", "0", before) == re.sub(r"\d", "0", after)
    assert got[len(stay)][:3] == "+1 " and got[-2][:4] == "+493" and got[-1][:4] == "+44 " and got[-3][0] == "0"
    for x in got[len(stay) + 1 : len(stay) + 3]:
        assert re.fullmatch("[2-9]..[2-9]......", re.sub(r"\D", "", x))


def test_pseudonyms_by_a_key_file(spark, tmp_path):
    from vecflow.llm import queries

    (tmp_path / "key").write_text("from a file\n")
    docs = spark.createDataFrame([(1, "call +1 (285) 555-0658", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, pseudonym_key string")
    spark.conf.set(queries.KEY_FILE_SETTING, f"file://{tmp_path}/key")
    try:
        found = queries.with_pseudonyms(docs)
        plan = found._jdf.queryExecution().toString()
        got = found.orderBy("doc_id").collect()
    finally:
        spark.conf.unset(queries.KEY_FILE_SETTING)
    want = pii.with_pseudonyms(docs, "from a file").orderBy("doc_id").collect()
    assert got == want and "from a file" not in plan and got[0].text != "call +1 (285) 555-0658"


def test_leaders_connect_what_pairs_would_with_few_edges(spark, monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(lsh_forest, "BLOCK", 16)
    hashes = lsh_forest.TREES * lsh_forest.LABEL
    base = r.integers(0, 1 << 16, hashes)
    labels = np.tile(base, (400, 1))
    for row in labels:  # of all likenesses, and all with the first label of the first tree
        change = r.random(hashes) < r.choice([0.05, 0.15, 0.3, 0.5])
        change[: lsh_forest.LABEL] = False
        row[change] = r.integers(0, 1 << 16, change.sum())
    rows = [(i, x.astype("<u2").tobytes()) for i, x in enumerate(labels)]
    edges, depth, got = lsh_forest.candidates(spark.createDataFrame(rows, "node long, signature binary"))
    edges = [tuple(e) for e in edges.collect()]
    assert got >= lsh_forest.TARGET_RECALL or depth == 1
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    alike = (labels[:, None, :] == labels[None, :, :]).mean(axis=2) >= lsh_forest.may_be()
    assert all(find(i) == find(j) for i, j in np.argwhere(alike).tolist())
    shared = sum(len(np.unique(labels[:, 7 * t : 7 * t + depth], axis=0)) < 400 for t in range(lsh_forest.TREES))
    assert len(edges) <= 2 * 400 * shared * 2


def test_prefixes_are_shortened_by_what_is_found():
    hashes, label = lsh_forest.TREES * lsh_forest.LABEL, lsh_forest.LABEL
    near, far = np.zeros(hashes + 1), np.zeros(hashes + 1)
    near[-5:] = 10**9  # pairs that hardly differ are found with whole labels
    far[int(0.8 * hashes)] = 10**9
    assert lsh_forest.recall(near, label, label) > 1 - 1e-6 > lsh_forest.recall(far, label, label)
    assert [lsh_forest.recall(far, label, d) for d in range(label, 0, -1)] == sorted(lsh_forest.recall(far, label, d) for d in range(label, 0, -1))
    assert lsh_forest.recall(np.zeros(hashes + 1), label, label) < lsh_forest.TARGET_RECALL  # a pair may be unseen
    from math import comb

    tail = lambda m: sum(comb(hashes, i) * 0.8**i * 0.2 ** (hashes - i) for i in range(m))
    least = round(lsh_forest.may_be() * hashes)
    assert tail(least) <= 1e-12 < tail(least + 1)


def test_multi_index_of_few_rows_repeated_ids_and_several_lengths(spark):
    from vecflow.llm import multi_index

    r = np.random.default_rng(5)
    long, short = r.normal(size=(300, 24)), r.normal(size=(4, 7))
    rows = [(i, x.tolist()) for i, x in enumerate(long)] + [(50, long[50].tolist()), (77, long[77].tolist())]
    rows += [(1000 + 50 * i, x.tolist()) for i, x in enumerate(short)] + [(5000, [1.0])]
    table = spark.createDataFrame([(*x, "q", 1) for x in rows], "vec_id long, embedding array<double>, query_id string, n int")
    got = collections.defaultdict(list)
    for x in multi_index.search(table, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert 5000 not in got and [len(got[1000 + 50 * i]) for i in range(4)] == [3] * 4 and len(got) == 10
    hits = 0
    for q in range(0, 300, 50):
        others = [(i, float(np.dot(x, long[q]) / np.linalg.norm(x) / np.linalg.norm(long[q]))) for i, x in rows if len(x) == 24 and i != q]
        want = sorted(others, key=lambda t: (-t[1], t[0]))[:5]
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and [i for i, _ in got[q]] == [i for i, _ in sorted(got[q], key=lambda t: (-t[1], t[0]))]
    assert hits >= 27


def test_local_search_has_no_step_left():
    from vecflow.llm import packing

    lengths = np.random.default_rng(1).integers(600, 2000, 2000)
    bins = packing.pack_lengths(lengths, 4096)
    assert np.bincount(bins, lengths).max() <= 4096 and bins.max() + 1 <= 1.01 * lengths.sum() / 4096 + 1
    for start in (packing.best_fit(lengths[:60], 4096), packing.fullest_fit(lengths[:60], 4096)):
        better = packing.improve(lengths[:60], start, 4096)
        fill = np.bincount(better, lengths[:60]).astype(int)
        for v in range(len(fill)):
            own = np.flatnonzero(better == v)
            for b in range(len(fill)):
                if b == v or fill[b] < fill[v] or fill[b] == 4096 or fill[v] == 4096:
                    continue
                theirs = np.flatnonzero(better == b)
                out = [int(lengths[i]) for i in own] + [int(lengths[i] + lengths[j]) for i in own for j in own if i < j]
                back = [int(lengths[k]) for k in theirs]
                assert not any(lengths[i] <= 4096 - fill[b] for i in own)
                assert not any(0 < x - y <= 4096 - fill[b] for x in out for y in back)
                pairs = [int(lengths[k] + lengths[m]) for k in theirs for m in theirs if k < m]
                assert not any(0 < lengths[i] - y <= 4096 - fill[b] for i in own for y in pairs)


def test_pack_in_rounds(spark, monkeypatch):
    from vecflow.llm import packing

    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    lengths = np.random.default_rng(2).integers(1, 400, 700).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], packing.PIECES)
    got = packing.pack(pieces, 1000).toPandas()
    assert sorted(got["doc_id"]) == list(range(700)) and got.groupby("sequence_id")["length"].sum().max() <= 1000
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    assert got["sequence_id"].nunique() <= 1.03 * sum(lengths) / 1000 + 2


def test_mixing_keeps_documents_without_tokens(spark):
    from vecflow.llm import mixing

    rows = [(i, "a few words here" if i % 4 else (None, "", " \n")[i % 3], f"s{i % 3}", "en", "t") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability string")
    got = {x.doc_id: x for x in mixing.mixed(docs, keep=0.2).collect()}
    assert all(got[i].probability == 1.0 for i in range(0, 1200, 4))
    assert 100 < sum(i % 4 > 0 for i in got) < 260
    own = docs.withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "x"))
    shares = mixing.mixed(own, keep=0.3, targets={"topic": {"x": 0.9, None: 0.1}}, topic=F.col("kind")).filter("n_tokens > 0").groupBy("topic").agg(F.sum("n_tokens").alias("n")).collect()
    by = {x.topic: x.n for x in shares}
    assert 0.8 < by["x"] / sum(by.values()) < 0.97


def test_mixing_warns_of_contradicting_targets(spark):
    import pytest
    from vecflow.llm import mixing

    cells = spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="shares are still off"):
        mixing.raked(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})


def test_fingerprints_by_brute_force(spark):
    import math

    import xxhash

    def spark_hash(*values):
        seed = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if abs(v) >= 1 << 31 or isinstance(v, Long) else 4, "little", signed=True)
            seed = xxhash.xxh64(raw, seed=seed).intdigest()
        return seed

    class Long(int):
        pass

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    uniforms = lambda h: (((h & 0x7FFFFFFF) + 1) / (2**31 + 1), ((h >> 33) + 1) / (2**31 + 1))

    def fingerprint(text):
        weights = collections.Counter(signed(spark_hash(w)) >> 1 for w in re.split("[ \n\t\r]+", text.lower().strip(" ")))
        out = ""
        for k in range(weighted_sampling.SAMPLES):
            drawn = []
            for term, n in weights.items():
                a, b = uniforms(spark_hash(Long(term), 3 * k))
                c, d = uniforms(spark_hash(Long(term), 3 * k + 1))
                h = spark_hash(Long(term), 3 * k + 2)
                uniform = (h & 0x7FFFFFFF) / 2**31
                r, g = -math.log(a * b), -math.log(c * d)
                point = math.floor(math.log(n) / r + uniform)
                drawn.append((math.log(g) - r * (point - uniform + 1), ((h >> 31) + point * 0x9E3779) & 0xFFFFFF))
            out += f"{min(drawn)[1]:06x}"
        return out

    r = random.Random(12)
    own = [" ".join(r.choice("ab cd ef gh ij kl mn".split()) + str(r.randrange(6)) for _ in range(r.randint(1, 60))) for _ in range(12)] + ["", "One  one\tONE two\n", "é ß 語 語"]
    own += [" ".join(f"w{int(r.paretovariate(0.7)) % 5000}" for _ in range(n)) for n in (41, 400, 4000)]  # texts with terms that no sample has
    got = {x.doc_id: x for x in weighted_sampling.fingerprints(spark.createDataFrame([*enumerate(own), (3, own[3])], "doc_id long, text string")).collect()}
    for i, t in enumerate(own):
        q = len(t) // 4
        edited = t[: len(t) - q] + own[(i + 1) % len(own)][:q]
        assert got[i].fingerprint == fingerprint(t) and got[i].edited_fingerprint == fingerprint(edited)
        same = lambda a, b: sum(a[6 * k : 6 * k + 6] == b[6 * k : 6 * k + 6] for k in range(weighted_sampling.SAMPLES)) / weighted_sampling.SAMPLES
        assert got[i].near_edited == same(fingerprint(t), fingerprint(edited)) and got[i].near_next == same(fingerprint(t), fingerprint(own[(i + 1) % len(own)]))


def test_toxicity_by_brute_force(spark):
    import math
    import zlib

    from vecflow.llm import toxicity

    r = random.Random(3)
    words = ["alpha", "beta", "gammas", "deltas", "horridly", "horrid", "ab", "é", "x"]
    model = toxicity.Model(-3.0, {i: r.uniform(-2, 4) for w in words for i in toxicity.features(w) if r.random() < 0.8})
    texts = [r.choice(["", " "]).join(r.choice(words) + r.choice([" ", ". ", "! ", "\n", " 12 "]) for _ in range(r.randint(1, 300))) for _ in range(60)] + ["", None, "123 ...", "É x"]

    def score(text):
        rest = 1.0
        for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
            own = re.findall(r"[^\W\d_]+", sentence)
            for i in range(0, len(own), 64):
                hashed = {zlib.crc32(part.encode()) % (1 << 18) for w in own[i : i + 64] for part in [w] + [f"^{w[:n]}" for n in (4, 5) if len(w) >= n]}
                rest *= 1 - 1 / (1 + math.exp(-(-3.0 + sum(model.weights.get(h, 0.0) for h in hashed))))
        return 1 - rest

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in toxicity.with_toxicity(docs, model).collect():
        assert abs(x.toxicity.score - score(x.text)) < 1e-9 and x.toxicity.predicted == (x.toxicity.score >= 0.5)
    assert [x.h for x in spark.createDataFrame([(None,), (1,)], "doc_id long").select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()] == [False, zlib.crc32(b"1") % 5 == 0]


def test_toxicity_learns_from_bounded_text(spark):
    from vecflow.llm import toxicity

    rows = [(i, ("good words here. " if i % 2 else "horrid words here. ") * (1 if i else 5000), i % 2 == 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, _, bad in rows], "doc_id long, toxic int")
    few = toxicity.fit(docs, labels, max_chars=400)
    assert toxicity.fit(docs, labels).weights and len(few.weights) <= len(toxicity.fit(docs, labels).weights)
    assert toxicity.fit(docs, labels, max_chars=0).weights == {}


def test_stages_on_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, None, "s"), (1, text, "en", "s"), (None, "another text of some words", "en", None), (2, None, None, None), (3, "", "en", "s"), (3, "", "en", "s"), (4, "+1 (285) 555-0658", "en", "s")]
    names = ["topic", "n_tokens", "probability", "token_weight", "kept_id", "kept_hash", "copy_", "toxicity_", "uid", "root", "key"]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[f"{n}!" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    import tempfile

    sf_dir = tempfile.mkdtemp()
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(x[n] == f"{n}!" for x in got for n in names)
        # one of the two equal texts goes; all rows without words, and the others, stay
        assert len(got) == (7 if name == "toxicity" else 6) or name == "mixing"
        now = out
    assert {x.doc_id for x in now.filter("text is null or text = ''").collect()} == {2, 3}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 7
