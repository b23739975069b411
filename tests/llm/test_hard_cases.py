"""Rows that once ended an operator, or lost or repeated rows of its result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecflow.llm import multi_index, pii, toxicity, warc

LONG = 1_000_000
WORST = {
    "labels": "x@" + "a." * 5000 + "com",
    "many labels": "x@" + "a." * (LONG // 2),
    "no domain": "x@" * (LONG // 2),
    "dots": "x@a" + "." * LONG,
    "one label": "x@" + "a" * LONG,
    "local part": "a" * 100_000 + "@example.com",
    "no local part": "a." * (LONG // 2),
    "octets": "1." * (LONG // 2),
    "figures": "1" * LONG,
    "groups of figures": "12 " * (LONG // 15),
    "cards": "4111 1111 1111 1111 " * 2000,
    "accounts": "DE89 3704 0044 0532 0130 00 " * 2000,
    "account beginnings": "AB12 " * (LONG // 25),
    "dates": "2024-01-01 " * 20_000,
    "date beginnings": "12-" * (LONG // 15),
    "plus signs": "+1" * (LONG // 2),
    "brackets": "(12" * (LONG // 3),
    "security numbers": "123-45-6789 " * 20_000,
}


def test_pii_on_worst_texts(spark):
    texts = ["mail anna@example.com call 555-234-5678 now", *(f"mail anna@example.com {w} call 555-234-5678 now" for w in WORST.values())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    got = [x.text for x in pii.with_pseudonyms(docs, "k").orderBy("doc_id").collect()]
    for text, new in zip(texts, got):
        assert len(new) == len(text) and new.startswith(got[0][:22]) and new.endswith(got[0][-21:]) and "anna@" not in new


def test_trunk_numbers_stay_in_their_plan(spark):
    numbers = spark.range(100_000).select(F.concat(F.lit("0"), F.format_string("%08d", F.col("id") * 997 % 10**8)).alias("n"))
    numbers = numbers.select(F.concat(F.substring("n", 1, 3), F.lit(" "), F.substring("n", 4, 3), F.lit(" "), F.substring("n", 7, 3)).alias("text"))
    got = pii.with_pseudonyms(numbers, "k")
    assert got.filter(F.col("text").rlike("^0[0-9]{2} [0-9]{3} [0-9]{3}$")).distinct().count() == 100_000


def test_toxicity_training_passes_over_what_does_not_fit(spark):
    r = random.Random(1)
    texts = [("awful stupid idiot. " if i % 3 == 0 else "good kind friend. ") + " ".join(r.choices("the of and a to".split(), k=20)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = labels.filter(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    with_long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("very long words. "), 4000)).otherwise(F.col("text")))
    model = toxicity.fit(with_long, labels, max_chars=30_000)
    assert len(model.weights) > 3
    got = toxicity.with_toxicity(docs, model).select("doc_id", "toxicity.predicted").collect()
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in got]) > 0.98


def test_one_query_id_with_several_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(0, r.normal(size=8).tolist()), (0, r.normal(size=8).tolist())] + [(i, r.normal(size=8).tolist()) for i in range(1, 40)]
    rows += [rows[5], rows[5]]  # repeated candidates are rows of their own
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=40).orderBy("rank").collect()
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    want = sorted(((-max(float(q @ v) for j, q in unit if j == 0), i) for i, v in unit if i != 0))[:40]
    assert [x.vec_id for x in got] == [i for _, i in want]
    assert np.allclose([x.score for x in got], [-s for s, _ in want])


def _record(i, body=b"x" * 3000):
    return warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:x:{i}>", "WARC-Target-URI": "http://a/"}, body)


@pytest.mark.parametrize("chunk", [64, warc.CHUNK])
def test_damage_within_an_archive(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    r = random.Random(5)
    parts = [warc.member(_record(i, r.randbytes(3000))) for i in range(20)]
    torn = bytearray(parts[5])
    torn[len(torn) // 2 : len(torn) // 2 + 40] = b"\0" * 40
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*parts[:5], bytes(torn), *parts[6:]]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join([*parts[:5], parts[5][20:], *parts[6:], b"rubbish"]))
    endless = b"WARC/1.1\r\nX: " + b"y" * (2 * warc.HEADER_BYTES) + b"\r\n\r\n"
    (tmp_path / "c.warc").write_bytes(b"".join([_record(0), endless, _record(2)]))
    (tmp_path / "d.warc.gz").write_bytes(warc.member(b"".join([_record(0), endless, _record(2)])))
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    found = lambda f: [int(x["record_id"][6:]) for x in reader.stream(f"file://{tmp_path}/{f}")]
    assert [i for i in found("a.warc.gz") if i != 5] == [i for i in range(20) if i != 5]
    assert found("b.warc.gz") == [i for i in range(20) if i != 5]
    assert found("c.warc") == found("d.warc.gz") == [0, 2]
    strict = warc.WarcReader({"path": f"file://{tmp_path}", "damaged": "fail"})
    for f in ("b.warc.gz", "c.warc", "d.warc.gz"):
        with pytest.raises(warc.Damaged):
            list(strict.stream(f"file://{tmp_path}/{f}"))


def test_damage_in_an_indexed_archive(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 500) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}")
    archive = next(p for p in tmp_path.rglob("*.warc.gz") if p.stat().st_size)
    raw = bytearray(archive.read_bytes())
    raw[len(raw) // 2 : len(raw) // 2 + 30] = b"\0" * 30
    archive.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged|gzip|ends before|headers"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()
