"""Codecs, parsers and rules on small literal inputs."""

import numpy as np
import pytest
from vecflow.operators.search import EarlyExit, index_bytes
from vecflow.sources import html, vecfiles


def test_records_round_trip_and_drop_a_partial_record():
    x = np.arange(80, dtype="f4").reshape(10, 8)
    raw = vecfiles.encode_records(x, "f")
    assert (vecfiles.decode_records(raw + b"\x08\x00", "f") == x).all()
    assert len(vecfiles.decode_records(raw, "f", 4)) == 4
    assert vecfiles.decode_records(vecfiles.encode_records(x, "i"), "i").dtype == np.int64


def test_graph_round_trip():
    assert vecfiles.decode_graph(vecfiles.encode_graph({"m": 2}, [[1], [0, 2], []])) == ({"m": 2}, [[1], [0, 2], []])
    with pytest.raises(ValueError):
        vecfiles.decode_graph(b"nothing of that kind")


def test_flat_type():
    assert vecfiles.flat_type("x.dat", 64, 4) == "<f4" and vecfiles.flat_type("x.dat", 60, 4) == "<i1"
    with pytest.raises(ValueError):
        vecfiles.flat_type("x.dat", 0, 4)


def test_article_and_feed():
    got = html.parse_article("<nav><p>" + "menu " * 9 + "</p></nav><h1>Title</h1><p>" + "word " * 9 + "</p><p>short</p><script>x</script>")
    assert got["title"] == "Title" and got["content"].count("word") == 9 and "menu" not in got["content"]
    assert html.parse_rss("<rss><channel><item><title>a & b</title><link>u</link></item><item><title>c</title></item></channel></rss>") == [{"title": "a & b", "link": "u", "description": "", "guid": "", "pubDate": ""}]
    assert html.parse_rss("<broken") == []


def test_early_exit():
    rule = EarlyExit(tau=2, epsilon=1e-3, min_steps=3)
    assert [rule.update(x) for x in (1.0, 0.5, 0.5, 0.5)] == [False, False, False, True]
    with pytest.raises(ValueError):
        EarlyExit(tau=0)


def test_memory_model():
    assert index_bytes(1000, 64)["flat"] == 256_000


def test_record_files_through_spark(spark, tmp_path):
    x = np.arange(24, dtype="f4").reshape(6, 4)
    (tmp_path / "a.fvecs").write_bytes(vecfiles.encode_records(x, "f"))
    rows = vecfiles.read_records(spark, f"file://{tmp_path}/*.fvecs").orderBy("pos").collect()
    assert [r["values"] for r in rows] == x.tolist()
