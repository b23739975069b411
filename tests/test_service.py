"""The HTTP surface over a few documents."""

import http.client
import json
import threading

import pytest
from vecflow import service


@pytest.fixture(scope="module")
def ask(spark):
    texts = [f"topic{i % 6} word{i} and more text of topic{i % 6} number{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)] + [(60, None, None, None)], "doc_id long, text string, lang string, source string")
    running = service.server(service.Engine(docs), 0)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        c = http.client.HTTPConnection("127.0.0.1", running.server_port, timeout=120)
        c.request(method, path, body if isinstance(body, (str, bytes)) else None if body is None else json.dumps(body))
        r = c.getresponse()
        return r.status, json.loads(r.read())

    yield call
    running.shutdown()


def test_search_and_telemetry(ask):
    status, got = ask("POST", "/search", {"query": "word7 number7", "top_k": 3})
    assert status == 200 and got["results"][0]["doc_id"] == 7 and [r["rank"] for r in got["results"]] == [1, 2, 3] and "%" in got["results"][0]["reason"]
    assert ask("POST", "/api/search", {"query": "  "})[1]["results"] == []
    some = ask("POST", "/api/search", {"query": "topic1", "category": "s1"})[1]["results"]
    assert some and all(r["doc_id"] % 2 == 1 for r in some)
    assert ask("POST", "/api/upload-search", "word9 number9 " + "x" * 1000)[1]["results"][0]["doc_id"] == 9
    assert ask("GET", "/api/wandb-metrics")[1]["queries"] == 4
    assert ask("POST", "/search", {})[0] == 400 and ask("POST", "/search", "[1]")[0] == 400 and ask("GET", "/nothing")[0] == 404


def test_documents_are_changed(ask):
    assert ask("GET", "/health")[1]["documents"] == 61
    assert [d["doc_id"] for d in ask("GET", "/api/documents?search=WORD12")[1]] == [12]
    assert ask("PUT", "/api/documents/12", {"text": "quite another", "other": 1})[0] == 200 and ask("GET", "/api/documents?search=another")[1][0]["doc_id"] == 12
    assert ask("DELETE", "/api/documents/12")[0] == 200 and ask("DELETE", "/api/documents/12")[0] == 404 and ask("GET", "/api/status")[1]["documents"] == 60


def test_views_and_evaluation(ask):
    assert len(ask("GET", "/api/vectors-3d")[1]) == 60
    topology = ask("GET", "/api/hnsw-topology-3d")[1]
    assert len(topology["nodes"]) == 60 and {e["layer"] for e in topology["edges"]} == {0, 1, 2} and all(e["from"] != e["to"] for e in topology["edges"])
    assert ask("GET", "/api/eval/download/json")[0] == 404
    got = ask("POST", "/api/eval/run", {"top_k": 3})[1]
    assert {r["index"] for r in got["reports"]} == {"flat", "graph"}
    assert len(ask("GET", "/api/eval/history")[1]) == 1 and "flat" in ask("GET", "/api/eval/download/markdown")[1]["report"]
