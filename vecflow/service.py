"""Search, documents, views and evaluation over HTTP, with the standard library's server.

Every answer comes from the engine's plans; the server keeps a bounded history of its queries only.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation
from .functions import vector as V
from .operators import embedding, indexes, stores
from .operators import search as S
from .plans.retrieval import SemanticEngine
from .workspace import workdir

HISTORY, UPLOAD_CHARS, VIEW_ROWS = 50, 400, 1200


class Engine:
    """Documents (doc_id, text, lang, source) with an index over their chunks, and changes to them."""

    def __init__(self, docs: DataFrame, embedder: embedding.Embedder | None = None, index: indexes.Index | None = None):
        self.spark, self.uri = docs.sparkSession, workdir(docs.sparkSession, "documents")
        self.docs = stores.replaced(docs.select("doc_id", "text", "lang", "source"), self.uri)
        self.search_engine = SemanticEngine(self.spark, self.docs, embedder or embedding.TermEmbedder(256), index)
        self.history: deque[dict] = deque(maxlen=HISTORY)
        self.evaluations: deque[dict] = deque(maxlen=HISTORY)
        self.lock = Lock()

    def search(self, text: str, k: int = 5, category: str | None = None) -> dict:
        """Answers with scores and reasons; a category of None or "all" leaves all in."""
        began = time.perf_counter()
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        rows = self.search_engine.search(asked, max(k, 0), None if category in (None, "all") else category).orderBy("rank").collect()
        took = round(1000 * (time.perf_counter() - began), 3)
        found = [{"rank": r["rank"], "doc_id": r.doc_id, "score": r.score, "lang": r.lang, "preview": r.preview, "reason": f"{round(100 * r.score)}% similar to \"{text.strip()[:80]}\""} for r in rows]
        self.history.append({"query": text[:UPLOAD_CHARS], "results": len(found), "ms": took})
        return {"query": text, "results": found, "latency_ms": took}

    def status(self) -> dict:
        row = self.docs.agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).first()
        return {"status": "ok", "documents": row.n, "sources": row.sources, "chunks": self.search_engine.rows.count()}

    def telemetry(self) -> dict:
        took = [h["ms"] for h in self.history]
        if not took:
            return {"queries": 0, "mean_ms": 0.0, "p50_ms": 0.0, "p95_ms": 0.0, "recent": []}
        return {"queries": len(took), "mean_ms": round(sum(took) / len(took), 3), "p50_ms": round(evaluation.percentile(took, 0.5), 3), "p95_ms": round(evaluation.percentile(took, 0.95), 3), "recent": list(self.history)[::-1]}

    def view(self) -> list[dict]:
        """Coordinates of up to VIEW_ROWS chunks, chosen by a hash of their ids."""
        some = self.search_engine.rows.orderBy(F.xxhash64("vec_id")).limit(VIEW_ROWS).withColumn("p", V.thirds(F.col("v")))
        return [{"id": r.vec_id, "source": r.source, "x": round(r.p[0], 3), "y": round(r.p[1], 3), "z": round(r.p[2], 3)} for r in some.collect()]

    def topology(self) -> dict:
        """The viewed chunks in three layers, their nearest neighbours in each, and links between layers."""
        some = self.search_engine.rows.orderBy(F.xxhash64("vec_id")).limit(VIEW_ROWS).select("vec_id", "v").collect()
        nodes = [(i, r.vec_id, r.v) for i, r in enumerate(some)]
        edges, links = [], []
        for layer, step, m in ((2, 25, 3), (1, 5, 4), (0, 1, 4)):
            own = self.spark.createDataFrame([(i, v) for i, _, v in nodes if i % step == 0] or [], "vec_id long, v array<double>")
            edges += [{"layer": layer, "from": r.src, "to": r.dst} for r in S.neighbour_graph(own, m).collect()]
            links += [{"from": [layer, i], "to": [layer - 1, i]} for i, _, _ in nodes if layer and i % step == 0]
        return {"nodes": [{"id": i, "chunk": c} for i, c, _ in nodes], "edges": edges, "links": links}

    def documents(self, needle: str = "", most: int = 50) -> list[dict]:
        hit = F.lower("text").contains(needle.lower()) | F.lower("source").contains(needle.lower()) if needle else F.lit(True)
        return [r.asDict() for r in self.docs.filter(hit).orderBy("doc_id").limit(most).select("doc_id", "lang", "source", F.substring("text", 1, 200).alias("preview")).collect()]

    def change(self, doc_id: int, values: dict | None) -> bool:
        """Sets columns of a document, or removes it; False if it is not there."""
        with self.lock:
            hit = F.col("doc_id") == doc_id
            if self.docs.filter(hit).isEmpty():
                return False
            known = {c: v for c, v in (values or {}).items() if c in ("text", "lang", "source")}
            new = self.docs.filter(~hit) if values is None else self.docs.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in known.items()})
            self.docs = stores.replaced(new, self.uri)
            return True

    def evaluate(self, k: int = 5) -> dict:
        """Indexes measured on every fiftieth chunk."""
        rows = self.search_engine.rows.select("vec_id", "v")
        asked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(50)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        got = {"at": int(time.time()), "reports": evaluation.comparison(rows, asked, k, [indexes.FlatIndex(), indexes.GraphIndex()], repeats=1)}
        self.evaluations.append(got)
        return got


def handler(engine: Engine):
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, value, status: int = 200) -> None:
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def given(self) -> dict:
            value = json.loads(self.body() or b"{}")
            if not isinstance(value, dict):
                raise ValueError("an object is expected")
            return value

        def answered(self, routes: dict) -> None:
            path = urlparse(self.path).path
            try:
                for pattern, answer in routes.items():
                    if m := re.fullmatch(pattern, path):
                        value = answer(*m.groups())
                        return self.reply(value) if value is not None else self.reply({"error": "not found"}, 404)
                self.reply({"error": "not found"}, 404)
            except (ValueError, TypeError, KeyError) as e:
                self.reply({"error": str(e)}, 400)

        def do_GET(self):
            asked = parse_qs(urlparse(self.path).query)
            self.answered({
                "/health|/api/status": engine.status,
                "/api/vectors-3d": engine.view,
                "/api/hnsw-topology-3d": engine.topology,
                "/api/wandb-metrics": engine.telemetry,
                "/api/documents": lambda: engine.documents(asked.get("search", [""])[0]),
                "/api/eval/history": lambda: list(engine.evaluations),
                "/api/eval/download/(markdown|latex|json)": lambda form: engine.evaluations and {"report": getattr(stores, f"to_{form}")(engine.evaluations[-1]["reports"])} or None,
            })

        def do_POST(self):
            def search():
                got = self.given()
                return engine.search(str(got["query"]), int(got.get("top_k", 5)), got.get("category"))

            self.answered({
                "/search|/api/search": search,
                "/api/upload-search": lambda: engine.search(self.body().decode("utf-8", "replace")[:UPLOAD_CHARS]),
                "/api/eval/run": lambda: engine.evaluate(int(self.given().get("top_k", 5))),
            })

        def do_PUT(self):
            self.answered({"/api/documents/([0-9]+)": lambda i: engine.change(int(i), self.given()) or None})

        def do_DELETE(self):
            self.answered({"/api/documents/([0-9]+)": lambda i: engine.change(int(i), None) or None})

    return Handler


def server(engine: Engine, port: int = 5005) -> ThreadingHTTPServer:
    """A server of this machine only; serve_forever() starts it."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(engine))
