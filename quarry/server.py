"""A small HTTP service over an index's graph, and the two tools an assistant calls."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quarry import engine


def make_server(index: engine.CodeIndex, focus: str | None = None, depth: int = 2, most: int = 90, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """GET / and /api/graph; POST /api/edge, /api/edge/delete (all types between a pair) and /api/reset (the edges the
    service started with). Requests take turns."""
    start, turn = index.tables["edges"], threading.Lock()
    n = lambda: index.tables["edges"].count()

    def get(path: str):
        if path == "/":
            return 200, engine.html(index.view(focus, depth, most)), "text/html"
        if path == "/api/graph":
            return 200, json.dumps(index.view(focus, depth, most)), "application/json"
        return 404, "{}", "application/json"

    def post(path: str, body: dict):
        spark = index.spark
        if path == "/api/edge":
            more = spark.createDataFrame([(body["from"], body["to"], body.get("type", "calls"))], "src string, dst string, type string")
            index.save_edges(engine.graph.add_edges(index.tables["edges"], index.tables["nodes"], more))
            return 200, json.dumps({"ok": True, "edges": n()}), "application/json"
        if path == "/api/edge/delete":
            before = n()
            index.save_edges(engine.graph.remove_edges(index.tables["edges"], spark.createDataFrame([(body["from"], body["to"])], "src string, dst string")))
            return 200, json.dumps({"ok": True, "removed": before - n()}), "application/json"
        if path == "/api/reset":
            index.save_edges(start)
            return 200, json.dumps(index.view(focus, depth, most)), "application/json"
        return 404, "{}", "application/json"

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, text: str, kind: str) -> None:
            data = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            with turn:
                self._send(*get(self.path))

        def do_POST(self):
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                with turn:
                    self._send(*post(self.path, body))
            except (KeyError, ValueError) as e:
                self._send(400, json.dumps({"error": str(e)}), "application/json")

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(index: engine.CodeIndex, focus=None, depth: int = 2, most: int = 90, host: str = "127.0.0.1", port: int = 8000) -> None:
    make_server(index, focus, depth, most, host, port).serve_forever()


def search_code(index: engine.CodeIndex, query: str, k: int = 6) -> str:
    """The k best chunks for a question, each with its place."""
    rows = index.search([query], k).collect()
    return "\n\n".join(f"{r['citation']}  {r['symbol_name'] or ''}\n{r['code']}" for r in rows) or "nothing found"


def answer_question(index: engine.CodeIndex, query: str) -> str:
    r = index.answer([query]).first()
    return r["answer"] or "no answer"
