"""HTTP endpoint: /sparql with GET ?query= or POST, one shared session, one job group per request."""

from __future__ import annotations

import json
import logging
import re
import sys
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .results.writers import WRITERS, write

log = logging.getLogger("triloom.server")


def negotiate(accept: str | None, available: list[str]) -> str:
    """The available media type that an Accept header likes best; the first one if it names none."""
    best, weight = available[0], -1.0
    for part in (accept or "*/*").split(","):
        name, *params = [x.strip() for x in part.split(";")]
        q = next((float(p[2:]) for p in params if re.fullmatch(r"q=[0-9.]+", p)), 1.0)
        pattern = re.escape(name).replace(r"\*", ".*")
        found = next((t for t in available if re.fullmatch(pattern, t)), None)
        if found and q > weight and q > 0:
            best, weight = found, q
    return best


def make_server(engine: Engine, port: int = 3000, timeout: float = 60.0) -> ThreadingHTTPServer:
    """A query that isn't done after timeout seconds, or whose client is gone, has its jobs cancelled.

    Results go out in chunks; one that is cut off lacks the last chunk, so that clients don't take it for whole.
    """

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def reply(self, status: int, content: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", content)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def refuse(self, status: int, message: str) -> None:
            self.reply(status, "application/json", json.dumps({"message": message}))

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path != "/sparql":
                return self.refuse(404, "There is only /sparql here")
            self.answer(parse_qs(url.query).get("query", [""])[0])

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/sparql":
                return self.refuse(404, "There is only /sparql here")
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            kind = (self.headers.get("Content-Type") or "").split(";")[0].strip()
            if kind == "application/x-www-form-urlencoded":
                body = parse_qs(body).get("query", [""])[0]
            elif kind != "application/sparql-query":
                body = ""
            self.answer(body)

        def other(self) -> None:
            self.refuse(405 if urlsplit(self.path).path == "/sparql" else 404, "/sparql takes GET and POST" if urlsplit(self.path).path == "/sparql" else "There is only /sparql here")

        do_PUT = do_DELETE = do_PATCH = do_HEAD = other

        def answer(self, query: str) -> None:
            group = uuid.uuid4().hex
            context = engine.spark.sparkContext
            context.setJobGroup(group, query[:200], interruptOnCancel=True)
            stop = threading.Timer(timeout, engine.cancel, [group])
            stop.start()
            started, chunked = False, self.request_version != "HTTP/1.0"
            self.close_connection = True
            try:
                result = engine.sparql(query)
                content = "text/turtle" if result.form in ("CONSTRUCT", "DESCRIBE") else negotiate(self.headers.get("Accept"), [t for t in WRITERS if "/" in t])
                for chunk in write(result, content, engine.prefixes if result.form in ("CONSTRUCT", "DESCRIBE") else None):
                    if not started:
                        self.send_response(200)
                        self.send_header("Content-Type", content)
                        if chunked:
                            self.send_header("Transfer-Encoding", "chunked")
                        self.send_header("Connection", "close")
                        self.end_headers()
                        started = True
                    data = chunk.encode()
                    if data:
                        self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data) if chunked else data)
                if not started:
                    self.reply(200, content, "")
                elif chunked:
                    self.wfile.write(b"0\r\n\r\n")
            except OSError:
                engine.cancel(group)
            except Exception as e:  # noqa: BLE001  whatever goes wrong is the client's answer
                log.info("query failed: %s", e)
                if not started:
                    self.reply(400, "text/plain", f"{e}\n")
            finally:
                stop.cancel()

        def log_message(self, text: str, *args) -> None:
            log.info(text, *args)

    return ThreadingHTTPServer(("", port), Handler)


def main(argv: list[str] | None = None) -> int:
    import argparse

    from pyspark.sql import SparkSession

    from .cli import open_sources

    p = argparse.ArgumentParser(prog="triloom-http")
    p.add_argument("sources", nargs="+")
    p.add_argument("-c", metavar="FILE", help="JSON file with prefixes")
    p.add_argument("-p", type=int, default=3000, help="port")
    p.add_argument("-t", type=float, default=60.0, help="seconds until a query is stopped")
    args = p.parse_args(argv)
    prefixes = {}
    if args.c:
        with open(args.c, encoding="utf-8") as f:
            prefixes = json.load(f).get("prefixes", {})
    spark = SparkSession.builder.appName("triloom-http").getOrCreate()
    server = make_server(Engine(spark, open_sources(spark, args.sources), prefixes), args.p, args.t)
    sys.stderr.write(f"Answering queries at http://localhost:{args.p}/sparql\n")
    server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
