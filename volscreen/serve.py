"""Stored experiments over HTTP: ``python -m volscreen.serve ARTIFACTS [PORT]``.

GET /experiments/ lists them, /experiments/NAME gives the metrics, /experiments/NAME/report the memo.
"""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from volscreen.sources.artifacts import ArtifactStore, BadName, StoreError

JSON, HTML = "application/json", "text/html; charset=utf-8"


def respond(store: ArtifactStore, path: str) -> tuple[int, str, str]:
    """Status, content type and body of a GET."""
    parts = [unquote(p) for p in path.split("?", 1)[0].strip("/").split("/")]
    try:
        if parts == ["experiments"]:
            return 200, JSON, json.dumps(store.experiments())
        if len(parts) == 2 and parts[0] == "experiments":
            return 200, JSON, json.dumps(store.read_json(parts[1], "metrics"))
        if len(parts) == 3 and parts[0] == "experiments" and parts[2] == "report":
            return 200, HTML, store.read_text(parts[1], "report.html")
        status, text = 404, "no such path"
    except BadName as e:
        status, text = 400, str(e)
    except FileNotFoundError as e:
        status, text = 404, str(e)
    except (StoreError, OSError, UnicodeDecodeError) as e:
        status, text = 500, str(e)
    return status, JSON, json.dumps({"detail": text})


def server(root: str, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    store = ArtifactStore(root)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = respond(store, self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    server(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 8000).serve_forever()
