"""The indices over HTTP: transport only."""

from __future__ import annotations

import argparse
import json
import re
import time
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from siftwell.plans.query import BadQuery
from siftwell.sources.index import BadName, Exists, Manager, NotFound
from siftwell.sources.ingest import MOST_LINE, BadDocument, parse_document

HELP = "PUT /indices/{name}; GET /indices; POST /indices/{name}/_doc, _bulk, _flush, _forcemerge; GET /indices/{name}/_stats, _search?q=&limit=&sort=; DELETE /indices/{name}/_doc/{id}\n"


def bulk(index, lines: Iterable[str]) -> tuple[int, dict]:
    """One document a line, as the lines come; blank lines are skipped, a line above 1 MiB ends the call and leaves those before it indexed."""
    began, items = time.monotonic(), []
    for line in lines:
        if len(line.encode()) > MOST_LINE:
            return 400, {"error": "read bulk body: line too long"}
        if not line.strip():
            continue
        try:
            i, seq, again = index.index_document(*parse_document(line))
            items.append({"_id": i, "status": 200 if again else 201} | ({"_seq": seq} if seq else {}))
        except BadDocument as e:
            items.append({"status": 400, "error": str(e)})
    return 200, {"took_ms": int((time.monotonic() - began) * 1000), "errors": any(x["status"] >= 400 for x in items), "items": items}


def body_lines(stream, size: int) -> Iterator[str]:
    """Lines of a body of ``size`` bytes; of a longer line than MOST_LINE only so much as shows it is."""
    while size > 0:
        line = stream.readline(min(size, MOST_LINE + 2))
        if not line:
            return
        size -= len(line)
        yield line.decode("utf-8", "replace").removesuffix("\n")


def handle(manager: Manager, method: str, url: str, body: str = "", lines: Iterable[str] | None = None) -> tuple[int, dict | str]:
    """Status and body of a request; ``lines`` instead of ``body`` is a bulk body that isn't read yet."""
    parts = urlsplit(url)
    path = [unquote(p) for p in parts.path.strip("/").split("/") if p]
    try:
        match method, path:
            case "GET", []:
                return 200, HELP
            case "GET", ["healthz"]:
                return 200, {"status": "ok"}
            case "GET", ["indices"]:
                return 200, {"indices": [{"name": n, "segment_count": k} for n, k in manager.list()]}
            case "PUT", ["indices", name]:
                manager.create(name)
                return 201, {"name": name}
            case "POST", ["indices", name, "_doc"]:
                i, seq, again = manager.get(name).index_document(*parse_document(body))
                return 200 if again else 201, {"_id": i, "_seq": seq}
            case "POST", ["indices", name, "_bulk"]:
                return bulk(manager.get(name), body.split("\n") if lines is None else lines)
            case "POST", ["indices", name, "_flush"]:
                return 200, manager.get(name).flush()
            case "POST", ["indices", name, "_forcemerge"]:
                return 200, manager.get(name).force_merge()
            case "DELETE", ["indices", name, "_doc", i]:
                return 200, {"_id": i, "deleted": manager.get(name).delete(i)}
            case "GET", ["indices", name, "_stats"]:
                return 200, manager.get(name).stats()
            case "GET", ["indices", name, "_search"]:
                q = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
                limit, sort = q.get("limit", "10"), q.get("sort", "")
                if not re.fullmatch(r"\+?[0-9]{1,9}", limit):
                    return 400, {"error": "limit must be an integer >= 0"}
                if sort not in ("", "doc", "tf"):
                    return 400, {"error": "sort must be doc or tf"}
                return 200, manager.get(name).search(q.get("q", ""), int(limit), sort == "tf")
    except (BadName, BadDocument, BadQuery) as e:
        return 400, {"error": str(e)}
    except NotFound as e:
        return 404, {"error": e.args[0]}
    except Exists as e:
        return 409, {"error": str(e)}
    return 404, {"error": "no such route"}


def serve(manager: Manager, host: str = "127.0.0.1", port: int = 9200) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if urlsplit(self.path).path.rstrip("/").endswith("/_bulk"):
                status, got = handle(manager, self.command, self.path, lines=body_lines(self.rfile, size))
                self.close_connection = status != 200  # the rest of the body isn't read
            else:
                status, got = handle(manager, self.command, self.path, self.rfile.read(size).decode("utf-8", "replace"))
            data = (got if isinstance(got, str) else json.dumps(got)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(got, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer  # noqa: N815

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser()
    p.add_argument("-dataDir", "--data-dir", dest="data_dir", default="./data")
    p.add_argument("-addr", "--addr", default=":9200", help="host:port")
    a = p.parse_args()
    host, _, port = a.addr.rpartition(":")
    serve(Manager(SparkSession.builder.getOrCreate(), a.data_dir), host, int(port)).serve_forever()


if __name__ == "__main__":
    main()
