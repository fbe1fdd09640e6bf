"""The state of a run as JSON, and a small server for it.

A run reports into a :class:`Progress`; :func:`watch` lets a streaming session
do so by itself.  The server answers /status, /status/summary, /health,
/metrics and / from a thread of the driver.
"""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

NAME, VERSION = "gleaner", "1"
#: Status classes under the names by which dashboards know them.
ERROR_NAMES = {"403": "HTTP_403", "404": "HTTP_404", "5xx": "HTTP_5xx", "timeout": "HTTP_timeouts", "transport": "HTTP_transport_errors"}


def _now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class Progress:
    """Counters of a run: documents by retriever and by processor (None until it is through), errors by class, queue sizes."""

    retrievers: dict[str, int | None] = field(default_factory=dict)
    processors: dict[str, int | None] = field(default_factory=dict)
    retrieved: int = 0
    processed: int = 0
    errors: dict[str, int] = field(default_factory=dict)
    queues: dict[str, int] = field(default_factory=dict)
    running: bool = True
    started: datetime = field(default_factory=_now)
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def add(self, retrieved: int = 0, processed: int = 0) -> None:
        with self.lock:
            self.retrieved += retrieved
            self.processed += processed

    def count_errors(self, fetched: DataFrame, kind: str = "class") -> None:
        """Add a table of replies by class; one aggregation, a handful of rows."""
        found = fetched.groupBy(kind).count().where(f"`{kind}` in ({', '.join(map(repr, ERROR_NAMES))})").collect()
        with self.lock:
            for r in found:
                self.errors[r[kind]] = self.errors.get(r[kind], 0) + r["count"]


def _percent(part: int, whole: int) -> float:
    return 100.0 * part / whole if whole else 0.0


def full_status(p: Progress) -> dict:
    """Everything that a dashboard shows."""
    with p.lock:
        through = sum(n is not None for n in p.retrievers.values())
        most = max(p.retrieved, p.processed)
        return {
            "timestamp": _now().isoformat(),
            "application": {"name": NAME, "version": VERSION, "is_running": p.running, "start_time": p.started.isoformat(), "elapsed_seconds": int((_now() - p.started).total_seconds())},
            "performance": {
                "url_discovery": {"progress_percent": _percent(through, max(len(p.retrievers), 1)), "plugins_completed": through, "plugins_total": len(p.retrievers)},
                "content_fetching": {"progress_percent": _percent(p.retrieved, p.retrieved), "completed": p.retrieved, "total": p.retrieved},
                "data_processing": {"progress_percent": _percent(p.processed, most), "completed": p.processed, "total": most},
            },
            "queues": {name: {"size": p.queues.get(name, 0)} for name in ("database_operations", "fetch_completed", "data_processing_input")},
            "workers": {
                "worker_pairs": [{"plugin": name, "url_worker_alive": p.running and n is None, "content_worker_alive": p.running and n is None, "url_discovery_complete": n is not None} for name, n in p.retrievers.items()],
                "data_processing_workers": [{"name": name, "is_alive": p.running} for name in p.processors],
            },
            "database": {"connection_status": "connected", "http_errors": {label: p.errors.get(kind, 0) for kind, label in ERROR_NAMES.items()}},
            "plugins": {
                "content_plugins": [{"name": name, "total_urls": n or 0, "processed_urls": n or 0} for name, n in p.retrievers.items()],
                "data_processing": [{"name": name, "urls_input": p.retrieved, "urls_processed": n or 0} for name, n in p.processors.items()],
            },
        }


def summary(p: Progress) -> dict:
    with p.lock:
        return {"timestamp": _now().isoformat(), "summary": {"is_running": p.running, "docs_retrieved": p.retrieved, "docs_processed": p.processed, "retrievers_enabled": len(p.retrievers), "data_processors_enabled": len(p.processors)}}


def metrics(p: Progress) -> dict:
    with p.lock:
        return {label: p.errors.get(kind, 0) for kind, label in ERROR_NAMES.items()}


def watch(spark: SparkSession, p: Progress) -> StreamingQueryListener:
    """Count the rows of all streaming queries of the session as retrieved and processed.  The listener is given back, for removal."""

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            n = int(event.progress.numInputRows)
            p.add(retrieved=n, processed=n)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener


def serve(p: Progress, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Answer in the background; the server's ``server_address`` tells the port, its ``shutdown()`` ends it."""
    pages = {
        "": lambda: {"service": f"{NAME} status", "version": VERSION, "endpoints": sorted(x for x in pages if x)},
        "/health": lambda: {"status": "ok"},
        "/status": lambda: full_status(p),
        "/status/summary": lambda: summary(p),
        "/metrics": lambda: metrics(p),
    }

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            page = pages.get(self.path.split("?")[0].rstrip("/"))
            body = json.dumps(page()).encode() if page else b"404 Not Found"
            self.send_response(200 if page else 404)
            self.send_header("Content-Type", "application/json" if page else "text/plain")
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
