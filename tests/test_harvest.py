"""Fetching, crawls, PDF files, commands and the status server, against a server of the test's own."""

import json
import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from gleaner.operators import crawl, harvest, listing
from gleaner.sources import documents, market
from gleaner.streaming import status


@pytest.fixture(scope="module")
def site():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            broken = self.path == "/flaky" and asked.count("/flaky") < 3
            self.send_response(503 if broken else 404 if self.path == "/gone" else 200)
            self.end_headers()
            self.wfile.write(b"" if broken else f"page {self.path} {self.headers['User-Agent']}".encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", asked
    server.shutdown()


CLIENT = harvest.http_client(harvest.HttpSettings(user_agent="tester", wait=0.01, timeout=5))


def test_client_tries_again_where_it_helps(site):
    base, asked = site
    get = CLIENT()
    assert get(base + "/flaky") == (200, b"page /flaky tester") and asked.count("/flaky") == 3
    assert get(base + "/gone") == (404, b"") and asked.count("/gone") == 1
    assert get("http://127.0.0.1:1/") == (0, b"") and get("no url") == (0, b"")


def test_crawl_leaves_out_what_it_should(spark, site):
    base, _ = site
    links = "".join(f'<a href="{base}/{x}">x</a>' for x in ("a", "a", "b", "known", "secret/1", "skip"))
    pages = spark.createDataFrame([(base + "/list", links), (None, None)], "url string, html string")
    history = spark.createDataFrame([(base + "/known",), (None,)], "url string")
    host = spark.createDataFrame([(base + "/",)], "url string").select(crawl.host_of(F.col("url")).alias("host"), F.lit("User-agent: *\nDisallow: /secret").alias("body"))
    rows = harvest.crawl(pages, history, crawl.robots_rules(host), CLIENT, accept=lambda u: ~u.endswith("/skip"), host_interval=0.01).collect()
    assert sorted((r["url"], r["status"], r["html"]) for r in rows) == [(f"{base}/{x}", 200, f"page /{x} tester") for x in "ab"]
    assert harvest.crawl(pages.limit(0), history, crawl.robots_rules(host), CLIENT).count() == 0


def test_commands(spark):
    rows = spark.createDataFrame([("one",), ("",), (None,)], "filename string")
    assert sorted((r["exit_code"], r["output"]) for r in harvest.run_command(rows, ["echo", "-n"]).collect()) == [(0, ""), (0, ""), (0, "one")]
    assert {r["exit_code"] for r in harvest.run_command(rows, ["/no/such/command"]).collect()} == {None}


def test_pdf_files(spark, tmp_path):
    for name, content in (("good.pdf", b"%PDF-1.4 words"), ("bad.pdf", b"%PDF-x"), ("page.pdf", b"<html>"), ("empty.pdf", b""), ("note.txt", b"%PDF")):
        (tmp_path / name).write_bytes(content)

    def reader():
        def read(content):
            if b"-x" in content:
                raise ValueError("damaged")
            return content.decode()[9:]

        return read

    rows = documents.read_pdfs(spark, str(tmp_path), reader).collect()
    assert sorted((r["module"], r["title"], r["text"]) for r in rows) == [("PDF", "bad", ""), ("PDF", "good", "words")]


def test_circulars_and_names(spark):
    bodies = ['[{"filePath":"/a.pdf","subject":"S","nseCircularNumber":"7"},{"subject":"none"}]', "[]", "no json", None]
    rows = listing.circulars(spark.createDataFrame([(b,) for b in bodies], "body string"), "https://x.example/").collect()
    assert [(r["url"], r["title"], r["unique_id"]) for r in rows] == [("https://x.example/a.pdf", "S", "7")]
    names = spark.createDataFrame([("http://h/x.y.xlsx",), ("plain",), ("http://h/" + "n" * 60,)], "u string").select(harvest.dataset_file("m", F.col("u"), F.lit("2024-01-02")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["m_x.y_2024_01_02.xlsx", "m_data_2024_01_02.xlsx", f"m_{'n' * 48}_2024_01_02.xlsx"]
    assert [r["url"][-21:] for r in market.price_history(spark, "2024-07-31", "2024-08-04").orderBy("day").collect()] == ["cm31JUL2024bhav.csv.zip"[-21:], "0240801_F_0000.csv.zip"[-21:], "0240802_F_0000.csv.zip"[-21:]]


def test_status(spark):
    p = status.Progress({"feed": 3, "site": None}, {"themes": None})
    p.add(retrieved=4, processed=3)
    p.count_errors(spark.createDataFrame([("404",), ("404",), ("5xx",), ("2xx",), (None,)], "class string"))
    server = status.serve(p)
    get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}").read())
    full = get("/status/")
    assert full["performance"]["url_discovery"] == {"progress_percent": 50.0, "plugins_completed": 1, "plugins_total": 2}
    assert full["performance"]["data_processing"] == {"progress_percent": 75.0, "completed": 3, "total": 4}
    assert full["database"]["http_errors"]["HTTP_404"] == 2 and get("/metrics")["HTTP_5xx"] == 1
    assert [w["url_discovery_complete"] for w in full["workers"]["worker_pairs"]] == [True, False]
    assert get("/status/summary")["summary"]["docs_retrieved"] == 4 and get("/health") == {"status": "ok"} and "/status" in get("/")["endpoints"]
    with pytest.raises(urllib.error.HTTPError):
        get("/other")
    server.shutdown()


def test_streams_report(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    events.write.parquet(str(tmp_path / "in"))
    p = status.Progress()
    listener = status.watch(spark, p)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination()
    until = time.monotonic() + 20
    while p.processed < events.count() and time.monotonic() < until:
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert p.retrieved == p.processed == events.count()
