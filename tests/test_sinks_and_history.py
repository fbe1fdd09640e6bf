"""Buffered writing, archives, file names, versions, spacing of calls, and long texts in parts."""

import io
import os
import zipfile

from pyspark.sql import functions as F

from gleaner.operators import assist, buffer, chunk, classify, history, vector
from gleaner.sources import archives, market


def test_file_names(spark):
    url = "https://website.rbi.org.in/web/rbi/-/notifications/master-direction-on-currency-distribution-amp-exchange-scheme-cdes-for-bank-branches-including-currency-chests-based-on-performance-in-rendering-customer-service-to-members-of-public-12055"
    rows = spark.createDataFrame([("mod_dummy", url), ("m", "no slash"), ("m", "c:\\d\\e.html")], "module string, url string")
    got = [r[0] for r in rows.select(archives.unique_filename(F.col("module"), F.col("url"), F.lit("1970-01-01"), "json")).collect()]
    assert got[0] == "mod_dummy_ormance-in-rendering-customer-service-to-members-of-public-12055_1400996662519724217_1970-01-01.json"
    assert got[1].startswith("m__") and got[2].startswith("m_e_")


def test_buffer_drops_only_the_batch_that_fails():
    written = []

    def flush(rows):
        if any(r["i"] == 7 for r in rows):
            raise OSError("no")
        written.extend(r["i"] for r in rows)
        return len(rows)

    now = [0.0]
    w = buffer.BatchWriter(flush, size=3, seconds=10, clock=lambda: now[0])
    for i in range(11):
        w.push({"i": i})
    assert (w.written, w.dropped, w.flushes, len(w.pending)) == (6, 3, 3, 2)
    now[0] = 11.0
    w.push({"i": 11})
    w.flush()
    assert not w.pending and written == [0, 1, 2, 3, 4, 5, 9, 10, 11]


def test_buffered_table(spark):
    rows = spark.range(1000).repartition(4)
    done = buffer.write_buffered(rows, lambda: lambda batch: len(batch), size=50).groupBy().sum("written", "dropped").first()
    assert tuple(done) == (1000, 0)


def test_zip_changes_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "2024" / "2024-01-02.zip")
    one = archives._Replacing(path)
    one.add("a", "1")
    assert not os.path.exists(path)
    one.close()
    lost = archives._Replacing(path)
    lost.add("b", "2")  # and never closed, as by a task that dies
    again = archives._Replacing(path)
    assert not again.add("a", "other") and again.add("b", "3")
    again.close()
    with zipfile.ZipFile(path) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a": b"1", "b": b"3"}


def test_first_csv_member(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("x.CSV", "TradDt,a\n1,2\n")
        z.writestr("y.csv", "later")
    rows = spark.createDataFrame([(1, out.getvalue()), (2, b"no zip"), (3, None)], "k int, z binary")
    assert {r[0]: r[1] for r in rows.select("k", archives.first_csv_member("z")).collect()} == {1: "TradDt,a\n1,2\n", 2: None, 3: None}
    assert market.first_good_day(spark.createDataFrame([], "day date, content string")).count() == 0


def test_versions(spark):
    docs = spark.createDataFrame([("t", 1, "a b"), ("t", 2, "ab"), ("t", 3, "c"), ("u", 1, None)], "title string, ts int, text string")
    both = history.previous_versions(docs, ["title"], ["ts"], ["text"])
    assert sorted(r["ts"] for r in history.changed(both).collect()) == [3]
    stored = spark.createDataFrame([("p", "old text"), ("p", "old text")], "filename string, text string")
    named = spark.createDataFrame([(1, {"previous_circular_file": "p"}), (2, {}), (3, None)], "k int, generated_content map<string,string>")
    assert {r["k"]: r["previous_text"] for r in history.previous_by_path(named, stored).collect()} == {1: "old text", 2: None, 3: None}


def test_calls_are_spaced(spark):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    call = assist.spaced(lambda: lambda p: p.upper(), 6.0, lambda: now[0], sleep)()
    assert [call("a"), call("b")] == ["A", "B"] and slept == [6.0]
    now[0] += 4
    call("c")
    assert slept == [6.0, 2.0]
    rows = spark.createDataFrame([("x" * 60,), (None,)], "p string").repartition(2)
    assert sorted(str(r["r"]) for r in assist.ask_spaced(rows, "p", lambda: lambda p: "ok", "r", 0.01).collect()) == ["None", "ok"]


def test_long_texts_in_parts():
    assert chunk.split_long("one two\n  \n\t\nthree four five\n\nlast words here now", 3, 0)[0] == "one two"
    assert all(len(p) > 1 and p == p.strip() for p in chunk.split_long("a\n \n" * 50 + "end of it all\n\n", 5, 2))


def test_flags_and_index(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (1,), (512,)], "f int").select(classify.with_flags(F.col("f"))).collect()] == [414, 415, 926]
    index = spark.createDataFrame([("a",)], "doc_id string")
    chunks = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "doc_id string, n int")
    assert sorted(r["n"] for r in vector.append_new(index, chunks).collect()) == [1, 2]
    blobs = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(vector.from_blob(vector.to_blob("v")).alias("v")).collect()
    assert [r["v"] for r in blobs] == [[1.5, -2.0], None]
