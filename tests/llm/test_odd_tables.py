"""Nulls, empty and long texts, ties, repeated rows, clashing columns, and empty tables, for every query and the pipeline."""

import pytest

import corpus_pipeline
from gleaner.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, items string, fp long, key string"
PAGES = "page_id long, url string, html string, text string, digest string"
PROSE = "the quick brown fox jumps over the lazy dog and then runs away from the very tired old hunter again "


def write(spark, folder, documents, pages, benchmark, labels):
    spark.createDataFrame(documents, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, PAGES).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string, n_hit long").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    texts = [None, "", "  \n\t ", "a", PROSE, PROSE, PROSE * 4000, "x" * 300_000, "<|endoftext|> </s> ▁▁ \u0000 ünï", "…" * 5, "Same.", "Same."]
    rows = [(i, t, None, "s", None, 7, 0.5, "z", 1, "k") for i, t in enumerate(texts)]
    rows += [(None, PROSE, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), rows[4], rows[4]]
    pages = [(0, "http://a.b/c d\r\nX: y", "<p>one<p>two", "t", "d"), (1, None, None, None, None), (2, "u", "<p>one<p>two", None, None), (None, "n", "<article><p>Text here.", None, None), (2, "u", "<p>one<p>two", None, None), (3, "v", "<div>" * 5000 + "deep", None, None), (4, "w", "", None, None)]
    benchmark = [(1, PROSE, 0), (1, PROSE, 0), (2, None, 0), (None, PROSE, 0), (3, "", 0), (4, "lazy dog", 0)]
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0), "t") for i in range(12)] + [(None, 1, 1, None), (3, None, None, None), (4, 0, 0, None), (99, 1, 0, None)]
    return write(spark, tmp_path_factory.mktemp("odd"), rows, pages, benchmark, labels)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), [], [], [], [])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    pages = name.startswith(("op6", "op8"))
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == (7 if pages else 16)
    if not pages:
        assert sum(r["doc_id"] is None for r in rows) == 2
        assert len({str(r) for r in rows if r["doc_id"] == 4}) == (3 if name.startswith("op4") else 1)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = queries.table(spark, odd, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.run(spark, odd).columns[0] == "doc_id"


def test_undefined_cases_are_as_stated(spark, odd):
    by_id = lambda q: {r["doc_id"]: r for r in q(spark, odd).collect()}
    media = by_id(queries.op1_mpeg_audio)
    assert media[0]["payload_bytes"] == 64 and media[0]["n_bytes"] == 0 and media[0]["media_sha256"] == media[1]["media_sha256"]
    assert media[7]["n_bytes"] == 300_000
    hits = by_id(queries.op2_decontamination)
    assert hits[0]["n_words"] == 0 and not hits[0]["contaminated"] and hits[4]["n_items"] == 2 and hits[6]["contaminated"]
    assert by_id(queries.op3_token_counts)[1]["n_tokens"] == 0
    assert by_id(queries.op7_sentencepiece)[0]["n_tokens"] == 2
    prints = by_id(queries.op5_simhash)
    assert prints[0]["fingerprint"] == "0" * 16 and prints[0]["component_id"] == prints[2]["component_id"] == 0 and prints[5]["component_id"] == 4
    pages = queries.op6_warc(spark, odd).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in pages if r["page_id"] in (0, 2)) == [("response", None), ("response", None), ("revisit", 2)]
    assert {(r["record_type"], r["refers_to"]) for r in pages if r["page_id"] in (1, 4)} == {("response", None), ("revisit", 4)}
