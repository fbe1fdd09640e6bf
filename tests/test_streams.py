"""Streams run over what is there: the result never passes through the driver, and tables may be folders."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from gleaner.plans import queries as engine
from gleaner.streaming import events as streams


@pytest.fixture
def little_for_driver(spark):
    """Tasks may send the driver half a MB in all."""
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "500k")
    yield
    conf.set("spark.driver.maxResultSize", "1g")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """30,000 events in one file."""
    folder = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(30_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 10_000).alias("user_id"), F.concat(F.lit("type "), F.col("id") % 3).alias("event_type"), F.lit(1.5).alias("value")
    )
    rows.coalesce(1).write.parquet(f"{folder}/parts")
    os.rename(glob.glob(f"{folder}/parts/part-*")[0], f"{folder}/events.parquet")
    return folder


def test_keyed_dedupe_sends_no_rows_to_the_driver(spark, many, little_for_driver):
    got = engine.r04_keyed_dedupe(spark, many)
    assert tuple(got.agg(F.count("*"), F.sum("n")).first()) == (30_000, 30_000)


def test_first_wins_sends_no_rows_to_the_driver(spark, many, little_for_driver):
    got = engine.r03_stream_first_wins(spark, many)
    assert tuple(got.agg(F.count("*"), F.sum("n")).first()) == (10_000, 30_000)


def test_windows_send_no_rows_to_the_driver(spark, many, little_for_driver):
    got = streams.run_available(streams.tumbling(streams.event_stream(spark, many), "1 second"), f"w_{uuid.uuid4().hex}")
    assert tuple(got.agg(F.count("*"), F.sum("n"), F.sum("total")).first()) == (30_000, 30_000, 45_000.0)


def test_event_table_of_several_files(spark, many, tmp_path):
    spark.read.parquet(f"{many}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("r03_stream_first_wins", "r04_keyed_dedupe", "r05_stream_windows"):
        assert engine.QUERIES[name](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 30_000


def test_event_table_without_rows(spark, many, tmp_path):
    spark.read.parquet(f"{many}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("r03_stream_first_wins", "r04_keyed_dedupe", "r05_stream_windows"):
        assert engine.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_settings_of_the_session_stay(spark, many):
    before = {k: spark.conf.get(k, None) for k in streams.STATE}
    engine.r05_stream_windows(spark, many)
    assert {k: spark.conf.get(k, None) for k in streams.STATE} == before
