"""Steps of the pairing at size: what is checked twice, stored or written for nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import spark_queries as Q
from prefixledger.functions import values as V
from prefixledger.operators import pairing, time_tiles
from prefixledger.plans import derived as D


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_utc_text_is_the_pattern_in_digits(spark):
    zone = dt.timezone.utc
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999, zone), dt.datetime(1970, 1, 1, tzinfo=zone), dt.datetime(2024, 2, 29, 7, 8, 9, 10, zone),
             dt.datetime(1600, 3, 1, 0, 0, 0, 1, zone), dt.datetime(2262, 12, 31, 23, 0, 59, 100000, zone), None]
    rows = spark.createDataFrame([(t,) for t in times], "t timestamp").select(V.utc_text(F.col("t")).alias("x"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("y"))
    assert "date_format" not in _plan(rows.select("x")) and all(r.x == r.y for r in rows.collect())


def test_present_needs_no_projection_of_its_own(spark):
    rows = spark.createDataFrame([("",), (None,), ("a",)], "c string").select(V.present(F.concat("c", F.lit(""))).alias("p"))
    assert [r.p for r in rows.collect()] == [None, None, "a"]
    assert "_common_expr" not in _plan(rows)


@pytest.mark.parametrize("first,last", [(0, 0), (7, 7), (-3, -3), (6, 7), (5, 9), (4, 3), (None, 2), (2, None)])
def test_cover_of_one_unit_needs_no_lambda(spark, first, last):
    rows = spark.createDataFrame([(first, last)], "a bigint, b bigint").select(time_tiles.cover(F.col("a"), F.col("b")).alias("c"))
    got = rows.head().c
    if first is None or last is None:
        assert got is None
        return
    assert sorted(u for level, tile in got for u in range(tile << level, (tile + 1) << level)) == list(range(first, last + 1))
    if first == last:
        assert [tuple(t) for t in got] == [(0, first)]


def test_rows_of_the_log_are_found_without_the_checks(spark, sf_dir, monkeypatch):
    seen = []
    tagged = pairing.tagged_rows
    monkeypatch.setattr(pairing, "tagged_rows", lambda attempts, *rest: seen.append(attempts.columns) or tagged(attempts, *rest))
    Q._pairs(spark, sf_dir, "run_id")
    assert "metadata_bad" not in seen[0] and "metadata_problems" not in seen[0]


def test_unlisted_problems_are_those_listed(spark, sf_dir):
    attempts = D.attempts(spark, sf_dir).withColumn("campaign", F.when(F.col("attempt_path").endswith("7"), "").otherwise(F.col("campaign")))
    attempts = attempts.withColumn("url", F.when(F.col("attempt_path").endswith("5"), F.lit(None).cast("string")).otherwise(F.col("url")))
    events = D.attempt_events(spark, sf_dir)
    listed = pairing.with_metadata_checks(attempts, events).select("attempt_path", (F.size("metadata_problems") > 0).alias("a"))
    bare = pairing.with_metadata_checks(attempts, events, listed=False).select("attempt_path", F.col("metadata_bad").alias("b"))
    counts = {(r.a, r.b): r["count"] for r in listed.join(bare, "attempt_path").groupBy("a", "b").count().collect()}
    assert set(counts) == {(True, True), (False, False)}


def test_stored_records_hold_facts_and_no_lists(spark, sf_dir, monkeypatch):
    stored = []
    cut = pairing.cut_lineage
    monkeypatch.setattr(pairing, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    Q._pairs(spark, sf_dir, "run_id", "disposition")
    assert "evidence_bad" in stored[0]
    assert not {"metadata_problems", "response_problems", "approved_pin_group_addresses", "first_udp"} & set(stored[0])
    assert set(stored[1]) == set(pairing.INGRESS_READ)


def test_trials_store_what_is_read_and_parse_the_catalogue_once(spark, sf_dir, monkeypatch):
    import prefixledger.session as session

    stored = []
    cut = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: stored.append(df.schema) or cut(df))
    trials = Q._trials(spark, sf_dir)
    assert [f.name for f in stored[0]["row"].dataType] == ["ts", "remote_ip", "remote_port", "proto"]
    assert any({"plen", "hi", "lo", "city"} <= set(schema.names) for schema in stored)
    assert "_ordinal" in trials.columns and trials.select("run_id").distinct().count() == D.table(spark, sf_dir, "events").count()
