"""Findings of round 3: archive days beside numbers, origins beyond one covering route, pairing and churn at size."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle_queries
import spark_queries
from prefixledger import session
from prefixledger.functions import address as A
from prefixledger.operators import churn, manifests, pairing, routing, time_tiles
from prefixledger.plans import derived as D
from prefixledger.session import cut_lineage


@pytest.mark.parametrize("name, day", [
    ("2012-2026-01-05.log", "2026-01-05"), ("200112-2026-01-05.log", "2026-01-05"), ("20010203-2026-01-05.log", "2026-01-05"),
    ("access-20260105T101112.log", "2026-01-05"), ("en0_20260105101112.pcapng", "2026-01-05"), ("a-2026_01_05.log", "2026-01-05"),
    ("a-2026-13-05.log", "2026-02-01"), ("a.log", "2026-02-01"),
])
def test_the_day_is_a_date_of_the_file_name(spark, name, day):
    file = spark.createDataFrame([(f"x/{name}", "h", dt.datetime(2026, 2, 1, 12))], "path string, sha256 string, modified timestamp")
    assert [r.day for r in manifests.daily_index(file).collect()] == [day]


def test_origins_beyond_the_covering_route_match_their_sql(spark, tmp_path):
    suppliers = spark.range(0, 700).union(spark.range(62970, 62990)).union(spark.range(65536, 65600)).select(F.col("id").alias("s_suppkey"))
    suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
    got = sorted((tuple(r) for r in spark_queries.reconstructed_origins(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = sorted(con.execute(oracle_queries.ORACLES["reconstructed_origins"]).fetchall(), key=repr)
    assert got == want and len(got) == len({r[0] for r in got})


def test_repeated_feed_rows_keep_the_least_ordinal(spark):
    rows = [("10.0.0.0/8", 2, "b"), ("10.0.0.0/8", 1, "a"), ("10.1.0.0/16", 5, None), ("10.1.0.0/16", 7, "x"), ("10.2.0.0/16", None, "n"), ("10.2.0.0/16", 9, "y")]
    feed = A.with_prefix(spark.createDataFrame(rows, "p string, _ordinal int, city string"), "p")
    probes = A.with_address(spark.createDataFrame([(a,) for a in ("10.9.0.1", "10.1.0.1", "10.2.0.1", "11.0.0.1")], "a string"), "a")
    got = routing.match_first(probes, feed, ["city"]).select(A.v4_text(A.v4_from_half(F.col("hi"))).alias("a"), "city").collect()
    assert {(r.a, r.city) for r in got} == {("10.9.0.1", "a"), ("10.1.0.1", None), ("10.2.0.1", "y")}


def test_unique_match_compares_every_field(spark):
    rows = [("10.0.0.0/8", 1, None), ("10.0.0.0/8", 1, ""), ("11.0.0.0/8", 1, "x"), ("11.0.0.0/8", 2, "x"), ("12.0.0.0/8", None, "x"), ("12.0.0.0/8", 3, "x"), ("13.0.0.0/8", None, "x")]
    table = A.with_prefix(spark.createDataFrame(rows, "p string, asn bigint, city string"), "p")
    probes = A.with_address(spark.createDataFrame([(f"{n}.0.0.1",) for n in (10, 11, 12, 13)], "a string"), "a")
    got = routing.match_unique(probes, table, ["asn", "city"]).select(A.v4_text(A.v4_from_half(F.col("hi"))).alias("a"), "asn", "city").collect()
    assert {tuple(r) for r in got} == {("10.0.0.1", "1", ""), ("13.0.0.1", "", "x")}


def test_pairing_stores_only_what_is_read(spark, sf_dir, monkeypatch):
    stored = []
    monkeypatch.setattr(pairing, "cut_lineage", lambda df: stored.append(df.columns) or cut_lineage(df))
    got = spark_queries.QUERIES["eligibility_summary"](spark, sf_dir)
    assert got.count() and stored
    assert not {c for columns in stored for c in columns} & {"effective_dns", "response", "macos_version", "url", "first_packet"}


def test_no_row_is_dealt_by_its_asn_or_date(spark, monkeypatch):
    rows = spark.range(0, 4000).select(F.concat(F.lit("p"), "id").alias("attempt_path"), F.when(F.col("id") % 50 == 0, None).otherwise(1).alias("asn"))
    names = spark.createDataFrame([(1, "op"), (2, "no")], "asn int, operator string")
    want = {(None, 80), ("op", 3920)}
    count = lambda df: {tuple(r) for r in df.groupBy("operator").count().collect()}
    assert count(pairing._join_spread(rows, names, "asn")) == want
    monkeypatch.setattr(pairing, "FEW_ROWS", 1)
    assert count(pairing._join_spread(rows, names, "asn")) == want


def test_covers_of_short_windows_take_few_steps(spark):
    plan = spark.range(1).select(time_tiles.cover(F.col("id"), F.col("id") + 2).alias("c"))
    assert sorted((t.tile << t.level, (t.tile + 1) << t.level) for t in plan.first().c) == [(0, 2), (2, 3)]


def test_sorts_of_paired_prefixes_follow_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 50)
    monkeypatch.setattr(D, "ROWS_A_TASK", 20)
    frame = cut_lineage(D.catalogue(spark, sf_dir))
    paired = churn.paired_prefixes(frame)
    assert paired.rdd.getNumPartitions() >= frame.count() * 2 // 50
    monkeypatch.undo()
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(paired) == key(churn.paired_prefixes(frame))
