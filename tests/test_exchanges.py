"""Memory of a task at size: broadcasts and exchanges of the catalogue and evidence queries follow the rows."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from prefixledger.functions import address as A
from prefixledger.operators import routing
from prefixledger.plans import derived as D


def test_a_feed_of_many_days_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(routing, "BROADCAST_ROUTES", 50)
    rows = A.with_prefix(spark.createDataFrame([("10.0.0.0/8", "a", 0), ("10.1.0.0/16", "b", 0)], "p string, city string, _ordinal int"), "p")
    feed = rows.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(40))))
    probes = A.with_address(spark.createDataFrame([("10.1.0.1", 3), ("10.9.0.1", 40), ("10.9.0.1", 41)], "a string, day int"), "a")
    found = routing.match_first(probes, feed, ["city"], ("day",))
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin" in line or "SortMergeJoin" in line]
    assert any("SortMergeJoin" in line and "c_hi" in line for line in joins)
    assert sorted((r.day, r.city) for r in found.collect()) == [(3, "b"), (40, "a")]


def test_exchanges_follow_the_rows(spark, sf_dir, monkeypatch):
    rules, corpus = (entry_points._in_utc(lambda spark, sf_dir: None, kind) for kind in (True, False))
    session_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = {name: spark.conf.get(name, None) for name in (*entry_points.RULES, entry_points.DEALT)}
    rules(spark, sf_dir)
    assert int(spark.conf.get(entry_points.DEALT)) == session_tasks
    monkeypatch.setattr(D, "EXCHANGE_ROWS", 10)
    rules(spark, sf_dir)
    assert int(spark.conf.get(entry_points.DEALT)) >= spark.read.parquet(f"{sf_dir}/events.parquet").count() // 10 > session_tasks
    assert all(spark.conf.get(name) == value for name, value in entry_points.RULES.items())
    corpus(spark, sf_dir)
    assert before == {name: spark.conf.get(name, None) for name in before} or spark.conf.get(entry_points.DEALT, None) is None


def test_evidence_of_an_attempt_stays_together(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(D, "ATTEMPTS_A_TASK", 100)
    met = D.attempts(spark, sf_dir).select("attempt_path", "run_id").join(D.responses(spark, sf_dir).select("attempt_path", "server_utc").hint("merge"), "attempt_path")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert met.count() == D.table(spark, sf_dir, "events").count()
