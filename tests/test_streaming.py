import json

from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.operators import churn, enumeration
from prefixledger.sources import catalogue, evidence
from prefixledger.streaming import arrivals


def run(df, mode, folder):
    name = f"t_{folder.name}_{mode}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / f"cp_{mode}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_log_stream_converges_to_the_batch_scan(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    line = lambda i: json.dumps({"ts": 1000.0 + i, "status": 200, "run_id": f"r{i}", "request_uuid": "u", "request": {"uri": "/"}})
    (logs / "a.jsonl").write_text("".join(line(i) + "\n" for i in (1, 2, 2, 3)))
    (logs / "b.jsonl").write_text("".join(line(i) + "\n" for i in (3, 4)))
    streamed = run(arrivals.stream_access_log(spark, str(logs)), "append", tmp_path)
    batch = evidence.scan_access_log(spark, str(logs))
    assert sorted(r.row_sha256 for r in streamed.collect()) == sorted(r.row_sha256 for r in batch.collect())


def test_result_streams_resume_and_match_the_batch(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    head = "query_utc,ecs_prefix,returned_scope,answer_ip\n"
    (folder / "1.csv").write_text(head + "t,8.8.8.0/24,20,9.9.9.9\nt,8.8.9.0/24,,\n")
    (folder / "2.csv").write_text(head + "t,8.9.8.0/24,20,9.9.9.9\nt,8.9.9.0/24,24,9.9.9.8\n")
    unique = run(arrivals.stream_unique_addresses(spark, str(folder)), "append", tmp_path)
    batch = enumeration.unique_addresses(catalogue.scan_results(spark, str(folder)))
    assert sorted(r.answer_ip for r in unique.collect()) == sorted(r.answer_ip for r in batch.collect())
    counts = run(arrivals.stream_result_counts(spark, str(folder)), "complete", tmp_path)
    assert {(r.scope, r.rows, r.answers) for r in counts.collect()} == {(20, 2, 2), (None, 1, 0), (24, 1, 1)}


def test_arriving_snapshots_match_the_batch_series(spark, tmp_path):
    inbox, table, series, cp = (tmp_path / n for n in ("in", "table", "series", "cp"))
    inbox.mkdir()
    schema = "snapshot_date date, cidr string, country string, region string, city string"
    days = {"2026-01-01": ["10.0.0.0/22"], "2026-01-05": ["10.0.0.0/24", "10.0.1.0/24"], "2026-01-03": ["10.0.0.0/23", "10.8.0.0/24"]}

    def arrive(*dates):
        for d in dates:
            rows = spark.createDataFrame([(c, "US", "", "") for c in days[d]], "cidr string, country string, region string, city string")
            rows.select(F.lit(d).cast("date").alias("snapshot_date"), "*").coalesce(1).write.mode("append").json(str(inbox))
        stream = A.with_prefix(spark.readStream.schema(schema).json(str(inbox)), "cidr")
        arrivals.compare_arrivals(stream, str(table), str(series), str(cp)).awaitTermination(240)

    arrive("2026-01-01", "2026-01-05")
    arrive("2026-01-03")  # a late file splits the interval
    whole = spark.createDataFrame([(d, c, "US", "", "") for d, cs in days.items() for c in cs], schema.replace("date date", "date string"))
    want = churn.churn_series(A.with_prefix(whole.withColumn("snapshot_date", F.col("snapshot_date").cast("date")), "cidr"))
    key = lambda df: sorted(tuple(str(r[c]) for c in want.columns) for r in df.collect())
    assert key(spark.read.parquet(str(series)).select(want.columns)) == key(want)


def test_late_log_files_are_kept(spark, tmp_path):
    logs, table, cp = (tmp_path / n for n in ("logs", "table", "cp"))
    logs.mkdir()
    line = lambda ts: json.dumps({"ts": ts, "status": 200, "run_id": f"r{ts}", "request_uuid": "u", "request": {"uri": "/"}}) + "\n"
    arrive = lambda: arrivals.store_access_log(spark, str(logs), str(table), str(cp)).awaitTermination(120)
    (logs / "new.jsonl").write_text(line(1_000_000.0) + line(1_000_001.0) + "{broken\n")
    arrive()
    (logs / "old.jsonl").write_text(line(1_000.0) + line(1_000_001.0) + line(1_000.0))  # days late, and copies
    arrive()
    stored = spark.read.parquet(str(table))
    batch = evidence.scan_access_log(spark, str(logs))
    assert sorted(r.row_sha256 for r in stored.collect()) == sorted(r.row_sha256 for r in batch.collect()) and stored.count() == 4


def test_a_date_in_two_batches_is_merged(spark, tmp_path):
    inbox, table, series, cp = (tmp_path / n for n in ("in", "table", "series", "cp"))
    schema = "snapshot_date date, cidr string, country string, region string, city string"
    for part in ([("2026-01-01", "10.0.0.0/24"), ("2026-01-02", "10.0.0.0/24")], [("2026-01-02", "10.0.1.0/24")]):
        rows = spark.createDataFrame([(d, c, "US", "", "") for d, c in part], schema.replace("date date", "date string"))
        rows.coalesce(1).write.mode("append").json(str(inbox))
        stream = A.with_prefix(spark.readStream.schema(schema).json(str(inbox)), "cidr")
        arrivals.compare_arrivals(stream, str(table), str(series), str(cp)).awaitTermination(240)
    assert spark.read.parquet(str(table)).count() == 3
    row = spark.read.parquet(str(series)).filter("family = 'v4'").first()
    assert (row.added_pfx, int(row.added_addrs), row.removed_pfx) == (1, 256, 0)


def test_equal_rows_of_a_date_stay(spark, tmp_path):
    """A row that arrives twice, in one batch or in two, is stored twice: the duplicate report counts it."""
    inbox, table, series, cp = (tmp_path / n for n in ("in", "table", "series", "cp"))
    schema = "snapshot_date date, cidr string, country string, region string, city string"
    for cidrs in (["10.0.0.0/24", "10.0.0.0/24"], ["10.0.0.0/24", "10.0.2.0/24"]):
        rows = spark.createDataFrame([("2026-01-01", c, "US", "", "") for c in cidrs], schema.replace("date date", "date string"))
        rows.coalesce(1).write.mode("append").json(str(inbox))
        stream = A.with_prefix(spark.readStream.schema(schema).json(str(inbox)), "cidr")
        arrivals.compare_arrivals(stream, str(table), str(series), str(cp)).awaitTermination(240)
    assert sorted(r.cidr for r in spark.read.parquet(str(table)).collect()) == ["10.0.0.0/24"] * 3 + ["10.0.2.0/24"]


def test_a_stored_line_names_its_first_file(spark, tmp_path):
    logs, table, cp = (tmp_path / n for n in ("logs", "table", "cp"))
    logs.mkdir()
    line = json.dumps({"ts": 1_000.0, "status": 200, "run_id": "r", "request_uuid": "u", "request": {"uri": "/"}}) + "\n"
    for name in ("c", "a", "b"):
        (logs / f"{name}.jsonl").write_text(line)
    arrivals.store_access_log(spark, str(logs), str(table), str(cp)).awaitTermination(120)
    assert [r.artifact.rsplit("/", 1)[-1] for r in spark.read.parquet(str(table)).collect()] == ["a.jsonl"]
