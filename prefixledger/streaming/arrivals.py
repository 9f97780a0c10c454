"""Append-and-resume behaviours as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefixledger.functions import address as A
from prefixledger.operators import churn
from prefixledger.session import cut_lineage
from prefixledger.sources.evidence import first_copies, log_lines


def stream_access_log(spark: SparkSession, path: str, *, lateness: str = "2 hours") -> DataFrame:
    """Access-log rows as they arrive, identical lines once within the watermark.

    State is one hash per line for ``lateness``; lines that arrive later than that are
    dropped. Where late files matter, use ``store_access_log``.
    """
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").text(path)
    named = lines.select("value", F.col("_metadata.file_path").alias("artifact"))
    rows = log_lines(named.filter(~F.col("artifact").rlike(r"\.packets\.jsonl(\.gz)?$")))
    timed = rows.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1000000).cast("bigint")))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["row_sha256"])


def store_access_log(spark: SparkSession, path: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append each new access-log line to ``table`` once, however late it arrives.

    A batch is reduced to the first copy of a line by file, as the batch scan keeps it, and compared with the stored lines of the same days, so
    state is the table and not a watermark, and a replayed batch adds nothing. Lines without a readable time
    share one day (null).
    """
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").text(path)
    named = lines.select("value", F.col("_metadata.file_path").alias("artifact"))
    rows = log_lines(named.filter(~F.col("artifact").rlike(r"\.packets\.jsonl(\.gz)?$")))
    dated = rows.withColumn("day", F.to_date(F.timestamp_micros((F.col("ts") * 1000000).cast("bigint"))))

    def step(batch: DataFrame, _: int) -> None:
        fresh = first_copies(batch).select(*batch.columns)
        if _exists(batch.sparkSession, table):
            stored = batch.sparkSession.read.schema(batch.schema).parquet(table).select(F.col("day").alias("d"), F.col("row_sha256").alias("h"))
            fresh = fresh.join(stored, F.col("day").eqNullSafe(F.col("d")) & (F.col("row_sha256") == F.col("h")), "left_anti")
        cut_lineage(fresh).write.mode("append").partitionBy("day").parquet(table)

    return dated.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_unique_addresses(spark: SparkSession, path: str) -> DataFrame:
    """First occurrence of every IPv4 answer in an arriving results folder (state: one entry per address)."""
    schema = "query_utc string, ecs_prefix string, returned_scope string, answer_ip string"
    rows = spark.readStream.schema(schema).option("header", "true").csv(path)
    return rows.select(A.canonical_v4(F.col("answer_ip")).alias("answer_ip")).filter("answer_ip is not null").dropDuplicates(["answer_ip"])


def stream_result_counts(spark: SparkSession, path: str) -> DataFrame:
    """Running counts per returned scope; write in complete mode, resume from the checkpoint."""
    schema = "query_utc string, ecs_prefix string, returned_scope string, answer_ip string"
    rows = spark.readStream.schema(schema).option("header", "true").csv(path)
    return rows.groupBy(F.col("returned_scope").try_cast("int").alias("scope")).agg(
        F.count("*").alias("rows"), F.count(A.canonical_v4(F.col("answer_ip"))).alias("answers")
    )


def compare_arrivals(arrivals: DataFrame, table: str, series: str, checkpoint: str) -> StreamingQuery:
    """Store each arriving snapshot and append its churn against the previous date.

    ``arrivals``: stream of parsed catalogue rows with ``snapshot_date``. The table is partitioned by date and by the
    batch (column ``batch_id``) that brought the rows, the series by date. A batch writes only partitions of its own, so a
    replayed one changes nothing, and no row of a date is lost: equal rows, which the duplicate reports count, stay
    as often as they arrive. Table, series and checkpoint belong together: a new checkpoint needs new tables.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dates = [r.snapshot_date for r in batch.select("snapshot_date").distinct().collect()]  # one per arriving file
        if not dates:
            return
        own = batch.withColumn("batch_id", F.lit(number).cast("bigint"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date", "batch_id").parquet(table)
        stored = spark.read.schema(batch.schema).parquet(table)
        # The neighbour on either side of every new date is compared again: a late file splits an interval.
        known = sorted(r.snapshot_date for r in stored.select("snapshot_date").distinct().collect())
        near = {known[j] for d in dates for i in [known.index(d)] for j in (i - 1, i, i + 1) if 0 <= j < len(known)}
        fresh = churn.churn_series(stored.filter(F.col("snapshot_date").isin(*near)))
        touched = F.col("date_from").isin(*dates) | F.col("date_to").isin(*dates)
        fresh.filter(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_to").parquet(series)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
