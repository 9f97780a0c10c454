"""Hash manifests against stored files."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Files up to this size are hashed whole inside Spark; longer ones are streamed.
WHOLE_BYTES = 64 << 20
CHUNK_BYTES = 8 << 20


def _relative(path: Column, root: str | None) -> Column:
    name = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    return name if root is None else F.substring(name, F.lit(len(root.rstrip("/")) + 2), F.length(name))


def _streamed(files: DataFrame, chunk: int) -> DataFrame:
    """``uri, bytes, sha256`` of ``uri, bytes``: one task a few files, each read in chunks through its own file system."""

    def run(batches):
        for batch in batches:
            sums = []
            for uri in batch.column("uri").to_pylist():
                system, place = pafs.FileSystem.from_uri(quote(uri, safe=":/"))
                digest = hashlib.sha256()
                with system.open_input_stream(place) as source:
                    while data := source.read(chunk):
                        digest.update(data)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("uri"), batch.column("bytes"), pa.array(sums, pa.string())], names=["uri", "bytes", "sha256"])

    return files.mapInArrow(run, "uri string, bytes bigint, sha256 string")


def file_hashes(spark: SparkSession, path: str, *, glob: str = "*", root: str | None = None, whole: int = WHOLE_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``path, bytes, sha256`` of the files under ``path``, of any size but zero (Spark's scans skip empty files); names are relative to ``root``.

    Files up to ``whole`` bytes are hashed as ``binaryFile`` contents (the size filter reaches the scan, so others
    are not opened there). Longer ones are listed without content, dealt to tasks by name and read in chunks of ``chunk``
    bytes, so memory does not depend on a file's size; this needs a file system that Arrow can open.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    small = df.filter(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = _streamed(df.filter(F.col("length") > whole).select(_uri(F.col("path")).alias("uri"), F.col("length").alias("bytes")).repartition("uri"), chunk)
    return small.unionByName(large.withColumnRenamed("uri", "path")).withColumn("path", _relative(F.col("path"), root))


def _uri(path: Column) -> Column:
    """``scheme:/a`` as ``scheme:///a``."""
    return F.regexp_replace(path, "^([a-z0-9]+):/(?!/)", "$1:///")


def manifest_lines(lines: DataFrame) -> DataFrame:
    """``path, sha256, problem`` from ``hash  name`` text lines (column ``value``)."""
    shape = r"^([0-9a-fA-F]{64})  (.+)$"
    name = F.regexp_extract("value", shape, 2)
    unsafe = name.startswith("/") | name.rlike(r"(^|/)\.\.(/|$)")
    return lines.filter(F.trim("value") != "").select(
        F.when(name != "", name).alias("path"), F.lower(F.regexp_extract("value", shape, 1)).alias("sha256"),
        F.when(name == "", "invalid line").when(unsafe, "unsafe path").alias("problem"),
    )


def verify_manifest(manifest: DataFrame, files: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """One row per disagreement: ``missing``, ``unlisted``, ``size mismatch``, ``hash mismatch``."""
    keys = [*on, "path"]
    listed = manifest.select(*keys, F.lower(F.trim("sha256")).alias("want"),
                             (F.col("bytes") if "bytes" in manifest.columns else F.lit(None).cast("bigint")).alias("want_bytes"), F.lit(True).alias("listed"))
    actual = files.select(*keys, F.col("sha256").alias("have"), F.col("bytes").alias("have_bytes"), F.lit(True).alias("stored"))
    both = listed.join(actual, keys, "full_outer")
    problem = (
        F.when(F.col("stored").isNull(), "missing").when(F.col("listed").isNull(), "unlisted")
        .when(F.col("want_bytes") != F.col("have_bytes"), "size mismatch").when(F.col("want") != F.col("have"), "hash mismatch")
    )
    return both.select(*keys, problem.alias("problem")).filter("problem is not null")


def snapshot_manifest(hashes: DataFrame, date: Column) -> DataFrame:
    """Snapshot files with the days since the previous one; the dates are one row per snapshot file."""
    dated = hashes.withColumn("snapshot_date", date)
    ordered = Window.orderBy("snapshot_date")
    return dated.withColumn("days_since_previous", F.datediff("snapshot_date", F.lag("snapshot_date").over(ordered)))


def daily_index(artifacts: DataFrame) -> DataFrame:
    """Distinct ``day, sha256, category, path`` of archived artifacts (``path, sha256, modified``).

    The day is the first calendar date in the file name, else the UTC modification day; the category is the first
    path part. A name's date has one separator throughout or none (``20260105``, also before a time of six digits);
    dates with separators come first, so a number before the date is no part of it.
    """
    base = F.substring_index("path", "/", -1)
    separated = F.regexp_extract_all(base, F.lit(r"(?<!\d)20\d{2}([-_])\d{2}\1\d{2}(?!\d)"), F.lit(0))
    compact = F.regexp_extract_all(base, F.lit(r"(?<!\d)20\d{6}(?=\d{6}(?!\d)|\D|$)"), F.lit(0))
    digits = F.transform(F.concat(separated, compact), lambda d: F.regexp_replace(d, "[-_]", ""))
    iso = F.transform(digits, lambda d: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))
    named = F.get(F.filter(iso, lambda d: d.try_cast("date").isNotNull()), F.lit(0))
    day = F.coalesce(named, F.date_format("modified", "yyyy-MM-dd"))
    return artifacts.select(day.alias("day"), "sha256", F.split_part("path", F.lit("/"), F.lit(1)).alias("category"), "path").distinct()


def daily_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("day").agg(F.count("*").alias("artifacts"))


def same_day_feed(attempts: DataFrame, hashes: DataFrame) -> DataFrame:
    """Attempts whose feed or candidate snapshot is not the recorded file of the attempt's day.

    ``attempts``: ``attempt_path, feed_path, feed_sha256, feed_date, candidate_snapshot_path, candidate_snapshot_sha256, day``.
    """
    long = attempts.select("attempt_path", "day", F.inline(F.array(
        F.struct(F.lit("feed").alias("kind"), F.col("feed_path").alias("path"), F.lower("feed_sha256").alias("want"), F.col("feed_date").alias("dated")),
        F.struct(F.lit("candidates").alias("kind"), F.col("candidate_snapshot_path").alias("path"),
                 F.lower("candidate_snapshot_sha256").alias("want"), F.col("day").alias("dated")),
    )))
    checked = long.join(hashes.select("path", F.col("sha256").alias("have")), "path", "left")
    problem = (
        F.when(~F.coalesce(F.col("want").rlike("^[0-9a-f]{64}$"), F.lit(False)), "recorded hash is missing or invalid")
        .when(F.col("have").isNull(), "file is missing").when(F.col("have") != F.col("want"), "hash differs")
        .when(F.coalesce(F.col("dated") != F.col("day"), F.lit(True)), "date differs")
    )
    return checked.select("attempt_path", "kind", problem.alias("problem")).filter("problem is not null")
