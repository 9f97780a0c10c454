"""Session settings the library relies on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Call sites are recorded per Column call by default; plans here are built from thousands of them.
PLAN_BUILDING = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def local_session(name: str, *, cores: int = 8) -> SparkSession:
    """A local session for tests and the bench, where one machine holds all files; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in PLAN_BUILDING.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored_path(spark: SparkSession) -> str:
    """A new path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Raises where the setting is absent: a machine-local folder would give each executor its own files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/prefixledger-{uuid.uuid4().hex}"


_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("stored_frames", default=None)


#: Shuffle files go when the query that wrote them has ended, and not when the driver happens to collect its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def stored_frames(spark: SparkSession):
    """Removes the tables that ``cut_lineage`` writes inside the block, but for those given to the function it yields.

    For work whose result is itself a stored table: everything on the way to it is of no use afterwards, shuffle files
    included, which go at the end of each query of the block. Kept tables belong to the surrounding block, if there is one.
    """
    outer, paths, kept = _SCOPE.get(), [], []
    token = _SCOPE.set(paths)
    cleaned = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(_stored_folders(df))
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        if cleaned is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, cleaned)
        for path in paths:
            if any(k.endswith(path.rsplit("/", 1)[-1]) for k in kept):
                if outer is not None:
                    outer.append(path)
            else:
                _delete(spark, path)


def _stored_folders(df: DataFrame) -> set[str]:
    return {name for f in df.inputFiles() if "/prefixledger-" in (name := f.rsplit("/", 1)[0])}


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    Used where one frame feeds several joins: the plan restarts from stored files, so
    a lost executor costs a re-read and not a recomputation, and the optimizer knows
    the real size when it picks a join.
    """
    path = stored_path(df.sparkSession)
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of a wide aggregation or join sorts.
ROWS_A_TASK = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (of about ``rows`` rows) dealt by ``keys``, ``ROWS_A_TASK`` a task, so a task's sort does not grow with the table.

    Few rows stay as they are; the number of partitions of the session would otherwise fix the number of tasks.
    """
    tasks = -(-rows // ROWS_A_TASK)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def remove_stored(df: DataFrame) -> None:
    """Delete the files of a frame made by ``cut_lineage`` once nothing reads them any more."""
    for name in _stored_folders(df):
        _delete(df.sparkSession, name)
