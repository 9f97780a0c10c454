"""Small helpers the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixledger.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 50_000


_HELD: dict = {}


def worker_object(name, build):
    """A heavy object of this worker process, built once and kept until another one is asked for or ``release`` is called.

    Workers are reused by later stages: one at a time stays, so the memory of stages does not add up.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = build()
    return _HELD[name]


def release() -> None:
    """Let go of what an earlier stage left in this worker process."""
    _HELD.clear()
    give_back()


def tidied(run):
    """``run`` of a ``mapInArrow`` in a worker that holds nothing of earlier stages, and afterwards nothing of this one."""

    def whole(batches):
        release()
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return freed memory of this process to the system: Arrow's pool and the C library keep it otherwise, and workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has this call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def packed(df: DataFrame, **columns: Column | str) -> DataFrame:
    """``df`` as one struct column ``row`` beside the named columns, so extra columns cannot clash with ours."""
    return df.select(F.struct("*").alias("row"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("row.*", *extra)


def few_rows(groups: DataFrame) -> bool:
    """Whether a table is small enough to be broadcast."""
    return groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def with_group_values(rows: DataFrame, groups: DataFrame, keys: list[str], *, salts: int = 32, few: bool | None = None) -> DataFrame:
    """Left join of ``rows`` to a stored table with one row for each (null-safe) key.

    The table is broadcast only while it is counted to be small (``few`` hands on a count already made).
    Beyond that both sides are salted, so a key that holds a third of all rows is spread over ``salts`` tasks.
    """
    held = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    if few_rows(groups) if few is None else few:
        out = rows.join(F.broadcast(held), on=same, how="left")
    else:
        held = held.withColumn("_g_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if not c == "row"]), F.lit(salts)).cast("int"))
        out = salted.join(held, on=[*same, F.col("_salt") == F.col("_g_salt")], how="left").drop("_salt", "_g_salt")
    return out.drop(*[f"_g_{k}" for k in keys])


__all__ = ["BROADCAST_ROWS", "WORD", "cut_lineage", "few_rows", "give_back", "packed", "release", "table", "tidied", "unpacked", "with_group_values", "word_count", "worker_object", "words"]
