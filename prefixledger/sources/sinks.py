"""Writers: reports as CSV, pair outputs by disposition, frozen tables, hash manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from prefixledger.functions import address as A
from prefixledger.operators import manifests, summaries


def key_sorted(value: Column, kind: DataType) -> Column:
    """The same nested value with the fields of structs and the entries of maps in order of their names, at every depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = F.struct(*[key_sorted(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: key_sorted(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), key_sorted(value[k], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    return value


def flat(df: DataFrame, fields: list[str]) -> DataFrame:
    """The given fields in order; nested cells become compact JSON text with sorted keys, absent values empty text."""
    kinds = {f.name: f.dataType for f in df.schema}
    nested = lambda c: isinstance(kinds[c], (StructType, ArrayType, MapType))
    return df.select(*[
        F.coalesce(F.to_json(key_sorted(F.col(c), kinds[c])) if nested(c) else F.col(c).cast("string"), F.lit("")).alias(c) for c in fields
    ])


# Orders of the tables that have one; equal keys cannot occur in the first, whose prefixes are unique in a pair of dates.
CHANGE_ORDER = ("date_from", "family", "hi", "lo", "plen")
TRANSITION_ORDER = ("date_from", "family", "-addresses", "from_country", "from_region", "from_city", "to_country", "to_region", "to_city")


def in_order(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Range partitions sorted inside, so the files of a sink, read by name, are in order; ``-`` before a name reverses it.

    Partitions are cut from a sample of the keys and no task holds more than one range, so this is no single sort.
    """
    return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])


def write_csv(df: DataFrame, path: str, fields: list[str], *, frozen: bool = False, order: tuple[str, ...] = ()) -> None:
    """CSV with header; a frozen output refuses to replace an existing one; ``order`` sorts rows across the files."""
    rows = in_order(df, order) if order else df
    flat(rows, fields).write.mode("errorifexists" if frozen else "overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_pairs(records: DataFrame, folder: str, fields: list[str]) -> None:
    """Non-excluded pairs, exclusions and all records with their protocol class.

    ``records`` is a stored frame (see ``pairing.pair_attempts``): three filtered reads, no recomputation.
    """
    excluded = F.col("disposition") == "excluded"
    write_csv(records.filter(~excluded), f"{folder}/pairs", fields)
    write_csv(records.filter(excluded), f"{folder}/exclusions", fields)
    write_csv(records, f"{folder}/protocols", [
        "run_id", "campaign", "run_mode", "session", "block_id", "intended_ingress_group", "location_setting", "private_relay_state",
        "ingress_transport", "server_http_protocol", "server_transport", "server_delivery_count", "quic_block_state",
        "protocol_classification", "disposition", "exclusion_reason",
    ])
    write_csv(summaries.validation_report(records), f"{folder}/validation", ["run_id", "disposition", "protocol_classification", "reason"])


def write_table(df: DataFrame, path: str, *, partition_by: list[str] = (), frozen: bool = False) -> None:
    """Parquet table, partitioned by the given columns; an existing frozen table is an error."""
    writer = df.write.mode("errorifexists" if frozen else "overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_addresses(addresses: DataFrame, path: str) -> None:
    """Unique addresses (the first column) as text in numeric order, IPv4 first, across the files by name.

    Text that is no address stops the job; NULLs are no addresses and are left out.
    """
    named = addresses.select(F.trim(F.col(addresses.columns[0])).alias("address")).filter("address is not null").distinct()
    parsed = A.with_address(named, "address")
    wrong = F.raise_error(F.concat(F.lit("not an address: "), "address")).cast("string")
    checked = parsed.withColumn("address", F.when(F.col("family").isNull(), wrong).otherwise(F.col("address")))
    in_order(checked, ("family", "hi", "lo", "address")).select("address").write.mode("overwrite").text(path)


def write_hashes(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """Hash manifest of everything already written under ``folder``."""
    hashes = manifests.file_hashes(spark, folder, root=folder)
    hashes.write.mode("errorifexists").parquet(manifest)
    return hashes
