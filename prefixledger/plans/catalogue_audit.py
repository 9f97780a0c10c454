"""The complete catalogue audit: one strict scan, seven tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixledger.operators import allocation, churn, manifests, quality, routing
from prefixledger.session import cut_lineage
from prefixledger.sources import catalogue as scans


def audit(spark: SparkSession, folder: str, routes: DataFrame, as_names: DataFrame) -> dict[str, DataFrame]:
    """Tables of the audit by name; raises on any violation of the strict catalogue rules.

    The parsed catalogue is stored once and read by every table; prefix attribution
    runs on the distinct prefixes of all dates.
    """
    rows = cut_lineage(scans.scan_snapshots(spark, folder, strict=True))
    quality.require_clean(quality.catalogue_violations(rows))
    attributed = routing.with_operator(routing.strict_attribution(routing.attribute(rows, routes)), as_names)
    attributed = cut_lineage(attributed)
    paired = cut_lineage(churn.paired_prefixes(rows))
    pieces = cut_lineage(churn.overlay(paired))
    hashes = manifests.file_hashes(spark, folder, glob="egress-*.csv", root=folder)
    return {
        "snapshot_manifest": manifests.snapshot_manifest(hashes, scans.snapshot_date(F.col("path"))),
        "snapshot_series": allocation.snapshot_series(rows),
        "country_series": allocation.country_series(rows),
        "operator_series": routing.operator_series(attributed),
        "bgp_series": routing.route_series(attributed),
        "catalogue_changes": churn.catalogue_changes(paired),
        "churn_transitions": churn.transitions(pieces),
        "churn_series": churn.churn_counters(rows, paired, pieces),
    }
