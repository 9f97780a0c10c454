
from prefixledger.functions.address import with_prefix
from prefixledger.operators import enumeration, summaries
from prefixledger.plans.catalogue_audit import audit
from prefixledger.sources import sinks


def test_catalogue_audit_tables(spark, tmp_path):
    (tmp_path / "egress-2026-01-01.csv").write_text("10.0.0.0/24,US,CA,LA,\n10.0.1.0/24,,,,\n2001:db8::/63,US,CA,LA,\n")
    (tmp_path / "egress-2026-01-03.csv").write_text("10.0.0.0/25,US,CA,LA,\n10.0.0.128/25,GB,ENG,London,\n2001:db8::/64,US,CA,LA,\n2001:db8:0:1::/64,US,CA,LA,\n")
    routes = with_prefix(spark.createDataFrame([("10.0.0.0/16", 1), ("2001:db8::/32", 2)], "prefix string, asn bigint"), "prefix")
    names = spark.createDataFrame([(1, "X - Fastly, Inc., US")], "asn bigint, as_name string")
    tables = {k: v.collect() for k, v in audit(spark, str(tmp_path), routes, names).items()}
    assert [r.days_since_previous for r in sorted(tables["snapshot_manifest"], key=lambda r: r.path)] == [None, 2]
    series = {str(r.snapshot_date): (r.rows, r.ipv4_addresses, int(r.ipv6_64_blocks), r.countries, r.locations, r.collapsed_ipv4_blocks, r.collapsed_ipv6_blocks) for r in tables["snapshot_series"]}
    assert series == {"2026-01-01": (3, 512, 2, 2, 2, 1, 1), "2026-01-03": (4, 256, 2, 2, 2, 1, 1)}
    assert {(str(r.snapshot_date), r.operator, r.total_prefixes, r.share_percent) for r in tables["operator_series"]} == {
        ("2026-01-01", "Fastly", 2, "66.666667"), ("2026-01-01", "(unknown org)", 1, "33.333333"),
        ("2026-01-03", "Fastly", 2, "50.000000"), ("2026-01-03", "(unknown org)", 2, "50.000000")}
    churned = {r.family: (r.removed_pfx, int(r.removed_addrs), r.reassign_count, int(r.reassigned_addrs), r.fake_churn_pfx) for r in tables["churn_series"]}
    assert churned == {"v4": (1, 256, 1, 128, 3), "v6": (0, 0, 0, 0, 3)}
    moved = tables["churn_transitions"]
    assert [(r.from_city, r.to_city, r.contiguous_runs, int(r.addresses)) for r in moved] == [("LA", "London", 1, 128)]
    assert len(tables["catalogue_changes"]) == 7 and {r.country for r in tables["country_series"]} == {"US", "GB", "??"}


def test_candidate_history_and_names(spark):
    rows = [("p1", "r1", "2026-01-05T00:00:00Z", True, ["1.1.1.1", "bad"], {"h": [("2.2.2.2",)]}), ("p2", "r2", "2026-01-09T00:00:00Z", True, ["1.1.1.1"], {}),
            ("p3", "r3", "2026-01-08T00:00:00Z", False, ["3.3.3.3"], {}), ("p4", "r4", "2025-01-01T00:00:00Z", True, ["4.4.4.4"], {}), ("p5", "r5", "2026-01-10T00:00:00Z", True, ["5.5.5.5"], {})]
    df = spark.createDataFrame([(a, b, c, d, e, ({k: (v,) for k, v in m.items()},)) for a, b, c, d, e, m in rows],
                               "attempt_path string, run_id string, client_start_utc string, finalised boolean, dns_ingress_candidates array<string>, "
                               "effective_dns struct<hostnames:map<string,struct<A:array<struct<address:string>>>>>")
    history = enumeration.candidate_history(df, before="2026-01-10", days=7)
    got = {r.address: (r.sources, r.run_ids, r.dates, str(r.first_date), str(r.last_date)) for r in enumeration.candidate_evidence(history).collect()}
    assert got == {"1.1.1.1": (1, 2, 2, "2026-01-05", "2026-01-09"), "2.2.2.2": (1, 1, 1, "2026-01-05", "2026-01-05")}
    answers = spark.createDataFrame([("q", "n", "A", "1.1.1.1"), ("q2", "n", "A", "1.1.1.1"), ("q", "n", "AAAA", "::1")], "query_name string, name string, type string, value string")
    names = {(r.address, r.hostname, r.is_fallback) for r in enumeration.address_names(answers, ["q2"]).collect()}
    assert names == {("1.1.1.1", "q", False), ("1.1.1.1", "n", False), ("1.1.1.1", "q2", True)}


def test_daily_report_and_pair_files(spark, tmp_path):
    strata = spark.createDataFrame([("2026-01-01", "pin_mode", "pinned", 3, 2, 1, 0), ("2026-01-01", "session", "s", 3, 2, 1, 0), ("2026-01-02", "pin_mode", "pinned", 9, 9, 0, 0)],
                                   "day string, dimension string, value string, attempts bigint, accepted bigint, excluded bigint, pending bigint")
    chosen = spark.createDataFrame([("2026-01-01", "m", "eligible", 2), ("2026-01-01", "m", "ineligible", 1), ("2026-01-02", "m", "eligible", 9)], "day string, measure string, value string, n bigint")
    assert [tuple(r) for r in summaries.daily_report(strata, chosen, "2026-01-01").collect()] == [("2026-01-01", "m", 2, 3, 2, 1, 0)]
    fields = ["run_id", "campaign", "run_mode", "session", "block_id", "intended_ingress_group", "location_setting", "private_relay_state", "ingress_transport", "server_http_protocol",
              "server_transport", "server_delivery_count", "quic_block_state", "protocol_classification", "disposition", "exclusion_reason", "pending_reason"]
    rows = [{**dict.fromkeys(fields, ""), "run_id": r, "disposition": d, "exclusion_reason": e} for r, d, e in (("a", "accepted", ""), ("x", "excluded", "E01"), ("p", "pending", ""))]
    records = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    sinks.write_pairs(records, str(tmp_path), ["run_id", "disposition"])
    read = lambda n: sorted(r.run_id for r in spark.read.option("header", "true").csv(str(tmp_path / n)).collect())
    assert (read("pairs"), read("exclusions"), read("protocols")) == (["a", "p"], ["x"], ["a", "p", "x"])
    rows = [("2026-01-01", "accepted", " London"), ("2026-01-02", "accepted", "LONDON"), ("2026-01-03", "excluded", "Rome")]
    seq = spark.createDataFrame([(t, d, "GB", "", c) for t, d, c in rows], "t string, disposition string, advertised_country string, advertised_region string, advertised_city string")
    rule = {"rule_id": "exact_value_intersection", "comparison_normalization": "trim_casefold_preserve_raw", "fields": ["city"]}
    out = summaries.temporal_intersection(seq, rule).first()
    assert (out.status, out.common, out.observations, out.distinct_raw) == ("evaluated", "london", 2, 2)
    for declared, status in ((None, "blocked_rule_not_declared"), ("text", "manual_evaluation_required_for_free_text_rule"), (3, "invalid_rule_declaration"), ({"rule_id": "x"}, "unsupported_rule_id"),
                             ({**rule, "comparison_normalization": "x"}, "unsupported_comparison_normalization"), ({**rule, "fields": ["zip"]}, "invalid_or_unsupported_fields"),
                             ({**rule, "fields": ["region"]}, "incomplete_location_fields")):
        assert summaries.temporal_intersection(seq, declared).first().status == status
    assert summaries.temporal_intersection(seq.filter("disposition = 'excluded'"), rule).first().status == "insufficient_accepted_unpinned_observations"
