import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from prefixledger.operators import campaign, enumeration, manifests, quality, routing
from prefixledger.sources import catalogue, evidence, sinks


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def rules(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.rule, []).append(r.key)
    return out


def test_catalogue_scans(spark, tmp_path):
    write(tmp_path, "egress-2026-01-01.csv", '10.0.0.0/24,US,US-CA,"Los Angeles, West",\n\n10.0.1.7/24, GB ,,London,\n')
    write(tmp_path, "egress-2026-01-02.csv", "10.0.0.0/24,US\nbad,US,,,\n2001:DB8::/48,,,,\n10.0.0.128/25,US,,,x\n10.0.0.64/26,US,,,\n10.0.0.70/26,US,,,\n2001:db8:1::/65,,,,\n10.0.0.0/23,US,,,\n")
    write(tmp_path, "one/egress-2026-01-01.csv", "10.0.0.0/24,US,,,\n")
    with pytest.raises(ValueError):
        catalogue.scan_snapshots(spark, str(tmp_path / "one"))
    lenient = {(str(r.snapshot_date), r.canonical): r for r in catalogue.scan_snapshots(spark, str(tmp_path)).collect()}
    assert ("2026-01-01", "10.0.1.0/24") in lenient and lenient[("2026-01-01", "10.0.0.0/24")].city == "Los Angeles, West"
    assert lenient[("2026-01-02", "10.0.0.0/24")].region == "" and ("2026-01-02", None) in lenient
    found = rules(quality.catalogue_violations(catalogue.scan_snapshots(spark, str(tmp_path), strict=True)))
    assert sorted(found["row_shape"]) == ["2026-01-01 ", "2026-01-02 10.0.0.0/24", "2026-01-02 10.0.0.128/25"]
    assert found["malformed_cidr"] == ["2026-01-02 bad"] and found["duplicate_cidr"] == ["2026-01-02 10.0.0.64/26"]
    assert found["ipv6_longer_than_64"] == ["2026-01-02 2001:db8:1::/65"] and found["overlap"] == ["2026-01-02 10.0.0.64/26"]
    with pytest.raises(quality.QualityError):
        quality.require_clean(quality.catalogue_violations(catalogue.scan_snapshots(spark, str(tmp_path), strict=True)))
    odd = quality.date_mismatches(spark, "x/egress-2026-01-02.csv", {"table": "ipasn_20260103.dat", "names": "names_2026_01_02.json", "plain": "x.json"})
    assert [r.key for r in odd.collect()] == ["table"]


def test_routes_names_and_lookup_outcomes(spark, tmp_path):
    dat = write(tmp_path, "r.dat", "; comment\n10.0.0.0/8\t1\n10.1.0.0/16\t2\n10.2.0.0/24\t3\n10.3.0.9/16\t4\n10.4.0.0/16\t\n2001:db8::/32\t5\n")
    names = write(tmp_path, "n.json", json.dumps({"1": "A - AKAMAI-X, US", "2": "HANDLE - Org, Inc., GB", "5": "PLAIN"}))
    rows = spark.createDataFrame([(c, "", "", "") for c in ("10.9.0.0/24", "10.1.5.0/24", "10.2.0.0/23", "10.3.0.0/24", "10.4.0.0/24", "11.0.0.0/24", "2001:db8:5::/48", "bad")],
                                 "cidr string, country string, region string, city string")
    from prefixledger.functions.address import with_prefix

    att = routing.with_operator(routing.attribute(with_prefix(rows, "cidr"), catalogue.scan_routes(spark, dat)), catalogue.scan_as_names(spark, names))
    got = {r.cidr: (r.outcome, r.asn, r.route, r.operator) for r in att.collect()}
    assert got == {
        "10.9.0.0/24": ("matched", 1, "10.0.0.0/8", "Akamai"), "10.1.5.0/24": ("matched", 2, "10.1.0.0/16", "Org, Inc."),
        "10.2.0.0/23": ("containment_failure", None, None, "(invalid BGP containment)"), "10.3.0.0/24": ("lookup_failure", None, None, "(lookup failure)"),
        "10.4.0.0/24": ("lookup_failure", None, None, "(lookup failure)"), "11.0.0.0/24": ("unrouted", None, None, "(unrouted)"),
        "2001:db8:5::/48": ("matched", 5, "2001:db8::/32", "PLAIN"), "bad": (None, None, None, None)}
    with pytest.raises(Exception, match="route lookup failed"):
        routing.strict_attribution(att).select("outcome").collect()


def test_feeds_with_and_without_header(spark, tmp_path):
    write(tmp_path, "feed-2026-01-01.csv", '\n10.0.0.0/24,US,R,"A, B",\n10.0.1.0/24,US,R\n10.0.2.0/24,US,R,C,,x\n')
    write(tmp_path, "feed-2026-01-02.csv", "﻿City,ip_prefix,Country,region,more\nRome,10.0.0.0/24,IT,RM,z\nMilan,10.0.0.0/24,IT,MI\n")
    rows = {(str(r.date), r.ip_prefix, r.city): (r.country, r.region, r.bad_shape) for r in catalogue.scan_feed(spark, str(tmp_path)).collect()}
    assert rows[("2026-01-01", "10.0.0.0/24", "A, B")] == ("US", "R", False)
    assert rows[("2026-01-01", "10.0.1.0/24", "")][2] and rows[("2026-01-01", "10.0.2.0/24", "C")][2]
    assert rows[("2026-01-02", "10.0.0.0/24", "Rome")] == ("IT", "RM", False) and len(rows) == 5
    wide = tmp_path / "wide"
    wide.mkdir()
    head = ",".join([f"x{i}" for i in range(40)] + ["city", "region", "country", "ip_prefix"])
    write(wide, "feed-2026-01-03.csv", head + "\n" + "," * 40 + 'Bonn,"N,W",DE,10.0.3.0/24\n')
    write(wide, "feed-2026-01-04.csv", '10.0.4.0/24,US,"R, S"\n10.0.5.0/24,US,R,"say ""hi"""\n10.0.6.0/24,US,R,C' + "," * 30 + "late\n")
    rows = {r.ip_prefix: (r.country, r.region, r.city, r.bad_shape) for r in catalogue.scan_feed(spark, str(wide)).collect()}
    assert rows == {"10.0.3.0/24": ("DE", "N,W", "Bonn", False), "10.0.4.0/24": ("US", "R, S", "", True), "10.0.5.0/24": ("US", "R", 'say "hi"', False), "10.0.6.0/24": ("US", "R", "C", True)}
    files = spark.createDataFrame([("2026-01-01", 2), ("2026-01-02", 1)], "d string, files int").select(F.col("d").cast("date").alias("date"), "files")
    found = rules(quality.feed_violations(catalogue.scan_feed(spark, str(tmp_path)), files))
    assert found == {"conflicting_prefix": ["2026-01-02 10.0.0.0/24"], "not_one_feed": ["2026-01-01"]}


def test_announced_lists_and_results(spark, tmp_path):
    gz = write(tmp_path, "a.gz", "8.8.8.0\t24\t15169\n9.0.0.0 7 x\nshort\n10.0.0.0 8 1\n8.8.8.128 25 1\n2001:db8:: 32 1\n8.8.4.0 23 2\n")
    blocks = enumeration.source_blocks(catalogue.scan_announced(spark, gz))
    assert [r.prefix for r in enumeration.blocks_in_order(blocks).collect()] == ["8.8.4.0/24", "8.8.5.0/24", "8.8.8.0/24"]
    lst = write(tmp_path, "s.txt", "# head\n8.8.4.0/24 # a\n\n8.8.4.0/24\n1.1.1.0/25\n10.0.0.0/24\n8.8.8.1/24\n")
    found = rules(quality.source_list_violations(catalogue.scan_source_list(spark, lst)))
    assert found == {"not_increasing": ["2:8.8.4.0/24", "3:1.1.1.0/25"], "not_ipv4_24": ["3:1.1.1.0/25"], "not_global": ["4:10.0.0.0/24"], "malformed_prefix": ["5:8.8.8.1/24"]}
    res = write(tmp_path, "results.csv", "query_utc,ecs_prefix,returned_scope,answer_ip\n2026-01-01T00:00:00+00:00,8.8.8.0/24,20,9.9.9.10\n2026-01-01T00:00:01+00:00,8.8.9.0/24,,\n2026-01-01T00:00:02+00:00,8.9.9.0/24,24,9.9.9.9\n")
    rows = catalogue.scan_results(spark, res)
    assert [(r.returned_scope, r.answer_ip) for r in rows.orderBy("query_utc").collect()] == [(20, "9.9.9.10"), (None, None), (24, "9.9.9.9")]
    assert [r.answer_ip for r in enumeration.unique_addresses(rows).collect()] == ["9.9.9.9", "9.9.9.10"]


def test_access_log_keeps_first_copy(spark, tmp_path):
    line = lambda i: json.dumps({"ts": float(i), "status": 200, "run_id": f"r{i}", "request_uuid": f"u{i}", "request": {"remote_ip": "1.1.1.1", "remote_port": "5", "proto": "HTTP/3.0"}})
    write(tmp_path, "b.jsonl", line(1) + "\n" + line(2) + "\n\n{broken\n")
    write(tmp_path, "a.jsonl.gz", line(2) + "\n" + line(3) + "\n" + line(3) + "\n")
    write(tmp_path, "c.packets.jsonl", line(9) + "\n")
    rows = {r.run_id: r for r in evidence.scan_access_log(spark, str(tmp_path)).collect()}
    assert set(rows) == {"r1", "r2", "r3", None} and rows[None].malformed and rows["r2"].artifact.endswith("a.jsonl.gz")
    assert rows["r1"].row_sha256 == hashlib.sha256((line(1) + "\n").encode()).hexdigest()


def test_attempt_documents_events_and_packets(spark, tmp_path):
    write(tmp_path, "d/1/metadata.json", '{\n "run_id": "one"\n}')
    write(tmp_path, "d/2/metadata.json", '[broken')
    write(tmp_path, "d/1/events.jsonl", '{"event": "run_started", "recorded_utc": "2026-01-01T00:00:00Z"}\n{"event": "run_finished", "recorded_utc": "x", "condition_changed": true}\n')
    write(tmp_path, "d/1/dns-queries.jsonl", '{"recorded_utc": "2026-01-01T00:00:00Z", "name": "a.", "qtype": 65}\n')
    docs = {r.attempt_path.rsplit("/", 1)[1]: (r.run_id, r.malformed) for r in evidence.scan_documents(spark, str(tmp_path), "metadata.json", "run_id string").collect()}
    assert docs == {"1": ("one", False), "2": (None, True)}
    assert evidence.scan_events(spark, str(tmp_path)).filter("condition_changed").count() == 1
    from prefixledger.operators.pairing import dns_condition_changed

    assert dns_condition_changed(evidence.scan_query_log(spark, str(tmp_path))).first().dns_condition_changed
    export = write(tmp_path, "p.tsv", "\t".join(evidence.DECODED) + "\n" + "\t".join(
        {"frame.number": "3", "frame.time_epoch": "1.5", "ip.src": "1.1.1.1", "ip.dst": "2.2.2.2", "udp.srcport": "7", "udp.dstport": "443", "quic.long.packet_type": "1"}.get(c, "") for c in evidence.DECODED) + "\n")
    p = evidence.scan_packet_export(spark, export).first()
    assert (p.transport, p.src_port, p.quic_initial, p.tcp_len) == ("udp", 7, False, 0)
    lines = write(tmp_path, "q.packets.jsonl", '{"transport": "tcp", "src_port": 5, "dst_port": 443, "tcp_syn": true, "quic_initial": false, "quic.long.packet_type": "0"}\n')
    p = evidence.scan_packet_lines(spark, lines).first()
    assert (p.src_port, p.tcp_syn, p.quic_initial) == (5, True, False)


def test_series_origins_and_operator_rules(spark, tmp_path):
    head = "date_from,date_to,interval_days,family,added_pfx,removed_pfx,added_addrs,removed_addrs,reassigned_addrs,reassign_count,fake_churn_pfx\n"
    text = head + "2026-01-01,2026-01-02,1,v4,1,0,256,0,0,0,0\n2026-01-01,2026-01-03,1,v6,1,0,0,0,0,0,0\n2026-01-01,2026-01-02,1,v4,1,-1,0,0,0,0,0\n2026-01-01,2026-01-05,4,v9,x,0,0,0,0,0,0\n"
    found = rules(quality.churn_series_violations(catalogue.scan_churn_series(spark, write(tmp_path, "s.csv", text))))
    assert {k: len(v) for k, v in found.items()} == {"invalid_interval": 1, "negative_count": 1, "duplicate_row": 1, "invalid_family": 1, "invalid_value": 1}
    ops = spark.createDataFrame([("714", "own", "n", "r", "v1"), ("20940", "sib", "n", "r", "v1"), ("16625", "other", "n", "", "v1"), ("0", "z", "n", "r", "v2"), ("20940", "sib", "n", "r", "v1")],
                                "asn string, operator_id string, operator_name string, mapping_rule string, version string")
    found = rules(quality.operator_map_violations(ops, version="v1", required={714: "own"}, siblings=[20940, 16625, 36183]))
    assert found == {"invalid_asn": ["0"], "duplicate_asn": ["20940"], "wrong_version": ["0"], "empty_field": ["16625"], "missing_sibling": ["36183"], "siblings_differ": ["siblings"]}


def test_manifests_and_sinks(spark, tmp_path):
    for name, text in {"a.txt": "a", "d/b.txt": "b", "c.txt": "c"}.items():
        write(tmp_path / "files", name, text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = manifests.file_hashes(spark, str(tmp_path / "files"), root=str(tmp_path / "files"))
    assert {(r.path, r.bytes, r.sha256) for r in files.collect()} == {("a.txt", 1, sha("a")), ("d/b.txt", 1, sha("b")), ("c.txt", 1, sha("c"))}
    text = write(tmp_path, "m.sha256", f"{sha('a').upper()}  a.txt\n{sha('x')}  d/b.txt\n{sha('z')}  gone.txt\nbroken\n{sha('q')}  ../up\n")
    listed = evidence.scan_manifest_text(spark, text)
    assert sorted(r.problem for r in listed.collect() if r.problem) == ["invalid line", "unsafe path"]
    problems = manifests.verify_manifest(listed.filter("problem is null"), files)
    assert {(r.path, r.problem) for r in problems.collect()} == {("d/b.txt", "hash mismatch"), ("gone.txt", "missing"), ("c.txt", "unlisted")}
    csv = write(tmp_path, "m.csv", f"path,bytes,sha256\na.txt,2,{sha('a')}\nc.txt,1,{sha('c')}\nd/b.txt,1,{sha('b')}\n")
    assert [(r.path, r.problem) for r in manifests.verify_manifest(evidence.scan_manifest_csv(spark, csv), files).collect()] == [("a.txt", "size mismatch")]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, ["x"], None)], "a int, b array<string>, c string")
    sinks.write_csv(df, out, ["b", "a", "c"], frozen=True)
    assert spark.read.option("header", "true").option("escape", '"').csv(out).first().asDict() == {"b": '["x"]', "a": "1", "c": None}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(df, out, ["a"], frozen=True)
    hashes = sinks.write_hashes(spark, out, str(tmp_path / "hashes"))
    assert hashes.filter(F.col("path").endswith(".csv")).count() >= 1
    dated = manifests.snapshot_manifest(spark.createDataFrame([("egress-2026-01-01.csv",), ("egress-2026-01-04.csv",)], "path string"), catalogue.snapshot_date(F.col("path")))
    assert [r.days_since_previous for r in dated.orderBy("path").collect()] == [None, 3]
    feeds = spark.createDataFrame([("a", "f", sha("a"), "2026-01-01", "c", "zz", "2026-01-01")], "attempt_path string, feed_path string, feed_sha256 string, feed_date string, "
                                  "candidate_snapshot_path string, candidate_snapshot_sha256 string, day string")
    stored = spark.createDataFrame([("f", sha("a")), ("c", sha("c"))], "path string, sha256 string")
    assert [(r.kind, r.problem) for r in manifests.same_day_feed(feeds, stored).collect()] == [("candidates", "recorded hash is missing or invalid")]


def test_route_evidence_and_additions(spark, tmp_path):
    doc = {"observation_date_utc": "2026-01-05", "responses": [
        {"requested_timestamp": f"2026-01-05T{h}", "api_response": {"status": "ok", "data": {"bgp_state": [
            {"target_prefix": "10.0.0.0/8", "path": ["1", "9"]}, {"target_prefix": "10.1.0.0/16", "path": ["1", "7"]}, {"target_prefix": "10.2.0.0/16", "path": ["1", "7" if h == "00" else "8"]},
            {"target_prefix": "10.3.0.0/16", "path": ["{1,2}"]}]}}} for h in ("00", "12")]}
    ev = evidence.scan_route_evidence(spark, write(tmp_path, "e.json", json.dumps(doc)))
    planned = spark.createDataFrame([(dt.date(2026, 1, 5), a) for a in ("10.1.0.1", "10.2.0.1", "10.3.0.1", "10.9.0.1", "11.0.0.1")], "date date, address string")
    got = campaign.reconstructed_origins(ev, planned, timestamps_per_day=2).cache()
    rows = {r.address: (r.prefix, r.asn, r.problem) for r in got.collect()}
    assert rows["10.1.0.1"] == ("10.1.0.0/16", 7, None) and rows["10.9.0.1"] == ("10.0.0.0/8", 9, None)
    assert rows["10.2.0.1"][2] == "prefix or origin changed" and rows["10.3.0.1"][2] == rows["11.0.0.1"][2] == "no single scalar origin at some time"
    current = spark.createDataFrame([(dt.date(2026, 1, 5), "10.0.0.0/8", 9), (dt.date(2026, 1, 5), "10.1.0.0/16", 5)], "date date, prefix string, asn bigint")
    assert [(r.prefix, r.asn, r.conflict) for r in campaign.origin_additions(got, current).collect()] == [("10.1.0.0/16", 7, True)]
    pend = planned.filter("address like '10.1%' or address like '10.2%'")
    assert {(r.address, r.problem) for r in campaign.plan_coverage(pend, planned.filter("address like '10.2%' or address like '11%'")).collect()} == {
        ("10.1.0.1", "not planned"), ("11.0.0.1", "not pending")}
