"""Time tiles, file hashes of any size, absolute line numbers, ranged plan windows spread malformed rows,
ordered sinks and the address layout of large tables, against plain Python or DuckDB."""

import gzip
import hashlib
import ipaddress
import json
import os
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prefixledger.functions import address as A
from prefixledger.operators import campaign, manifests, routing, time_tiles
from prefixledger.plans import derived as D
from prefixledger.sources import evidence, sinks


def test_covers_are_exact_and_short(spark):
    rng = random.Random(4)
    spans = [(a, b) for a in range(12) for b in range(a - 1, 20)] + [(a := rng.randrange(10**9), a + rng.randrange(10**6)) for _ in range(100)]
    spans.append((28_000_000, 28_000_000 + 366 * 1440))
    frame = spark.createDataFrame(spans, "a long, b long").select("a", "b", time_tiles.cover(F.col("a"), F.col("b")).alias("c"))
    for r in frame.collect():
        units = sorted((t.tile << t.level, (t.tile + 1) << t.level) for t in r.c)
        if r.b < r.a:
            assert not units
            continue
        assert units[0][0] == r.a and units[-1][1] == r.b + 1
        assert all(x[1] == y[0] for x, y in zip(units, units[1:], strict=False))
        assert len(units) <= max(1, 2 * (r.b - r.a + 1).bit_length())
        assert len(units) < 60


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(7)
    windows = [(k, rng.choice("ab"), s := rng.uniform(0, 1e5), s + rng.choice([-5.0, 0.0, 30.0, 3000.0, 4e7])) for k in range(60)]
    windows += [(98, None, 0.0, 1e9), (99, "a", None, 5.0), (97, "a", 60.0, 120.0)]
    points = [(k, rng.choice("abc"), rng.uniform(0, 1.2e5)) for k in range(300)] + [(900, "a", 60.0), (901, "a", 120.0), (902, None, 5.0), (903, "a", None), (900, "a", 60.0)]
    w = spark.createDataFrame(windows, "w long, k string, lo double, hi double")
    p = spark.createDataFrame(points, "p long, k string, t double")
    got = sorted((r.w, r.p) for r in time_tiles.join_points(w, p, ["k"], start="lo", stop="hi", at="t").collect())
    want = sorted((x[0], y[0]) for x in windows for y in points if x[1] is not None and x[1] == y[1] and x[2] is not None and y[2] is not None and x[2] <= y[2] <= x[3])
    assert got == want
    assert time_tiles.join_points(w.limit(0), p, ["k"], start="lo", stop="hi", at="t").count() == 0


def test_hashes_of_files_of_any_size(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "empty").write_bytes(b"")  # Spark's scans skip it
    bodies = {"a b.bin": rng.randbytes(10), "sub/edge": rng.randbytes(1000), "sub/long.bin": rng.randbytes(5001)}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    want = {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
    for whole in (0, 1000, 1 << 20):
        got = manifests.file_hashes(spark, str(tmp_path), root=str(tmp_path), whole=whole, chunk=700)
        assert {r.path: (r.bytes, r.sha256) for r in got.collect()} == want


def test_hash_of_a_file_beyond_two_gibibytes(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "sparse.pcap", "wb") as out:
        out.truncate(size)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        digest.update(zeros)
    (row,) = manifests.file_hashes(spark, str(tmp_path)).collect()
    assert (row.bytes, row.sha256) == (size, digest.hexdigest()) and row.path.endswith("/sparse.pcap")


def test_captures_with_one_stream_number_stay_apart(spark, tmp_path):
    packet = {"frame_number": 1, "time_epoch": 5.0, "src_ip": "198.51.100.1", "dst_ip": "10.0.0.5", "transport": "tcp", "stream": "0"}
    for name, n in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.packets.jsonl").write_text("\n".join(json.dumps(packet | {"frame_number": k}) for k in range(n)) + "\n")
    rows = evidence.scan_packet_lines(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and len({r.artifact_sha256 for r in rows}) == 2
    assert {r.artifact_sha256 for r in rows} == {hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir()}


def test_line_numbers_equal_enumerate(spark, tmp_path):
    rng, want = random.Random(3), set()
    for k in range(4):
        lines = [rng.choice(["", "x" * rng.randint(1, 300), f"line {rng.random()}"]) for _ in range(400 + k)]
        body = "\n".join(lines) + "\n"
        name = f"log{k}.jsonl" + (".gz" if k == 3 else "")
        (tmp_path / name).write_bytes(gzip.compress(body.encode()) if k == 3 else body.encode())
        want |= {(name, n, line) for n, line in enumerate(lines, 1)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = evidence.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = [(r.artifact.rsplit("/", 1)[-1], r.line_number, r.value) for r in rows]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("size", [3, 4096])
def test_plan_windows_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(campaign, "PLAN_RANGE", size)
    rng = random.Random(size)
    slots = [(f"s{k:02}", k) for k in range(20)]
    times = {s: (rng.choice([None, rng.randrange(50)]), rng.choice([None, rng.randrange(50)])) for s, _ in slots}
    frame = spark.createDataFrame([(s, p, *times[s]) for s, p in slots], "slot_id string, position int, complete_at int, first_at int")
    got = {r.slot_id: (r.earlier_complete, r.earlier_complete_at, r.later_started) for r in campaign._around(frame).collect()}
    for s, p in slots:
        done = [times[x][0] for x, q in slots if q < p]
        begun = [times[x][1] for x, q in slots if q > p and times[x][1] is not None]
        known = [d for d in done if d is not None]
        assert got[s] == (len(known) == len(done), max(known, default=None), min(begun, default=None))


def test_malformed_rows_pass_the_route_join_spread_out(spark):
    rows = [(k, "bad") for k in range(900)] + [(k, f"10.0.{k % 256}.0/24") for k in range(900, 1000)]
    catalogue = A.with_prefix(spark.createDataFrame(rows, "n long, cidr string"), "cidr")
    routes = A.with_prefix(spark.createDataFrame([("0.0.0.0/0", 64500), ("10.0.128.0/17", 64501)], "cidr string, asn long"), "cidr")
    out = routing.attribute(catalogue, routes)
    assert out.filter("outcome is null").count() == 900
    assert {(r.asn, r["count"]) for r in out.filter("outcome = 'matched'").groupBy("asn").count().collect()} == {(64500 + b, sum(1 for k in range(900, 1000) if (k % 256 >= 128) == bool(b))) for b in (0, 1)} - {(64501, 0), (64500, 0)}


def _lines(folder):
    files = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return [line for f in files for line in open(os.path.join(folder, f)).read().splitlines()], len(files)


def test_address_files_are_in_numeric_order(spark, tmp_path):
    rng = random.Random(5)
    v4 = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(2000)]
    v6 = [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(500)]
    df = spark.createDataFrame([(a,) for a in v4 + v6 + v4[:50] + [None]], "answer_ip string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_addresses(df, str(tmp_path / "a"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got, files = _lines(tmp_path / "a")
    assert files > 1
    assert got == sorted(set(v4), key=ipaddress.ip_address) + sorted(set(v6), key=ipaddress.ip_address)
    sinks.write_addresses(df.limit(0), str(tmp_path / "none"))
    assert _lines(tmp_path / "none")[0] == []
    with pytest.raises(Exception, match="not an address: 10.0.0.0/8"):
        sinks.write_addresses(spark.createDataFrame([("10.0.0.0/8",)], "a string"), str(tmp_path / "bad"))


def test_csv_order_and_sorted_keys(spark, tmp_path):
    schema = "date_from string, family int, addresses bigint, from_country string, from_region string, from_city string, to_country string, to_region string, to_city string, cell struct<z:int,a:array<struct<y:int,b:map<string,int>>>>"
    rng = random.Random(6)
    rows = [("d", rng.choice((4, 6)), rng.randrange(9), rng.choice("ab"), "r", str(i), "c", "r", "c", (1, [(2, {"q": 1, "c": 2})])) for i in range(300)]
    sinks.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "t"), ["family", "addresses", "from_country", "from_city", "cell"], order=sinks.TRANSITION_ORDER)
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in _lines(tmp_path / "t")[0] if not x.startswith("family,")], "v string")
           .selectExpr("from_csv(v, 'family int, addresses int, c string, city string, cell string', map('escape', '\"')) as r").select("r.*").collect()]
    want = sorted(((r[1], r[2], r[3], r[5]) for r in rows), key=lambda r: (r[0], -r[1], r[2], r[3]))
    assert [r[:4] for r in got] == want
    assert {r[4] for r in got} == {'{"a":[{"b":{"c":2,"q":1},"y":2}],"z":1}'}
    empty = spark.createDataFrame([(None,), ((None, [None]),)], "cell struct<z:int,a:array<struct<y:int,b:map<string,int>>>>")
    assert {r.cell for r in sinks.flat(empty, ["cell"]).collect()} == {"", '{"a":[null]}'}


def test_customers_beyond_the_wide_slots_keep_their_ipv4_rows(spark, tmp_path):
    import duckdb
    import oracle_queries as O

    for name in ("nation", "region", "supplier"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    edge = [D.WIDE_SLOTS + d for d in range(-40, 80)] + [D.V4_SLOTS + d for d in range(-8, 8)]
    spark.createDataFrame([(k, k % 25, "BUILDING") for k in edge], "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for name in ("nation", "region", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    place = F.when(F.col("family") == 4, A.v4_from_half(F.col("hi"))).otherwise(F.col("hi").bitwiseXOR(F.lit(A.ZERO_HALF)))
    rows = lambda df: Counter((r.family, r.plen, r.s) for r in df.select("family", "plen", place.alias("s")).collect())
    days = rows(D.catalogue(spark, str(tmp_path)))
    assert days == Counter(con.execute(f"WITH {O.CATALOGUE} SELECT family, plen, s FROM cat").fetchall())
    assert rows(D.routes(spark, str(tmp_path))) == Counter(con.execute(f"WITH {O.CATALOGUE}, {O.ROUTES} SELECT family, plen, s FROM routed").fetchall())
    held = Counter((r.family, r.b) for r in D.lenient_catalogue(spark, str(tmp_path)).select("family", F.col("_ordinal").alias("b")).distinct().collect())
    assert all(held[(4, k)] == (k < D.V4_SLOTS) for k in edge if k % 50 != 49)
    first = D.catalogue(spark, str(tmp_path)).filter((F.col("snapshot_date") == D.DAYS[0]) & (F.col("family") == 4))
    assert first.count() == first.select("hi", "plen").distinct().count() == sum(k < D.V4_SLOTS for k in edge)


def test_names_reach_hot_and_missing_asns(spark):
    """Names within the bound are broadcast; beyond it a shuffle gives the same rows and spreads those without an ASN."""
    rows = spark.range(4000).selectExpr(
        "id", "if(id % 10 < 6, null, if(id % 10 < 9, 7, id % 50)) as asn", "if(id % 10 < 6, if(id % 2 = 0, 'unrouted', 'lookup_failure'), 'matched') as outcome")
    names = spark.createDataFrame([(7, "HOT-AS Example"), (9, "NINE"), (None, "nobody")], "asn long, as_name string")
    near = routing.with_operator(rows, names)
    far = routing.with_operator(rows, names, broadcast_names=2)
    pick = lambda df: sorted(map(str, df.select("id", "asn", "as_name", "operator").collect()))
    assert pick(near) == pick(far) and near.count() == 4000
    assert far.filter("asn is null and as_name is not null").count() == 0 and near.filter("asn = 7 and as_name is null").count() == 0
    assert "BroadcastHashJoin" in near._jdf.queryExecution().executedPlan().toString()
    keys = rows.filter("asn is null").select(F.pmod(F.hash(F.xxhash64(F.monotonically_increasing_id())), F.lit(8)).alias("task"))
    sizes = [r["count"] for r in keys.groupBy("task").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
