import ipaddress
import random

import pytest

from pyspark.sql import functions as F

from prefixledger.functions import address as A


def _expected(text, strict=False):
    try:
        net = ipaddress.ip_network(text.strip(), strict=strict)
    except ValueError:
        return None
    return (net.version, net.prefixlen, str(net))


CASES = [
    "10.0.0.0/8", "10.1.2.3/8", "10.1.2.3", " 1.2.3.4/24 ", "1.2.3.256/24", "01.2.3.4/24", "1.2.3/24",
    "1.2.3.4/33", "1.2.3.4/08", "1.2.3.4/", "1.2.3.4/255.255.255.0", "1.2.3.4/0.0.0.255", "1.2.3.4/255.0.255.0",
    "1.2.3.4/0.0.0.0", "1.2.3.4/-1", "1.2.3.4/24/3", "", "abc", "0.0.0.0/0", "255.255.255.255/32", "::/0", "::",
    "::1", "1::", "2001:db8::/32", "2001:DB8:0:0:0:0:0:1/64", "2001:db8::1::2/64", ":::", "1:2:3:4:5:6:7:8/128",
    "1:2:3:4:5:6:7::/128", "::2:3:4:5:6:7:8/128", "1:2:3:4:5:6:7/128", "1:2:3:4:5:6:7:8:9/64", "1::2:0:0:3/128",
    "1:0:0:2:0:0:0:3/128", "::ffff:1.2.3.4/128", "::1.2.3.4/128", "64:ff9b::1.2.3.4/96", "1:2:3:4:5:6:1.2.3.4/128",
    "12345::/16", "g::/16", "2001:db8::/129", "2001:db8::/x", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
    "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/127", "8000::/1", "2001:db8::/255.255.0.0", "1:0:2:0:3:0:4:0/128",
    "::ffff:0:0/96", "fe80::1:2:3:4/65", "0:0:0:0:0:0:0:0/0", "1.2.3.4:5::/64", "::1.2.3.4:5",
]


def test_parse_matches_the_standard_library(spark):
    rng = random.Random(7)
    texts = list(CASES)
    for _ in range(400):
        texts.append(f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randint(0, 32)}")
        value = rng.getrandbits(128)
        for shift in range(0, 128, 16):
            if rng.random() < 0.5:
                value &= ~(0xFFFF << shift)
        texts.append(f"{ipaddress.IPv6Address(value)}/{rng.randint(0, 128)}")
        texts.append(f"{ipaddress.IPv6Address(value).exploded}/{rng.randint(0, 128)}")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, cidr string")
    for strict in (False, True):
        parsed = A.with_prefix(df, "cidr", strict=strict)
        got = {
            r.i: None if r.family is None else (r.family, r.plen, r.text)
            for r in parsed.withColumn("text", A.cidr_text()).collect()
        }
        wrong = [(t, got[i], _expected(t, strict)) for i, t in enumerate(texts) if got[i] != _expected(t, strict)]
        assert not wrong


def test_halves_sort_in_address_order_and_step_to_the_next_prefix(spark):
    rng = random.Random(8)
    nets = [ipaddress.ip_network((rng.getrandbits(128), p), strict=False) for p in (0, 1, 2, 63, 64, 65, 66, 127, 128) for _ in range(20)]
    nets += [ipaddress.ip_network("ffff::/16"), ipaddress.ip_network("::ffff:ffff:ffff:ffff/128")]
    df = A.with_prefix(spark.createDataFrame([(str(n),) for n in nets], "cidr string"), "cidr")
    step = A.next_start(F.col("hi"), F.col("lo"), F.col("plen"))
    rows = df.select("cidr", step.alias("s"), A.v6_text("hi", "lo").alias("t")).select(
        "cidr", "t", F.when(F.col("s.hi").isNotNull(), A.v6_text("s.hi", "s.lo")).alias("n")).collect()
    for r in rows:
        net = ipaddress.ip_network(r.cidr)
        after = int(net.broadcast_address) + 1
        assert r.n == (str(ipaddress.IPv6Address(after)) if after < 2**128 else None)
    ordered = [r.cidr for r in df.orderBy("hi", "lo", "plen").collect()]
    assert [int(ipaddress.ip_network(c).network_address) for c in ordered] == sorted(int(n.network_address) for n in nets)


def test_range_block_count(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(500):
        a, b = sorted(rng.randint(0, 2**32) for _ in range(2))
        if a < b:
            pairs.append((a, b))
    pairs += [(0, 2**32), (5, 5), (0, 1)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in df.select("a", "b", A.range_block_count(F.col("a"), F.col("b")).alias("n")).collect():
        want = 0 if r.a == r.b else len(list(ipaddress.summarize_address_range(
            ipaddress.IPv4Address(r.a), ipaddress.IPv4Address(r.b - 1))))
        assert r.n == want


def test_global_test_matches_the_standard_library(spark):
    rng = random.Random(10)
    starts = [rng.getrandbits(24) << 8 for _ in range(2000)]
    starts += [int(ipaddress.ip_address(t)) for t in (
        "192.0.0.0", "192.88.99.0", "224.0.0.0", "100.64.0.0", "100.127.255.0", "198.19.255.0", "240.0.0.0",
        "203.0.113.0", "198.51.100.0", "192.0.2.0", "0.0.0.0", "127.0.0.0", "169.254.3.0", "172.31.0.0")]
    df = spark.createDataFrame([(s,) for s in starts], "s bigint")
    for r in df.select("s", A.is_global_v4(F.col("s"), F.lit(24)).alias("g")).collect():
        assert r.g == ipaddress.ip_network((r.s, 24)).is_global, r


def test_counts_too_large_raise(spark):
    df = spark.createDataFrame([(6, 2), (6, 128), (4, 0)], "family int, plen int").select(A.address_count(F.col("family"), F.col("plen")).alias("n"))
    assert sorted(int(r.n) for r in df.collect()) == [1, 2**32, 2**126]
    with pytest.raises(Exception, match="more addresses than a decimal holds"):
        spark.createDataFrame([(6, 1)], "family int, plen int").select(A.address_count(F.col("family"), F.col("plen")).alias("n")).collect()
