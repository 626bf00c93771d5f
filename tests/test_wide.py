"""Both families in one order: CIDR lists by words, closest blocks by the sweep, folds without sorting."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.operators import containment as C, covering as V, measure as M, rib

TOP = (1 << 128) - 1


def test_cidr_lists_of_two_words_equal_the_library(spark):
    rng = random.Random(1)
    edges = [0, 1, 2, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 1 << 64, (1 << 64) + (1 << 63), (1 << 127) - 1, 1 << 127, TOP - 1, TOP]
    cases = [(6, a, b) for a in edges for b in edges if a <= b]
    cases += [(6, a, min(TOP, a + rng.getrandbits(rng.randint(1, 127)))) for a in (rng.getrandbits(rng.randint(1, 128)) for _ in range(300))]
    cases += [(4, *sorted((rng.getrandbits(32), rng.getrandbits(32)))) for _ in range(150)] + [(4, 0, (1 << 32) - 1)]
    d = spark.createDataFrame([(f, f"{a:032x}", f"{b:032x}") for f, a, b in cases] + [(6, None, f"{1:032x}"), (6, f"{5:032x}", f"{4:032x}")], "family int, a string, b string")
    d = d.withColumn("l", addr.wide_cidrs("family", addr.wide_from_hex("a"), addr.wide_from_hex("b")))
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    for r in d.collect():
        make = ipaddress.IPv4Address if r.family == 4 else ipaddress.IPv6Address
        bad = r.a is None or r.a > r.b
        assert r.l == (None if bad else [str(n) for n in ipaddress.summarize_address_range(make(int(r.a, 16)), make(int(r.b, 16)))])


def networks(rng, n):
    """Nested blocks of both families, crowded so that chains are deep."""
    out = set()
    for _ in range(n):
        if rng.random() < 0.5:
            plen = rng.choice((0, 4, 8, 9, 12, 16, 20, 24, 31, 32))
            out.add(ipaddress.ip_network((rng.choice((10, 10, 11, 255)) << 24 | rng.getrandbits(10) << 6 | rng.getrandbits(3), plen), strict=False))
        else:
            plen = rng.choice((0, 1, 16, 32, 33, 63, 64, 65, 100, 127, 128))
            out.add(ipaddress.ip_network(((0x20010DB8 << 96) | rng.getrandbits(4) << 62 | rng.getrandbits(3), plen), strict=False))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 13])
@pytest.mark.parametrize("seed", [1, 2])
def test_closest_blocks_equal_the_library(spark, seed, parts):
    rng = random.Random(seed)
    nets = networks(rng, 150)
    blocks = spark.createDataFrame([(str(n), i) for i, n in enumerate(nets)], "n string, pid int").select(addr.cidr_bounds("n").alias("b"), "n", "pid").select("b.*", "n", "pid")
    asked = [rng.choice(nets).network_address + rng.choice((0, 0, 1, 5)) if rng.random() < 0.6 else ipaddress.ip_address(rng.choice((rng.getrandbits(32), (0x20010DB8 << 96) + rng.getrandbits(66)))) for _ in range(200)
             if True]
    texts = sorted({str(a) for a in asked if a.version == 6 or int(a) < 1 << 32})
    p = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addr.point_of("t", addr.WIDE).alias("p")).select("t", "p.family", F.col("p.ip").alias("ip_start"))
    found = V.deepest(p, blocks, ["n", "plen"], parts=parts)
    got = {r.t: r.n for r in p.join(found, ["family", "ip_start"], "left").collect()}
    for t in texts:
        a = ipaddress.ip_address(t)
        want = max((n for n in nets if n.version == a.version and a in n), key=lambda n: n.prefixlen, default=None)
        assert got[t] == (want and str(want)), t
    up = {r.own.n: r.around.n for r in V.enclosing(blocks, ["n"], parts=parts).collect()}
    for n in nets:
        want = max((m for m in nets if m.version == n.version and m != n and n.subnet_of(m)), key=lambda m: m.prefixlen, default=None)
        assert up.get(str(n)) == (want and str(want))


def test_the_sweep_has_one_row_for_each_block_and_point(spark):
    b = spark.range(3000).select(F.lit(4).alias("family"), (F.col("id") * 256).alias("ip_start"), F.lit(24).alias("plen"), F.col("id").alias("n"))
    p = spark.range(5000).select(F.lit(4).alias("family"), (F.col("id") * 100).alias("ip"))
    r = C.longest_match(p, b, ["n"])
    assert "Generate" not in r._jdf.queryExecution().executedPlan().toString().split("AdaptiveSparkPlan")[0]
    assert r.where("n IS NOT NULL").count() == 5000 and r.where("n = ip div 256").count() == 5000
    hot = spark.range(20000).select(F.lit(4).alias("family"), F.lit(300).cast("bigint").alias("ip"))
    assert C.longest_match(hot, b, ["n"]).where("n = 1").count() == 20000


def test_odd_addresses_and_empty_sides(spark):
    b = spark.createDataFrame([("2001:db8::/32",), ("10.0.0.0/8",), ("::/0",)], "n string").select(addr.cidr_bounds("n").alias("b"), "n").select("b.*", "n")
    t = spark.createDataFrame([("2001:DB8::1",), ("::ffff:10.0.0.1",), ("10.1.2.3",), ("11.0.0.1",), ("nonsense",), (None,), ("1::2::3",), ("2001:db8::/48",)], "t string")
    got = {r.t: r.n for r in C.longest_match(t.select("t", addr.point_of("t", addr.WIDE).alias("p")).select("t", "p.family", "p.ip"), b, ["n"]).collect()}
    assert got == {"2001:DB8::1": "2001:db8::/32", "::ffff:10.0.0.1": "::/0", "10.1.2.3": "10.0.0.0/8", "11.0.0.1": None, "nonsense": None, None: None, "1::2::3": None, "2001:db8::/48": None}
    assert C.longest_match(t.limit(0).select(F.lit(4).alias("family"), F.lit(None).cast(addr.WIDE_TYPE).alias("ip")), b, ["n"]).count() == 0
    assert V.deepest(b.select("family", "ip_start"), b.limit(0), ["n"]).count() == 0 and V.enclosing(b.limit(0), ["n"]).count() == 0
    narrow = spark.createDataFrame([(4, 10 << 24, 8, "x")], "family int, ip_start long, plen int, n string")
    assert [r.n for r in C.longest_match(t.where("t IN ('10.1.2.3', '2001:DB8::1')").select("t", addr.point_of("t", addr.NARROW).alias("p")).select("t", "p.*"), narrow, ["n"]).orderBy("t").collect()] == ["x", None]


def test_bootstrap_of_both_families_and_labels(spark):
    s = spark.createDataFrame([("41.0.0.0/8", ["http://a", "https://b"]), ("2001:4200::/23", ["https://c/"])], "cidr string, urls array<string>")
    ips = spark.createDataFrame([("41.1.1.0/24",), ("2001:43ff::1",), ("2001:4400::",), ("x",)], "ip string")
    assert {r.ip: r.base for r in M.bootstrap_for_ip(ips, s).collect()} == {"41.1.1.0/24": "https://b/", "2001:43ff::1": "https://c/", "2001:4400::": None, "x": None}
    t = spark.createDataFrame([("COM", ["https://v"]), ("xn--p1ai", ["https://r/"])], "tld string, urls array<string>")
    d = spark.createDataFrame([("Example.com.",), ("a.b.XN--P1AI",), ("com",), ("x.net",), ("",)], "domain string")
    assert {r.domain: r.base for r in M.bootstrap_for_domain(d, t).collect()} == {"Example.com.": "https://v/", "a.b.XN--P1AI": "https://r/", "com": "https://v/", "x.net": None, "": None}


def test_folds_of_wide_tables_hash_and_do_not_sort(spark):
    rows = [("a", "10.0.0.0/8", [1, 2, 7]), ("b", "10.0.0.0/8", [3, 7]), ("a", "10.0.0.0/8", [4, 9]), ("a", "2001:db8::/32", [5, 4294967295]), ("b", "2001:db8::/32", [6, 0]), ("b", "2001:db8::/32", [6, 0])]
    e = spark.createDataFrame(rows, "collector string, prefix string, asns array<bigint>").withColumn("b", addr.cidr_bounds("prefix")).select("collector", "prefix", "asns", "b.*")
    for df in (rib.observations(e), rib.distinct_paths(e), rib.prefix_dimension(rib.distinct_paths(e))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    got = {r.prefix: (r.origin_asn, r.n_origins, r.n_paths, r.n_distinct_paths, r.plen) for r in rib.prefix_dimension(rib.distinct_paths(e)).collect()}
    assert got == {"10.0.0.0/8": (7, 2, 3, 3, 8), "2001:db8::/32": (0, 2, 3, 2, 32)}
    lone = e.where("collector = 'a'")
    assert {r.prefix: r.origin_asn for r in rib.prefix_dimension(rib.distinct_paths(lone)).collect()} == {"10.0.0.0/8": 7, "2001:db8::/32": 4294967295}


def test_odd_networks_read_as_the_library_reads_them(spark):
    good = ["::", "::/0", "1::", "::1", "1:2:3:4:5:6:7:8", "2001:DB8::/32", "2001:db8:ffff::1/33", "::ffff:1.2.3.4/120", "1:0:0:2::3/64", "0.0.0.0/0", "10.255.199.249/31", "255.255.255.255"]
    bad = ["", ":", ":::", "1::2::3", ":1::2", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3.256", "::1.2::3", "::/129", "10.0.0.0/33", "256.0.0.0", "01.0.0.0", "10.0.0", None]
    d = spark.createDataFrame([(t,) for t in good + bad], "t string").withColumn("b", addr.cidr_bounds("t")).select("t", "b", addr.wide_hex("b.ip_start").alias("s"), addr.wide_hex("b.ip_end").alias("e"), addr.network_text("b.family", "b.ip_start", "b.plen").alias("n"))
    got = {r.t: r for r in d.collect()}
    assert all(got[t].b is None for t in bad)
    for t in good:
        n = ipaddress.ip_network(t, strict=False)
        assert (got[t].b.family, got[t].b.plen, int(got[t].s, 16), int(got[t].e, 16)) == (n.version, n.prefixlen, int(n[0]), int(n[-1])), t
        assert n.version == 4 or got[t].n == str(ipaddress.IPv6Address(int(n[0]))).replace("::ffff:1.2.3.0", "::ffff:102:300") + f"/{n.prefixlen}"


def test_cidr_texts_are_written_without_patterns_and_masks_mention_their_length_little(spark):
    d = spark.createDataFrame([(6, "0" * 32, "f" * 32)], "family int, a string, b string")
    plan = lambda c: d.select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan(addr.wide_cidrs("family", addr.wide_from_hex("a"), addr.wide_from_hex("b")))
    assert "least(" not in plan(addr.cidr_bounds("a"))
