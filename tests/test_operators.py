"""Operators on hand-made edge rows against brute force."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.operators import adjacency as A, assets as AS, containment as C, geo as G, intervals as I, ordered, rib, search as S, validation as V

PREFIX = "pid bigint, family int, prefix string, plen int, ip_start bigint, ip_end bigint"


def nets(spark, texts):
    rows = []
    for i, t in enumerate(texts):
        n = ipaddress.ip_network(t)
        rows.append((i, 4, t, n.prefixlen, int(n[0]), int(n[-1])))
    return spark.createDataFrame(rows, PREFIX)


# Deep nesting, children at either end, a parent hidden by its halves, both ends of the space.
NESTED = ["0.0.0.0/1", "0.0.0.0/8", "0.0.0.0/9", "0.0.0.0/24", "10.0.0.0/8", "10.0.0.0/9", "10.128.0.0/9", "10.128.0.0/10", "10.255.255.0/24", "128.0.0.0/1", "255.255.255.255/32",
          "9.255.255.0/24", "11.0.0.0/32"]


def widened(df):
    return df.withColumn("ip_start", addr.wide_from_v4("ip_start")).withColumn("ip_end", addr.wide_from_v4("ip_end"))


def narrowed(df):
    return df.withColumn("ip_start", addr.v4_from_wide("ip_start")).withColumn("ip_end", addr.v4_from_wide("ip_end"))


def owner(point, texts):
    best = [(n.prefixlen, i) for i, n in enumerate(map(ipaddress.ip_network, texts)) if int(n[0]) <= point <= int(n[-1])]
    return max(best)[1] if best else None


@pytest.mark.parametrize("form", ["narrow", "wide"])
def test_effective_ranges_partition_the_space(spark, form):
    df = nets(spark, NESTED)
    out = I.effective_ranges(widened(df) if form == "wide" else df)
    rows = (narrowed(out) if form == "wide" else out).select("ip_start", "ip_end", "pid").orderBy("ip_start").collect()
    assert rows[0][0] == 0 and rows[-1][1] == 2**32 - 1
    for a, b in zip(rows, rows[1:]):
        assert a[1] + 1 == b[0]
    for s, e, pid in rows:
        assert owner(s, NESTED) == pid == owner(e, NESTED)
    assert 4 not in {r[2] for r in rows}  # both halves announced


def test_effective_ranges_at_the_top_of_ipv6(spark):
    rows = [(1, 6, 1, "8" + "0" * 31, "f" * 32), (2, 6, 128, "f" * 32, "f" * 32), (3, 6, 64, "f" * 16 + "0" * 16, "f" * 32)]
    df = spark.createDataFrame(rows, "pid bigint, family int, plen int, s string, e string").select(
        "pid", "family", "plen", addr.wide_from_hex("s").alias("ip_start"), addr.wide_from_hex("e").alias("ip_end"))
    got = sorted(tuple(r) for r in I.effective_ranges(df).select("pid", addr.wide_hex("ip_start"), addr.wide_hex("ip_end")).collect())
    assert got == [(1, "8" + "0" * 31, "f" * 15 + "e" + "f" * 16), (2, "f" * 32, "f" * 32), (3, "f" * 16 + "0" * 16, "f" * 31 + "e")]


def test_containment(spark):
    df = nets(spark, NESTED)
    ns = [ipaddress.ip_network(t) for t in NESTED]
    over = {i: sorted((j for j in range(len(ns)) if j != i and ns[i].subnet_of(ns[j])), key=lambda j: -ns[j].prefixlen) for i in range(len(ns))}
    near = {r.pid: r.parent_pid for r in C.nearest_parents(df).collect()}
    assert near == {i: o[0] for i, o in over.items() if o}
    got = {}
    for r in C.parents(df, 2).orderBy("ord").collect():
        got.setdefault(r.pid, []).append(r.parent_pid)
    assert got == {i: o[:2] for i, o in over.items() if o}
    kids = {}
    for r in C.children(df, 3).orderBy("ord").collect():
        kids.setdefault(r.pid, []).append(r.child_pid)
    want = {j: sorted((i for i in range(len(ns)) if j in over[i]), key=lambda i: (int(ns[i][0]), ns[i].prefixlen))[:3] for j in range(len(ns))}
    assert kids == {j: v for j, v in want.items() if v}


def test_longest_match(spark):
    asked = spark.createDataFrame([(4, int(ipaddress.ip_address(t)), t) for t in ["0.0.0.1", "10.128.0.1", "10.200.0.1", "255.255.255.255", "0.1.0.0", "0.1.0.0"]] + [(4, None, "bad")],
                                  "family int, ip bigint, t string")
    got = sorted((r.t, r.prefix) for r in C.longest_match(asked, nets(spark, NESTED[:-4]), ["prefix"]).collect())
    assert got == [("0.0.0.1", "0.0.0.0/24"), ("0.1.0.0", "0.0.0.0/9"), ("0.1.0.0", "0.0.0.0/9"), ("10.128.0.1", "10.128.0.0/10"), ("10.200.0.1", "10.128.0.0/9"), ("255.255.255.255", None), ("bad", None)]


# ---------------------------------------------------------------- intervals

def geo_brute(raw):
    reach, out = None, []
    for s, e, prio, tie in sorted(raw, key=lambda r: (r[0], -r[2], r[3])):
        if reach is None or e > reach:
            out.append((reach + 1 if reach is not None and s <= reach else s, e, tie))
        reach = e if reach is None else max(reach, e)
    return sorted(out)


@pytest.mark.parametrize("form", ["narrow", "wide"])
def test_resolve_overlaps_with_copies_and_a_hot_start(spark, form):
    rnd = random.Random(3)
    raw = [(s := rnd.randrange(300), s + rnd.randrange(40), rnd.choice([1, 2, 3]), i) for i in range(200)]
    raw += [(50, 50 + rnd.randrange(90), rnd.choice([2, 3]), 1000 + i) for i in range(100)] + [(60, 99, 3, 2000 + i) for i in range(50)]
    df = spark.createDataFrame([(4, *r) for r in raw], "family int, ip_start bigint, ip_end bigint, prio int, tie bigint").withColumn("who", F.col("tie"))
    out = I.resolve_overlaps(widened(df) if form == "wide" else df, ["who"])
    got = sorted(tuple(r) for r in (narrowed(out) if form == "wide" else out).select("ip_start", "ip_end", "who").collect())
    assert got == geo_brute(raw)


def test_union_and_equal_merge_are_idempotent(spark):
    iv = [(0, 5, "a"), (6, 9, "a"), (10, 12, "b"), (20, 22, None), (23, 30, None), (31, 33, "b"), (35, 40, "b")]
    df = spark.createDataFrame([(4, *r) for r in iv], "family int, ip_start bigint, ip_end bigint, cc string")
    once = I.merge_equal(df, ["cc"])
    pick = lambda d: sorted((r.ip_start, r.ip_end, r.cc) for r in d.collect())
    assert pick(once) == [(0, 9, "a"), (10, 12, "b"), (20, 30, None), (31, 33, "b"), (35, 40, "b")]
    assert pick(I.merge_equal(once, ["cc"])) == pick(once)
    u = I.union_intervals(df.unionByName(df.withColumn("ip_end", F.col("ip_end") - 1)))
    assert sorted((r.ip_start, r.ip_end) for r in u.collect()) == [(0, 12), (20, 33), (35, 40)]


def test_merge_at_the_end_of_ipv6(spark):
    rows = [(6, "f" * 31 + "0", "f" * 31 + "e", "x"), (6, "f" * 32, "f" * 32, "x")]
    df = spark.createDataFrame(rows, "family int, s string, e string, cc string").select("family", addr.wide_from_hex("s").alias("ip_start"), addr.wide_from_hex("e").alias("ip_end"), "cc")
    got = I.merge_equal(df, ["cc"]).select(addr.wide_hex("ip_start"), addr.wide_hex("ip_end")).collect()
    assert [tuple(r) for r in got] == [("f" * 31 + "0", "f" * 32)]


GEO = "family int, ip_start bigint, ip_end bigint, cc string, province string, city string"


def test_carve_cap_and_edges(spark):
    base = 10 << 24
    geo = [(4, base + 16 * i, base + 16 * i + 15, "C1", "P", f"c{i % 3}") for i in range(20)] + [(4, base + 400, base + 450, None, None, None), (4, base - 1000, base - 1, "C2", None, None)]
    g = spark.createDataFrame(geo, GEO)
    r = spark.createDataFrame([(1, 4, base, base + 500), (2, 4, base - 500, base - 1), (3, 4, base + 600, base + 700)], "pid bigint, family int, ip_start bigint, ip_end bigint")
    fine = I.carve(r, g, cap=256).collect()
    assert sum(x.ip_end - x.ip_start + 1 for x in fine if x.pid == 1) == 320 and {x.pid for x in fine} == {1, 2}
    assert sorted(map(tuple, I.carve(r, g).collect())) == sorted(map(tuple, fine))
    coarse = [x for x in I.carve(r, g, cap=20).collect() if x.pid == 1]
    assert [(x.ip_start, x.ip_end, x.cc, x.province, x.city) for x in coarse] == [(base, base + 500, "C1", None, None)]
    # The first address has no country: the busy range drops out.
    late = spark.createDataFrame(geo[1:], GEO)
    assert [x.pid for x in I.carve(r, late, cap=5).collect()] == [2]


def test_segments_list_is_cut_but_province_is_the_last(spark):
    base = 10 << 24
    geo = [(4, base + 2 * i, base + 2 * i, "C", f"P{i:03}", "town") for i in range(100)]
    p = nets(spark, ["10.0.0.0/24"]).withColumn("origin_asn", F.lit(1)).withColumn("n_paths", F.lit(2))
    whole, cut = (G.segments(p, spark.createDataFrame(geo, GEO), **how).collect() for how in ({}, {"cidr_cap": 48}))
    for r, n in ((whole, 100), (cut, 48)):
        assert len(r) == 1 and len(r[0].segs) == n and r[0].province == "P099" and r[0].segs[1] == "10.0.0.2/32"


def test_as_of_misses_and_last_address(spark):
    g = spark.createDataFrame([(4, 10, 20, "a"), (4, 30, 2**32 - 1, "b")], "family int, ip_start bigint, ip_end bigint, cc string")
    q = spark.createDataFrame([(4, p) for p in (5, 10, 20, 21, 30, 2**32 - 1, 10)] + [(4, None)], "family int, ip_start bigint")
    got = sorted((r.ip_start or -1, r.cc) for r in I.as_of(q, g, ["cc"]).collect())
    assert got == [(-1, None), (5, None), (10, "a"), (10, "a"), (20, "a"), (21, None), (30, "b"), (2**32 - 1, "b")]


def test_scan_carries_over_empty_and_hot_partitions(spark):
    rows = [(4, i // 3, i) for i in range(90)]
    df = spark.createDataFrame(rows, "family int, k bigint, v bigint").withColumn("m", F.when(F.col("v") % 40 == 0, F.col("v")))
    s = ordered.scan(ordered.pin(df, "k", "v", parts=7), ["k", "v"], ["family"], last=("last", F.col("m")), total=("sum", F.col("v")), high=("max_before", F.col("v")),
                     prev=("lag", F.col("v")), nxt=("lead", F.col("v"))).orderBy("v").collect()
    for i, r in enumerate(s):
        assert (r.last, r.total, r.high, r.prev, r.nxt) == (i // 40 * 40, i * (i + 1) // 2, i - 1 if i else None, i - 1 if i else None, i + 1 if i < 89 else None)


# ---------------------------------------------------------------- RIB

ENTRY = "collector string, family int, prefix string, plen int, ip_start bigint, ip_end bigint, asns array<bigint>"


def entry(prefix, asns, collector="c1"):
    n = ipaddress.ip_network(prefix)
    return (collector, 4, prefix, n.prefixlen, int(n[0]), int(n[-1]), asns)


def test_prefix_table_and_ties(spark):
    rows = [entry("10.0.0.0/8", [1, 2, 2, 3]), entry("10.0.0.0/8", [1, 2, 3], "c2"), entry("10.0.0.0/8", [1, 4]), entry("10.0.0.0/8", [5, 4]), entry("10.0.0.0/8", []),
            entry("1.0.0.0/24", [7, 9]), entry("1.0.0.0/24", [7, 8])]
    m = rib.distinct_paths(spark.createDataFrame(rows, ENTRY))
    assert sorted((r.prefix, r.path, r.n_peers) for r in m.collect()) == [("1.0.0.0/24", "7 8", 1), ("1.0.0.0/24", "7 9", 1), ("10.0.0.0/8", "1 2 3", 2), ("10.0.0.0/8", "1 4", 1), ("10.0.0.0/8", "5 4", 1)]
    p = {r.prefix: r for r in rib.with_pids(rib.prefix_dimension(m)).collect()}
    assert (p["1.0.0.0/24"].pid, p["10.0.0.0/8"].pid) == (1, 2)
    assert (p["10.0.0.0/8"].origin_asn, p["10.0.0.0/8"].n_origins, p["10.0.0.0/8"].n_paths, p["10.0.0.0/8"].n_distinct_paths) == (3, 2, 4, 3)
    assert p["1.0.0.0/24"].origin_asn == 8
    same = rib.merge_collectors(rib.observations(spark.createDataFrame(rows[::-1], ENTRY).repartition(3)))
    assert sorted(map(tuple, same.select(*m.columns).collect())) == sorted(map(tuple, m.collect()))


def test_path_cap_keeps_the_best(spark):
    rows = [entry("10.0.0.0/8", [i, 10_000 + i, 3] if i % 2 else [i, 3]) for i in range(1, 101)] + [entry("10.0.0.0/8", [50, 3])]
    m = rib.distinct_paths(spark.createDataFrame(rows, ENTRY)).withColumn("pid", F.lit(1))
    assert rib.ranked_paths(m).count() == 100
    r = rib.ranked_paths(m, 64).orderBy("rank").collect()
    assert len(r) == 64 and r[0].path == "50 3" and r[0].is_best and sum(x.path_len == 2 for x in r) == 50
    b = rib.paths_per_prefix(rib.ranked_paths(m, 64)).first()
    assert b.best_path == " 50 3 " and b.paths_blob.count("|") == 63


def adj_brute(paths):
    from routeloom.functions.fixed import TIER1
    out = {}
    for p in paths:
        first = next((i for i, x in enumerate(p) if x in TIER1), 10**9)
        for i, x in enumerate(p):
            for j, side in ((i + 1, "down"), (i - 1, "up")):
                if 0 <= j < len(p) and p[j] != x:
                    strong = first < i
                    k = {("down", True): "d", ("up", True): "u", ("up", False): "w", ("down", False): "wd"}[side, strong]
                    out.setdefault((x, p[j]), dict(d=0, u=0, w=0, wd=0))[k] += 1
    return out


def test_adjacency_equals_row_rule(spark):
    rnd = random.Random(5)
    paths = [[rnd.choice([1, 2, 3, 174, 1299, 9]) for _ in range(rnd.randrange(1, 6))] for _ in range(80)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "pid bigint, path_arr array<bigint>")
    got = {(r.asn, r.neighbor): dict(d=r.d, u=r.u, w=r.w, wd=r.wd) for r in A.adjacency(df).collect()}
    assert got == adj_brute(paths)


def test_relation_rules(spark):
    rows = [(174, 1299, 9, 0, 0, 0), (5, 174, 9, 0, 0, 0), (5, 6, 0, 0, 3, 2), (5, 6, 8, 2, 1, 1), (5, 6, 2, 8, 0, 0), (174, 6, 2, 8, 0, 0), (5, 6, 5, 5, 1, 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, asn bigint, neighbor bigint, d bigint, u bigint, w bigint, wd bigint")
    assert [(r.rel, r.n) for r in A.relation(df).orderBy("i").collect()] == [("peer", 9), ("up", 9), ("peer", 5), ("down", 10), ("up", 10), ("peer", 10), ("peer", 13)]


# ---------------------------------------------------------------- validation

def test_rpki_against_range_rule(spark):
    rnd = random.Random(7)
    def block():
        n = rnd.choice([8, 12, 16, 20, 24])
        s = (10 << 24 | rnd.getrandbits(10) << 14) >> (32 - n) << (32 - n)
        return s, n
    routes = [(i, 4, s, s + 2 ** (32 - n) - 1, n, rnd.randrange(3)) for i, (s, n) in enumerate(block() for _ in range(120))]
    vrps = [(4, s, n, min(32, n + rnd.randrange(-2, 5)), rnd.randrange(3)) for s, n in (block() for _ in range(60))] + [(4, 0, 0, 32, 1)] + [(4, 10 << 24, 8, 8, 0)] * 50
    r = spark.createDataFrame(routes, "pid bigint, family int, ip_start bigint, ip_end bigint, plen int, origin bigint")
    v = spark.createDataFrame(vrps, "family int, ip_start bigint, plen int, maxlen int, asn bigint")
    want = {}
    for pid, _, s, e, n, o in routes:
        cov = [(ml, a) for _, vs, vn, ml, a in vrps if vn and vs <= s and vs + 2 ** (32 - vn) - 1 >= e]
        if cov:
            want[pid] = 1 if any(a == o and n <= ml for ml, a in cov) else 3 if any(a == o for _, a in cov) else 2
    assert {x.pid: x.rpki for x in V.rpki_status(r, v).collect()} == want
    wide = V.rpki_status(widened(r), v.withColumn("ip_start", addr.wide_from_v4("ip_start")))
    assert {x.pid: x.rpki for x in wide.collect()} == want
    assert V.rpki_status(r, None).isEmpty() and V.irr_status(r, None).isEmpty()


# ---------------------------------------------------------------- sets, pages

def test_as_set_build_and_cycle(spark):
    rows = [("AS-A", "RADB", "old", ["AS9"], 0), ("AS-A", "RADB", "new", ["AS1", " as-b", "AS-X", ""], 1), ("AS-B", "ARIN", "d", ["AS-A", "as2"], 2), ("AS-B", "ZZZ", "d", ["AS3"], 3), ("AS-E", "RIPE", "e" * 300, [], 4)]
    t = AS.build(spark.createDataFrame(rows, "name string, source string, descr string, members array<string>, ord bigint"))
    sets = {r.set_key: (r.descr, r.n_members) for r in t["as_set"].collect()}
    assert sets["RADB::AS-A"] == ("new", 3) and len(sets["RIPE::AS-E"][0]) == 200 and sets["RIPE::AS-E"][1] == 0
    assert [(r.ord, r.kind, r.val) for r in AS.direct_members(t["as_set_member"], "RADB::AS-A").collect()] == [(0, "asn", "AS1"), (1, "set", "ARIN::AS-B"), (2, "set", "AS-X")]
    tree = AS.expand_tree(t["as_set_member"], t["as_set"], t["as_set"].where("set_key = 'RADB::AS-A'")).collect()
    flags = {(r.depth, r.val): (r.cycle, r.unresolved) for r in tree}
    assert flags == {(0, "RADB::AS-A"): (False, False), (1, "AS1"): (False, False), (1, "ARIN::AS-B"): (False, False), (1, "AS-X"): (False, True), (2, "RADB::AS-A"): (True, False), (2, "AS2"): (False, False)}
    cone = {(r.node, r.depth) for r in AS.expand_cone(t["as_set_member"], t["as_set"].where("set_key = 'RADB::AS-A'")).collect()}
    assert cone == {("RADB::AS-A", 0), ("AS1", 1), ("ARIN::AS-B", 1), ("AS-X", 1), ("AS2", 2)}


def test_pages_and_name_ranks(spark):
    df = spark.range(10).withColumnRenamed("id", "pid")
    p = S.page(df, [F.asc("pid")], 4, 1).collect()
    assert [r.pid for r in p] == [4, 5, 6, 7] and all(r.more for r in p)
    last = S.page(df, [F.asc("pid")], 4, 2).collect()
    assert [r.pid for r in last] == [8, 9] and not any(r.more for r in last)
    names = spark.createDataFrame([(1, "Foo"), (2, "x-foo"), (3, "xfoo"), (3, "Foobar"), (0, "foo"), (4, None)], "asn bigint, name string")
    assert [(r.asn, r.rank) for r in S.names_matching(names, "foo").orderBy("rank", "asn").collect()] == [(1, 0), (2, 1), (3, 1)]
    assert S.names_matching(names, " ").isEmpty()
    assert [S.low_cut(x) for x in (None, 1, 100)] == [3, 3, 20]


def test_suggestions_count_networks_beyond_the_displayed_ones(spark):
    from routeloom.operators import measure
    made = [("C1", "Town", f"Net{i:02d}", 100 + i, 1.0, 2.0) for i in range(15) for _ in range(20 - i)] + [("C1", "City", "Net14", 114, 1.0, 2.0)]
    probes = spark.createDataFrame(made, "country string, city string, network string, asn long, latitude double, longitude double")
    loc = measure.probe_locations(probes)
    assert {r["city"]: len(r["networks"]) for r in loc.collect()} == {"Town": 12, "City": 1}
    got = measure.suggestions(loc.withColumn("country", F.lit("Land")), "net14").collect()
    assert [(r["kind"], r["label"], r["n"]) for r in got] == [("network", "114", 7)]
