"""Readers, sinks and incremental state on hand-made files."""

import bz2
import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.operators import measure as M, owners as OW, records as R
from routeloom.plans import snapshot
from routeloom.sinks import publish as K
from routeloom.sources import rib_dump, rpsl, tables
from routeloom.streaming import delta as D, measurements as SM, refresh


# ---------------------------------------------------------------- RIB dumps

def record(sub, body, kind=13):
    return struct.pack(">IHHI", 0, kind, sub, len(body)) + body


def peer_table(*peers):
    out = b"\0\0\0\1" + struct.pack(">H", 3) + b"abc" + struct.pack(">H", len(peers))
    for ip, asn, wide in peers:
        v6 = ":" in ip
        import socket
        out += bytes([(1 if v6 else 0) | (2 if wide else 0)]) + b"\0\0\0\0" + socket.inet_pton(socket.AF_INET6 if v6 else socket.AF_INET, ip)
        out += struct.pack(">I" if wide else ">H", asn)
    return record(1, out)


def as_path(*segments, extended=False):
    value = b"".join(bytes([kind, len(a)]) + struct.pack(f">{len(a)}I", *a) for kind, a in segments)
    head = bytes([0x50, 2]) + struct.pack(">H", len(value)) if extended else bytes([0x40, 2, len(value)])
    return bytes([0x40, 1, 1, 0]) + head + value


def rib(sub, net, plen, entries, addpath=False):
    out = b"\0\0\0\0" + bytes([plen]) + net[:(plen + 7) // 8] + struct.pack(">H", len(entries))
    for peer, attrs in entries:
        out += struct.pack(">H", peer) + (b"\0\0\0\7" if addpath else b"") + b"\0\0\0\0" + struct.pack(">H", len(attrs)) + attrs
    return record(sub, out)


def dump():
    return (peer_table(("192.0.2.1", 64501, False), ("2001:db8::1", 4200000001, True))
            + rib(2, bytes([10, 1, 0, 0]), 16, [(0, as_path((2, [1, 2, 2, 3]))), (1, as_path((2, [1]), (1, [7, 8]), extended=True)), (1, b""), (9, as_path((2, [5])))])
            + rib(2, b"", 0, [(0, as_path((2, [1])))])
            + rib(2, bytes([10, 1, 255]), 20, [(0, as_path((2, [4])))])
            + record(3, b"\0" * 9) + record(2, b"zz", kind=12)
            + rib(4, bytes.fromhex("20010db8"), 32, [(1, as_path((2, [9])))])
            + rib(8, bytes([11]), 8, [(0, as_path((2, [6]))), (0, as_path((2, [6])))], addpath=True)
            + rib(10, bytes.fromhex("20010db80001"), 48, [(0, as_path((2, [3])))], addpath=True))


@pytest.mark.parametrize("ending", ["plain", "gz", "bz2", "gz-torn", "two-members"])
def test_rib_dump(spark, tmp_path, ending):
    raw = dump()
    extra = rib(2, bytes([12, 0]), 16, [(0, as_path((2, [8])))])
    blob = {"plain": raw + extra[:-3], "gz": gzip.compress(raw), "bz2": bz2.compress(raw), "gz-torn": gzip.compress(raw + extra * 50000)[:-30],
            "two-members": gzip.compress(raw[:100]) + gzip.compress(raw[100:])}[ending]
    path = tmp_path / f"rrc01.{'gz' if ending.startswith(('gz', 'two')) else 'bz2' if ending == 'bz2' else 'mrt'}"
    path.write_bytes(blob)
    rows = rib_dump.read_rib(spark, {"rrc01": str(path)}).where("prefix != '12.0.0.0/16'").collect()
    got = sorted((r.prefix, r.peer_asn or 0, r.peer_ip or "", tuple(r.asns)) for r in rows)
    assert got == sorted([("10.1.0.0/16", 64501, "192.0.2.1", (1, 2, 2, 3)), ("10.1.0.0/16", 4200000001, "2001:db8::1", (1, 7, 8)), ("10.1.0.0/16", 0, "", (5,)),
                          ("10.1.240.0/20", 64501, "192.0.2.1", (4,)), ("2001:db8::/32", 4200000001, "2001:db8::1", (9,)), ("11.0.0.0/8", 64501, "192.0.2.1", (6,)),
                          ("11.0.0.0/8", 64501, "192.0.2.1", (6,)), ("2001:db8:1::/48", 64501, "192.0.2.1", (3,))])
    assert {r.collector for r in rows} == {"rrc01"}


def test_rib_filters(spark, tmp_path):
    for c in ("a", "b"):
        (tmp_path / f"{c}.mrt").write_bytes(dump())
    both = {c: str(tmp_path / f"{c}.mrt") for c in ("a", "b")}
    assert {r.family for r in rib_dump.read_rib(spark, both, family=6).collect()} == {6}
    two = rib_dump.read_rib(spark, both, limit=2).select("collector", "prefix").distinct().collect()
    assert sorted(map(tuple, two)) == [(c, p) for c in ("a", "b") for p in ("10.1.0.0/16", "10.1.240.0/20")]


def test_cut_path_keeps_what_was_read():
    value = bytes([2, 3]) + struct.pack(">2I", 5, 6)
    assert rib_dump._as_path(bytes([0x40, 2, len(value)]) + value) == ([5, 6], True)
    assert rib_dump._as_path(bytes([0x40, 1])) == ([], False)


def test_refresh_reads_each_dump_once(spark, tmp_path):
    src, out = tmp_path / "in" / "rrc06", tmp_path / "out"
    src.mkdir(parents=True)
    (src / "one.mrt").write_bytes(dump())
    seen = []

    def rebuild(entries, batch):
        seen.append(batch)
        entries.write.mode("overwrite").parquet(str(out))

    for _ in range(2):
        refresh.refresh_on_new_dumps(spark, str(tmp_path / "in"), str(tmp_path / "ckpt"), rebuild).awaitTermination()
    assert len(seen) == 1
    first = spark.read.parquet(str(out)).count()
    assert {r.collector for r in spark.read.parquet(str(out)).collect()} == {"rrc06"}
    # A collector that comes later joins the one that is there.
    (tmp_path / "in" / "rrc01").mkdir()
    (tmp_path / "in" / "rrc01" / "two.mrt").write_bytes(dump())
    refresh.refresh_on_new_dumps(spark, str(tmp_path / "in"), str(tmp_path / "ckpt"), rebuild).awaitTermination()
    got = spark.read.parquet(str(out))
    assert len(seen) == 2 and got.count() == 2 * first and {r.collector for r in got.collect()} == {"rrc01", "rrc06"}


# ---------------------------------------------------------------- registry texts

RPSL = """% banner
route:      10.1.2.3/16   # host bits
descr:      first
            second
+third
\tfourth
origin:     AS65001 # c
origin:     AS1
source:     ripe # x
junk line

route6: 2001:DB8::/32
ORIGIN: as7
   \t
route: 10.0.0.0/99
origin: AS1

route: 10.0.0.0/8

as-set: as-foo
members: AS1, as-bar AS2 # AS3
mp-members: AS9
members: AS4
descr: One
descr: Two

route: 10.2.0.0/16
origin: AS3"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rpsl_dump(spark, tmp_path, end):
    f = tmp_path / "x.db"
    f.write_bytes(RPSL.replace("\n", end).encode("latin-1") + (end * 2).encode() + "route: 10.3.0.0/16\norigin: AS4\nsource: caf\xe9".replace("\n", end).encode("latin-1"))
    objs = rpsl.read_objects(spark, str(f), end)
    r = rpsl.routes(objs, "RADB").select(addr.network_text("family", "ip_start", "plen").alias("p"), "origin", "source").collect()
    assert sorted(map(tuple, r)) == [("10.1.0.0/16", 65001, "RIPE"), ("10.2.0.0/16", 3, "RADB"), ("10.3.0.0/16", 4, "CAFÉ"), ("2001:db8::/32", 7, "RADB")]
    s = rpsl.as_sets(objs, "RADB").collect()
    assert [(x.name, x.source, x.descr, x.members) for x in s] == [("AS-FOO", "RADB", "One", ["AS1", "as-bar", "AS2", "AS4"])]
    a = objs.where(F.contains("object", F.lit("first"))).select(rpsl.attributes("object").alias("a")).first().a
    assert [(x.key, x.value) for x in a][:3] == [("route", "10.1.2.3/16   # host bits"), ("descr", "first second +third fourth"), ("origin", "AS65001 # c")]


def test_registry_directory(spark, tmp_path):
    d = tmp_path / "route"
    d.mkdir()
    (d / "172.20.0.0_14").write_text("route: 172.20.0.0/14\n\norigin: AS4242420001\norigin: AS4242420002\nmax-length: 24\nremarks: a\n+ b\n+\n c\n")
    (d / "fd00%3A%3A_8").write_text("route6: fd00::/8\norigin: AS1\nmax-length: zz\n")
    o = rpsl.read_files(spark, str(d), "route")
    assert {r.name for r in o.collect()} == {"172.20.0.0_14", "fd00::_8"}
    assert o.where(F.col("name").startswith("172")).select(OW.first_of("remarks")).first()[0] == "a b c"
    assert sorted(r.origin for r in rpsl.registry_routes(o).where("family = 4").collect()) == [4242420001, 4242420002]
    assert sorted((r.plen, r.maxlen, r.asn) for r in rpsl.registry_vrps(o).collect()) == [(14, 24, 4242420001), (14, 24, 4242420002)]


def test_roas(spark, tmp_path):
    doc = {"metadata": {"buildtime": "2026-06-04T00:35:49Z"}, "roas": [
        {"prefix": "10.0.0.1/8", "asn": "AS1", "maxLength": 24}, {"prefix": "10.0.0.0/9", "asn": 2}, {"prefix": "10.0.0.0/10", "asn": "as3", "maxLength": 0}, {"prefix": "2001:db8::/32", "asn": "4", "maxLength": 31},
        {"prefix": "bad", "asn": 5}, {"prefix": "10.0.0.0/8", "asn": "ASx"}, {"asn": 1}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    r = tables.read_roas(spark, str(tmp_path / "r.json")).collect()
    assert sorted((x.plen, x.maxlen, x.asn) for x in r) == [(8, 24, 1), (9, 9, 2), (10, 10, 3), (32, 31, 4)]
    assert {str(x.as_of) for x in r} == {"2026-06-04 00:35:49"}


def test_asn_registry_and_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# head\n# more\nasn,name,name_en,op\n# part\n4809,电信CN2,,电信\nAS1,x,,\n 13335 ,Cloud,Flare,IDC\n")
    assert sorted((r.asn, r.name, r.name_en, r.op) for r in tables.read_asn_registry(spark, str(tmp_path / "r.csv")).collect()) == [(4809, "电信CN2", None, "电信"), (13335, "Cloud", "Flare", "IDC")]
    lines = spark.createDataFrame([("  1 LVLT-1 - Level 3, Inc., US",), ("x y",), ("3",), ("4 " + "z" * 60 + ", DE",), ("5  - no handle, US",)], "line string")
    got = {r.asn: r.name for r in tables.asn_name_rows(lines).collect()}
    assert got[1] == "LVLT-1" and got[4] == "z" * 40 and 3 not in got


# ---------------------------------------------------------------- feeds

def feed(*ops, end=True):
    body = "".join(f"{op} {serial}\n\nroute: {net}\norigin: AS{o}\nsource: RADB\n\n" for op, serial, net, o in ops)
    return "%START Version: 3 RADB 1-9\n\n" + body + ("%END RADB\n" if end else "")


def test_delta_rules(spark):
    assert D.can_apply(5, 1, 9) and not D.can_apply(None, 1, 9) and not D.can_apply(5, 6, 9) and D.can_apply(5, 1, 40000) and not D.can_apply(5, 1, 40000, 30000)
    one = lambda t: spark.createDataFrame([(t,)], "text string")
    assert D.delta_operations(one(feed(("ADD", 1, "10.0.0.0/8", 1), end=False))).isEmpty()
    ops = D.delta_operations(one(feed(("ADD", 1, "10.0.0.0/8", 1), ("DEL", 2, "10.0.0.0/8", 1), ("ADD", 3, "10.0.0.0/8", 1), ("DEL", 4, "11.0.0.0/8", 9), ("del", 5, "12.0.0.0/8", 2), ("ADD", 6, "bad", 2))))
    assert [(r.op, r.serial) for r in ops.orderBy("ord").collect()] == [("ADD", 1), ("DEL", 2), ("ADD", 3), ("DEL", 4), ("DEL", 5)]
    state = rpsl.routes(spark.createDataFrame([("route: 12.0.0.0/8\norigin: AS2",), ("route: 12.0.0.0/8\norigin: AS3",)], "object string"), "RADB")
    net = addr.network_text("family", "ip_start", "plen")
    assert sorted(map(tuple, D.apply_delta(state, ops).select(net, "origin").collect())) == [("10.0.0.0/8", 1), ("12.0.0.0/8", 3)]
    assert sorted(map(tuple, D.changes(state, ops).select(net, "op").collect())) == [("10.0.0.0/8", "ADD"), ("12.0.0.0/8", "DEL")]


def test_delta_stream(spark, tmp_path):
    f = D.DeltaFeed(spark, str(tmp_path / "state"))
    assert f.serial() is None
    f.publish(rpsl.routes(spark.createDataFrame([("route: 12.0.0.0/8\norigin: AS2",)], "object string"), "RADB"), 10)
    src = tmp_path / "feed"
    src.mkdir()
    (src / "1.txt").write_text(feed(("ADD", 11, "10.0.0.0/8", 1), ("DEL", 12, "12.0.0.0/8", 2)))
    f.stream(str(src), str(tmp_path / "ckpt")).awaitTermination()
    (src / "2.txt").write_text(feed(("ADD", 13, "13.0.0.0/8", 3), end=False))
    f.stream(str(src), str(tmp_path / "ckpt")).awaitTermination()
    assert f.serial() == 12 and [r.origin for r in f.state().collect()] == [1]
    one = lambda t: spark.createDataFrame([(t,)], "text string")
    other = "%START Version: 3 RADB 13-15\n\nADD 13\n\nmntner: M\nsource: RADB\n\nADD\n\nroute: 14.0.0.0/8\norigin: AS4\nsource: RADB\n\nADD 15\n\nmntner: N\nsource: RADB\n\n%END\n"
    assert f.apply_batch(one(other)) and f.serial() == 15 and sorted(r.origin for r in f.state().collect()) == [1, 4]
    assert not f.apply_batch(one(other))
    with pytest.raises(RuntimeError):
        f.apply_batch(one("%START\n\nADD\n\nroute: 15.0.0.0/8\norigin: AS4\n\n%END\n"))
    with pytest.raises(RuntimeError):
        f.apply_batch(spark.createDataFrame([(feed(("ADD", 99, "10.0.0.0/8", 1)),)], "text string"))


def test_round_and_hop_streams_survive_replay(spark, tmp_path):
    src = tmp_path / "rounds"
    rows = [("p", 1, "finished", 3, 3, 0, 1.0, 9.0, 4.0), ("p", 2, "in-progress", 1, 1, 0, 0.5, 0.5, 0.5), ("p", 2, "finished", 3, 1, 2, 2.0, 2.0, 2.0), ("q", 1, "failed", 3, 0, 3, None, None, None)]
    df = spark.createDataFrame(rows, "probe string, round int, status string, total bigint, rcv bigint, drop bigint, min double, max double, avg double")
    df.coalesce(1).write.mode("append").parquet(str(src))
    out = tmp_path / "out"

    def run():
        s = spark.readStream.schema(df.schema).parquet(str(src))
        (SM.running_ping(s).writeStream.outputMode("complete").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(str(out)))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()).awaitTermination()
        return {r.probe: (r.min, r.max, r.avg, r.total, r.rcv, r.drop, r.loss) for r in spark.read.parquet(str(out)).collect()}

    first = run()
    assert first == {"p": (1.0, 9.0, 3.5, 6, 4, 2, 33.333), "q": (None, None, 0.0, 3, 0, 3, 100.0)}
    df.coalesce(1).write.mode("append").parquet(str(src))
    assert run() == first


# ---------------------------------------------------------------- records

def test_whois_lines(spark):
    text = "\n".join(["% note", "Registrant:", "  ACME", "  street", "Nameservers", "  ns1.x", "  ns2.x", "", "  ns3.x", "Name Servers:", "  a.b", "Registrar: x", "  y",
                      "registrar abuse contact email: q@q", "ns_name_01: n.n", "Expires: see registry", "Status: ok", "Status: ok", "Created on......: 2011.01.18", "Country:  ", "# c", "  FR"])
    rows = R.parse_whois(spark.createDataFrame([("d", text)], "domain string, text string")).orderBy("ord").collect()
    assert [(r.field, r.value) for r in rows] == [
        ("ldhname", "d"), ("org", "ACME"), ("ns", "ns1.x"), ("ns", "ns2.x"), ("ns", "a.b"), ("registrar", "x"), ("email", "q@q"), ("ns", "n.n"), ("status", "ok"), ("registration", "2011-01-18")]


def test_hop_rows(spark):
    stats = lambda **k: {"min": 1.26, "avg": 2.0, "max": 3.0, "total": 3, "rcv": 3, "drop": 0, "loss": 0.5, **k}
    doc = {"results": [{"probe": {"city": "X"}, "result": {"status": "finished", "resolvedAddress": "9.9.9.9", "hops": [
        {"resolvedAddress": "10.0.0.1", "timings": [{"rtt": 2.0}, {"rtt": 1.04}]}, {"resolvedAddress": None}, {"resolvedAddress": "8.8.8.8", "asn": [15169], "stats": stats()},
        {"resolvedAddress": "9.9.9.9", "timings": []}]}}]}
    docs = spark.createDataFrame([("m", "mtr", "t", json.dumps(doc))], "measurement string, type string, target string, json string")
    h = M.hops(M.parse_results(docs)).orderBy("ttl").collect()
    assert [(r.ttl, r.ip, r.hop_asn, r.rtt, r.loss, r.is_target) for r in h] == [
        (1, "10.0.0.1", None, 1.0, 0, False), (3, "8.8.8.8", 15169, 1.3, 1, False), (4, "9.9.9.9", None, None, 0, True)]


# ---------------------------------------------------------------- sinks

def test_sorted_output_and_zones(spark, tmp_path):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).repartition(5)
    out = str(tmp_path / "t")
    K.write_sorted(df, out, ["k", "id"], rows_per_file=90, parts=6)
    z = K.zone_map(spark, out, "id").collect()
    assert len(z) > 11
    hit = K.files_for(K.zone_map(spark, out, "k"), 7).select("file").collect()
    assert 0 < len(hit) < len(z) and tables.read_shards(spark, [r.file for r in hit]).where("k = 7").count() == 335
    listed = K.file_list(spark, out)
    K.require_complete(listed, listed)
    with pytest.raises(RuntimeError):
        K.require_complete(listed.unionByName(spark.createDataFrame([("gone.parquet", 1)], "file string, length bigint")), listed)
    with pytest.raises(RuntimeError):
        K.require_complete(listed.limit(0), listed)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', None), ("n\nl", "p", "q")], "x string, y string, z string")
    assert [r.line for r in K.csv_lines(df).collect()] == ['"a,b","say ""x""",', '"n\nl",p,q']
    assert K.csv_text(df, 1) == '﻿x,y,z\n"a,b","say ""x""",\n'
    K.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_snapshot_of_both_families(spark, tmp_path):
    (tmp_path / "d.mrt").write_bytes(dump())
    e = rib_dump.read_rib(spark, {"rrc01": str(tmp_path / "d.mrt")})
    geo = spark.createDataFrame([("10.1.0.0/17", "DE", "x"), ("2001:db8::/33", "FR", "y")], "n string, cc string, city string").select(
        addr.cidr_bounds("n").alias("b"), "cc", "city").select("b.family", "b.ip_start", "b.ip_end", "cc", F.lit(None).cast("string").alias("province"), "city")
    t = snapshot.build(snapshot.Inputs(e, geo=geo))
    doc = snapshot.publish(t, str(tmp_path / "out"), stamp=7, parts=2).first()
    assert len(doc.version) == 12 and doc.has_geo == "true" and doc.has_irr == "false"
    p = {r.prefix: r for r in snapshot.read_published(spark, str(tmp_path / "out"), "prefixes").collect()}
    assert (p["10.1.0.0/16"].cc, p["2001:db8::/32"].cc, p["11.0.0.0/8"].cc) == ("DE", "FR", "ZZ")
    assert p["10.1.0.0/16"].n_origins == 3 and p["10.1.0.0/16"].origin_asns == [3, 5, 8]
    s = {(r.prefix, r.cc): r.segs for r in snapshot.read_published(spark, str(tmp_path / "out"), "geo").collect()}
    assert s[("10.1.0.0/16", "DE")] == ["10.1.0.0/17"]
    assert s[("2001:db8::/32", "FR")][0] == "2001:db8::/48" and s[("2001:db8:1::/48", "FR")] == ["2001:db8:1::/48"]
