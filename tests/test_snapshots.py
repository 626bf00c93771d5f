"""Segments by row, deep entities, snapshot contents and facts, refresh by pointer."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.operators import containment as C, geo as G, records as R, search as S
from routeloom.plans import snapshot
from routeloom.sinks import publish as K
from routeloom.sources import rib_dump
from routeloom.streaming import refresh

from test_sources import as_path, dump, peer_table, rib


def both_families(spark):
    p = spark.createDataFrame([(0, "10.0.0.0/22"), (1, "10.0.1.0/24"), (2, "2001:db8::/32"), (3, "2001:db8:1::/48")], "pid int, n string").withColumn("b", addr.cidr_bounds("n")).select("pid", F.col("n").alias("prefix"), "b.*")
    geo = spark.createDataFrame([("10.0.0.0/23", "DE", "a"), ("10.0.2.0/25", "DE", "a"), ("2001:db8::/33", "FR", "y"), ("2001:db8:8000::/34", "FR", "y")], "n string, cc string, city string").select(
        addr.cidr_bounds("n").alias("b"), "cc", "city").select("b.family", "b.ip_start", "b.ip_end", "cc", F.concat("city", F.lit("-p")).alias("province"), "city")
    return p, geo


def test_segment_rows_are_the_segments_lists(spark):
    p, geo = both_families(spark)
    lists = {(r.pid, r.cc, r.city): r.segs for r in G.segments(p, geo).collect()}
    rows = {}
    for r in G.segment_rows(p, geo).orderBy("pid", "at").collect():
        rows.setdefault((r.pid, r.cc, r.city), []).append(r.cidr)
    assert rows.keys() == lists.keys() and all(sorted(rows[k]) == sorted(lists[k]) for k in rows)
    assert lists[(1, "DE", "a")] == ["10.0.1.0/24"] and lists[(0, "DE", "a")] == ["10.0.0.0/24", "10.0.2.0/25"]
    plan = G.segments(p, geo)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("collect_list") == 1


def test_entities_of_any_depth_from_one_parse(spark):
    doc = {"handle": "E8", "roles": ["noc"], "vcardArray": ["vcard", [["fn", {}, "text", "deep"], ["adr", {"label": "x\ny"}, "text", ["", ""]]]]}
    for i in range(7, -1, -1):
        doc = {"handle": f"E{i}", "entities": [doc, {"handle": f"S{i}", "roles": None}]}
    d = spark.createDataFrame([("ip", "a", json.dumps({"entities": [doc]})), ("ip", "b", "{}"), ("ip", "c", "not json"), ("ip", "d", None)], "kind string, key string, json string")
    out = R.rdap_entities(R.parse_rdap(d))
    got = {r.handle: (r.depth, tuple(r.trail), r.name) for r in out.collect()}
    assert got["E8"] == (8, (0,) * 9, "deep") and got["S7"] == (8, (0,) * 8 + (1,), "S7") and len(got) == 17
    assert [(x.field, x.value) for x in out.where("handle = 'E8'").first().rows] == [("fullname", "deep"), ("address", "x, y")]
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()  # nothing is parsed again
    assert R.rdap_entities(R.parse_rdap(d.limit(0))).count() == 0


def test_contents_do_not_depend_on_files_and_see_every_row(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, concat('v', id)) AS v", "array(id, id + 1) AS a")
    df.repartition(1).write.parquet(str(tmp_path / "one"))
    df.repartition(7).write.parquet(str(tmp_path / "many"))
    df.withColumn("v", F.when(F.col("id") == 499, "other").otherwise(F.col("v"))).write.parquet(str(tmp_path / "changed"))
    df.unionByName(df.limit(1)).write.parquet(str(tmp_path / "more"))
    df.limit(0).write.parquet(str(tmp_path / "none"))
    got = {r.dataset: (r.rows, r.hash) for r in K.contents(spark, {n: str(tmp_path / n) for n in ("one", "many", "changed", "more", "none")}).collect()}
    assert got["one"] == got["many"] and len({got[n][1] for n in ("one", "changed", "more", "none")}) == 4 and got["none"][0] == 0


def test_facts_tell_what_was_given(spark):
    p = spark.createDataFrame([(4, 5), (6, 7)], "family int, n_paths long")
    entries = spark.createDataFrame([("b",), ("a",)], "collector string")
    reference = spark.createDataFrame([(4, 12), (6, 3)], "family int, dfz_ref long")
    bare = {(r.topic, r.name): r.value for r in snapshot.facts(snapshot.Inputs(entries), p, reference).collect()}
    assert bare == {("scope", "families"): "4,6", ("scope", "collectors"): "a,b", ("dfz_ref", "4"): "12", ("dfz_ref", "6"): "3"}
    irr = spark.createDataFrame([("RADB",), ("RIPE",), ("RADB",)], "source string")
    full = {(r.topic, r.name): r.value for r in snapshot.facts(snapshot.Inputs(entries, irr=irr, as_of={"irr": "today"}), p, reference).collect()}
    assert full.items() >= {("irr", "count"): "3", ("irr", "sources"): "RADB,RIPE", ("irr", "as_of"): "today"}.items()


def one_dump(net, torn=False):
    blob = gzip.compress(peer_table(("192.0.2.1", 64501, True)) + b"".join(rib(2, bytes([net, i, 0, 0]), 16, [(0, as_path((2, [1, net])))]) for i in range(3)))
    return blob[:-9] if torn else blob


def test_refresh_swaps_by_pointer_and_passes_over_torn_dumps(spark, tmp_path, monkeypatch):
    source, store = tmp_path / "in", refresh.SnapshotFolder(spark, str(tmp_path / "out"), keep=2)
    for c, net in (("a", 20), ("b", 30)):
        (source / c).mkdir(parents=True)
        (source / c / "1.gz").write_bytes(one_dump(net))
    read, real = [], rib_dump.dump_frames
    monkeypatch.setattr(rib_dump, "dump_frames", lambda spark, dumps, *how: read.append(sorted(p.rsplit("/", 2)[1] + "/" + p.rsplit("/", 1)[1] for ps in dumps.values() for p in ps)) or real(spark, dumps, *how))
    build = lambda e, folder: e.select("collector", "prefix").write.parquet(folder)
    run = lambda: refresh.refresh(spark, str(source), store, build)
    assert store.current() is None
    first = run()
    assert store.current()[0] == first and run() is None and read == [["a/1.gz", "b/1.gz"]]
    (source / "b" / "2.gz").write_bytes(one_dump(31, torn=True))
    assert run() is None or store.current()[1] == [x for x in store.current()[1] if not x[1].endswith("2.gz")]
    (source / "b" / "3.gz").write_bytes(one_dump(32))
    last = run()
    assert sorted(r.prefix for r in spark.read.parquet(last).collect()) == sorted([f"20.{i}.0.0/16" for i in range(3)] + [f"32.{i}.0.0/16" for i in range(3)])
    assert read[-1] == ["a/1.gz", "b/3.gz"] and len([n for n in (tmp_path / "out").iterdir() if n.name.startswith("v=")]) <= 2


def test_a_build_that_fails_leaves_the_pointer(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "1.mrt").write_bytes(dump())
    store = refresh.SnapshotFolder(spark, str(tmp_path / "out"))

    def broken(entries, folder):
        raise OSError("disk")

    with pytest.raises(OSError):
        refresh.refresh(spark, str(tmp_path / "in"), store, broken)
    assert store.current() is None


def test_reports_are_whole_unless_cut(spark):
    nets = ["10.0.0.0/8"] + [f"10.{i}.0.0/16" for i in range(80)]
    p = spark.createDataFrame(list(enumerate(nets)), "pid int, n string").withColumn("b", addr.cidr_bounds("n")).select("pid", F.col("n").alias("prefix"), "b.*")
    assert C.children(p).count() == 80 and C.children(p, 5).count() == 5 and C.parents(p).count() == 80
    t = spark.range(500).selectExpr("1 AS origin_asn", "id AS pid", "id % 9 AS n_paths")
    assert S.asn_prefixes(t).count() == 500 and [r.pid for r in S.asn_prefixes(t, 2).orderBy("ord").collect()] == [8, 17]
    names = spark.range(300).selectExpr("id + 1 AS asn", "concat('net ', id) AS name")
    assert S.names_matching(names, "net").count() == 300 and S.names_matching(names, "net", 10).where("more").count() == 10
