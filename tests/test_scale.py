"""Work that must spread over the cores, and steps whose cost or size must not outgrow the input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import q_mixed, q_records, q_text
from routeloom.functions import addr
from routeloom.operators import records as R, search as S
from routeloom.session import durable
from routeloom.sinks import publish as K
from routeloom.sources import rib_dump

from test_sources import as_path, peer_table, rib

SF = "/root/testdata/sf0.001"
PEERS = peer_table(("192.0.2.1", 64501, False), ("192.0.2.2", 64502, False))


def test_deep_documents_mention_each_level_once(spark):
    """The text of eleven levels was built by an expression that doubled at each."""
    docs = q_records._deep_docs(spark, SF)
    assert len(docs._jdf.queryExecution().analyzed().toString()) < 20_000
    got = {r["key"]: r["json"] for r in docs.where("key IN ('8', '9')").collect()}
    assert got["8"].count("handle") == 11 and got["9"] == '{"entities":[{"handle":"H9-0","roles":["noc"],"entities":[{"handle":"H9-1","roles":["noc"],"entities":[{"handle":"H9-2","roles":["noc"]}]}]}]}'


@pytest.mark.parametrize("rows", [q_records._deep_docs, q_records._whois, q_mixed._intervals, q_mixed._hop_docs, q_text._route_texts])
def test_rows_of_one_small_file_use_every_core(spark, rows):
    assert rows(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_whois_values_follow_the_field_that_the_fold_gives_them(spark):
    text = "Registered on:\n  2004.05.06\n\ncreated: REDACTED 2001-02-03\nRegistrant:\n  redacted\nNameservers\n ns1.x \n  ns2.x"
    got = R.parse_whois(spark.createDataFrame([("d", text)], "domain string, text string")).where("field <> 'ldhname'").collect()
    assert [(r["field"], r["value"]) for r in got] == [("registration", "2004-05-06"), ("registration", "2001-02-03"), ("ns", "ns1.x"), ("ns", "ns2.x")]


def test_ipv6_texts_and_groups(spark):
    texts = {"::": "::", "::1": "::1", "1::": "1::", "1:0:0:2:0:0:0:3": "1:0:0:2::3", "1:0:2:0:3:0:4:0": "1:0:2:0:3:0:4:0", "1:0:0:2:3:0:0:4": "1::2:3:0:0:4",
             "1::2::3": None, ":::": None, "1:2:3:4:5:6:7": None, ":1::2": None, "::ffff:1.2.3.4": "::ffff:102:304", "1.2.3.256": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["o"] for r in df.select("t", addr.wide_text(addr.cidr_bounds("t")["ip_start"]).alias("o")).collect()}
    assert got == texts


def test_small_dumps_share_batches_and_a_peer_table_is_one_row():
    one = PEERS + rib(2, bytes([10, 1, 0, 0]), 24, [(1, as_path((2, [5, 6])))])
    cells = pa.RecordBatch.from_pydict({"collector": ["c"] * 500, "path": [f"p{i}" for i in range(500)], "content": [one] * 500})
    batches = list(rib_dump._cut_cells([cells], frozenset((4,)), None))
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(batches) == 1 and len(rows) == 1500 and [r["family"] for r in rows[:3]] == [0, 4, rib_dump.STATUS]
    peers = list(rib_dump._decode_peers([pa.RecordBatch.from_pylist([r for r in rows if r["family"] == 0], schema=batches[0].schema)]))
    assert sum(b.num_rows for b in peers) == 500 and [p["peer_asn"] for p in peers[0].to_pylist()[0]["peers"]] == [64501, 64502]


def test_peers_join_alike_when_they_are_few_and_many(spark, monkeypatch):
    one = PEERS + rib(2, bytes([10, 1, 0, 0]), 24, [(1, as_path((2, [5, 6]))), (9, as_path((2, [7])))])
    framed = durable(rib_dump.frames(spark.createDataFrame([(f"p{i}", one) for i in range(5)], "path string, content binary")))
    read = lambda: sorted(map(str, rib_dump.entries_from_frames(framed).select("file", "peer_asn", "peer_ip", "asns").collect()))
    few = read()
    monkeypatch.setattr(rib_dump, "FEW_PEERS", 0)
    assert read() == few and len(few) == 10 and sum("64502" in r for r in few) == 5 and sum("None" in r for r in few) == 5


def test_published_stretches_grow_with_what_a_table_is_made_from(spark, tmp_path, monkeypatch):
    rows = durable(spark.range(20_000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("t")))
    size = K.stored_bytes(rows)
    assert size > 400_000 and K.stretches(rows, 2) == 2
    monkeypatch.setattr(K, "STRETCH", size // 10)
    K.write_sorted(rows, str(tmp_path / "out"), ["id"], parts=2)
    files = spark.read.parquet(str(tmp_path / "out"))
    assert K.stretches(rows, 2) >= 10 and len(files.inputFiles()) >= 10 and files.count() == 20_000


def test_search_table_joins_codes_before_the_blobs(spark):
    prefixes = spark.createDataFrame([(1, 4, "10.0.0.0/8", 8, 5, 2, 3), (2, 4, "11.0.0.0/8", 8, 7, 1, 1)], "pid bigint, family int, prefix string, plen int, origin_asn bigint, n_origins bigint, n_paths bigint")
    seen = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 7)], "pid bigint, origin_asn bigint")
    blobs = spark.createDataFrame([(1, ["a", "b"], "a|b", "a")], "pid bigint, paths array<string>, paths_blob string, best_path string")
    codes = spark.createDataFrame([(1, 6, 2, 1)], "pid bigint, origin_asn bigint, rpki int, irr int")
    t = S.search_table(prefixes, seen, blobs, codes)
    assert t.columns == ["pid", "origin_asn", "family", "prefix", "plen", "n_origins", "n_paths", "cc", "province", "city", "paths", "paths_blob", "best_path", "rpki", "irr", "is_primary"]
    got = sorted((r["pid"], r["origin_asn"], r["paths_blob"], r["rpki"], r["irr"], r["is_primary"]) for r in t.collect())
    assert got == [(1, 5, "a|b", 0, 0, True), (1, 6, "a|b", 2, 1, False), (2, 7, None, 0, 0, True)]
    plan = S.search_table(prefixes, seen, blobs, codes)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "Join" in x]
    # The join with the blobs is the uppermost one.
    assert "pid" in lines[0] and "origin_asn" not in lines[0].split("Join")[1]


def test_columns_that_follow_from_others_are_written_and_not_shuffled(spark, tmp_path):
    rows = durable(spark.range(4000).select("id", F.array(*[F.concat(F.lit(" "), F.md5((F.col("id") * 7 + i).cast("string").cast("binary")), F.lit(" ")) for i in range(9)]).alias("paths"))
                   .withColumns({"paths_blob": F.array_join("paths", "|"), "best_path": F.get("paths", F.lit(0)), "n": F.col("id") % 3}))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, None, None, 0), (-2, [], "", None, 0)], rows.schema))
    out = str(tmp_path / "out")
    K.write_sorted(rows, out, ["n", "id"], parts=3, derived=S.follow_from_paths())
    back = spark.read.parquet(out)
    assert back.columns == rows.columns and back.count() == 4002 and rows.exceptAll(back).count() == 0 and back.exceptAll(rows).count() == 0
    assert all(".zstd." in f for f in back.inputFiles())
