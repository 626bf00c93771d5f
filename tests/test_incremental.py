"""Base and deltas, and streams with bounded state."""

import os
import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.sources import rpsl
from routeloom.streaming import delta as D, measurements as SM

from test_sources import feed


def texts(spark, *ts):
    return spark.createDataFrame([(t,) for t in ts], "text string")


def rows(spark, *nets):
    return rpsl.routes(spark.createDataFrame([(f"route: {n}\norigin: AS{o}",) for n, o in nets], "object string"), "RADB")


def held(f, **how):
    return sorted((r.n, r.origin) for r in f.state(**how).select(addr.network_text("family", "ip_start", "plen").alias("n"), "origin").collect())


def versions(f, kind):
    top = f"{f.folder}/{kind}"
    return sorted(int(n[2:]) for n in os.listdir(top) if n.startswith("v=")) if os.path.isdir(top) else []


@pytest.fixture
def store(spark, tmp_path):
    f = D.DeltaFeed(spark, str(tmp_path / "s"), fold_at=100.0)
    f.publish(rows(spark, ("10.0.0.0/8", 1), ("11.0.0.0/8", 2)), 10)
    return f


def test_a_gap_inside_a_batch_is_refused_and_changes_nothing(spark, store):
    with pytest.raises(D.FeedGap, match="1 of the operations 11 to 13"):
        store.apply_batch(texts(spark, feed(("ADD", 11, "12.0.0.0/8", 3), ("ADD", 13, "13.0.0.0/8", 4))))
    assert store.serial() == 10 and held(store) == [("10.0.0.0/8", 1), ("11.0.0.0/8", 2)] and versions(store, "delta") == []
    # The same operations in two files of one batch, one of them known already, are whole.
    assert store.apply_batch(texts(spark, feed(("ADD", 13, "13.0.0.0/8", 4)), feed(("ADD", 9, "9.0.0.0/8", 9), ("ADD", 11, "12.0.0.0/8", 3), ("DEL", 12, "10.0.0.0/8", 1))))
    assert store.serial() == 13 and held(store) == [("11.0.0.0/8", 2), ("12.0.0.0/8", 3), ("13.0.0.0/8", 4)]


def test_a_batch_writes_its_operations_and_leaves_the_base(spark, store):
    before = {n: os.stat(f"{store.folder}/base/v=0/{n}").st_mtime_ns for n in os.listdir(f"{store.folder}/base/v=0")}
    for i in range(3):
        assert store.apply_batch(texts(spark, feed(("ADD", 11 + 2 * i, "12.0.0.0/8", 3), ("DEL" if i % 2 else "ADD", 12 + 2 * i, "13.0.0.0/8", 4))))
    assert before == {n: os.stat(f"{store.folder}/base/v=0/{n}").st_mtime_ns for n in os.listdir(f"{store.folder}/base/v=0")} and versions(store, "base") == [0]
    assert [spark.read.parquet(f"{store.folder}/delta/v={v}").count() for v in versions(store, "delta")] == [2, 2, 2]
    assert held(store) == [("10.0.0.0/8", 1), ("11.0.0.0/8", 2), ("12.0.0.0/8", 3), ("13.0.0.0/8", 4)]
    assert held(store, serial=14) == [("10.0.0.0/8", 1), ("11.0.0.0/8", 2), ("12.0.0.0/8", 3)]
    with pytest.raises(RuntimeError):
        store.state(serial=99)


def test_folding_keeps_the_set_and_removes_old_files(spark, tmp_path):
    f = D.DeltaFeed(spark, str(tmp_path / "s"), fold_at=0.5, keep=2)
    f.publish(rows(spark, *[(f"10.{i}.0.0/16", i) for i in range(8)]), 0)
    want = {(f"10.{i}.0.0/16", i) for i in range(8)}
    rng = random.Random(1)
    for serial in range(1, 13):
        i, op = rng.randrange(10), rng.choice(["ADD", "DEL"])
        (want.add if op == "ADD" else want.discard)((f"10.{i}.0.0/16", i))
        assert f.apply_batch(texts(spark, feed((op, serial, f"10.{i}.0.0/16", i))))
        assert held(f) == sorted(want) and f.serial() == serial
    assert len(versions(f, "base")) <= 2 and len(versions(f, "commits")) <= 8 and len(versions(f, "delta")) < 12


def test_a_batch_that_died_before_its_commit_is_written_over(spark, store):
    store.apply_batch(texts(spark, feed(("ADD", 11, "12.0.0.0/8", 3))))
    rows(spark, ("99.0.0.0/8", 9)).write.parquet(f"{store.folder}/delta/v=2")  # a version that never became current
    assert held(store) == [("10.0.0.0/8", 1), ("11.0.0.0/8", 2), ("12.0.0.0/8", 3)]
    assert store.apply_batch(texts(spark, feed(("DEL", 12, "12.0.0.0/8", 3)))) and held(store) == [("10.0.0.0/8", 1), ("11.0.0.0/8", 2)]


def test_catch_up_loads_the_dump_when_the_feed_leaves_a_gap(spark, tmp_path):
    f = D.DeltaFeed(spark, str(tmp_path / "s"))
    (tmp_path / "SERIAL").write_text("20\n")
    load = lambda: (rows(spark, ("20.0.0.0/8", 20)), D.dump_serial(spark, str(tmp_path / "SERIAL")))
    ops = feed(*[("ADD", i, f"{i}.0.0.0/8", i) for i in range(15, 24)])
    assert f.catch_up(texts(spark, ops), load) == "full" and f.serial() == 23
    assert held(f) == [(f"{i}.0.0.0/8", i) for i in range(20, 24)]
    assert f.catch_up(texts(spark, ops), load) == "none"
    assert f.catch_up(texts(spark, feed(("DEL", 24, "20.0.0.0/8", 20))), load) == "delta" and f.serial() == 24
    assert f.catch_up(texts(spark, feed(("ADD", 40, "40.0.0.0/8", 40))), load) == "full" and f.serial() == 20
    (tmp_path / "NONE").write_text("\n")
    assert D.dump_serial(spark, str(tmp_path / "NONE")) is None


def test_streams_forget_rounds_and_still_count_late_repeats_once(spark, tmp_path):
    src, out, hours = tmp_path / "in", tmp_path / "out", 40
    kind = "probe string, round int, status string, ts timestamp, total bigint, rcv bigint, drop bigint, min double, max double, avg double"
    for h in range(hours):
        shown = [*range(max(0, h - 2), h + 1), *([0, 1, 2] if h % 5 == 0 else [])]  # each poll repeats the rounds before it, and now and then the first
        made = [(f"p{p}", r, "finished", r) for p in range(3) for r in shown]
        d = spark.createDataFrame([(p, r, s, 1_700_000_000 + t * 3600, 1, 1, 0, 1.0, 1.0, 1.0) for p, r, s, t in made], kind.replace("ts timestamp", "ts bigint"))
        d.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(str(src))
    q = (SM.running_ping(s, "3 hours").writeStream.outputMode("complete").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(str(out)))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r.probe: (r.total, r.rcv) for r in spark.read.parquet(str(out)).collect()} == {f"p{p}": (hours, hours) for p in range(3)}
    remembered = [next(o["numRowsTotal"] for o in p["stateOperators"] if "dedup" in o["operatorName"].lower()) for p in q.recentProgress if p["stateOperators"]]
    assert len(remembered) >= 8 and max(remembered) <= 3 * 14 < 3 * hours
