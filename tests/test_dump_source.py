"""The dump source: bounded memory, damage, several files and collectors."""

import bz2
import gzip
import io
import struct
import tracemalloc
import zlib

import pytest

from routeloom.sources import rib_dump

from test_sources import as_path, dump, peer_table, rib


def cut_all(name, blob, **how):
    rows = [r for b in rib_dump.cut("c", name, io.BytesIO(blob), frozenset((4, 6)), **how) for r in b.to_pylist()]
    return rows[:-1], rows[-1]


def test_a_dump_far_larger_than_its_windows_needs_little_memory(tmp_path):
    """240 MB of records pack into one small member: the reader must not unpack more than it hands out."""
    one = rib(2, bytes([10, 1, 0, 0]), 24, [(0, as_path((2, list(range(200))), extended=True))] * 20)
    packer, blob = zlib.compressobj(1, zlib.DEFLATED, 31), []
    n = 240_000_000 // len(one)
    for _ in range(n):
        blob.append(packer.compress(one))
    blob = b"".join([*blob, packer.flush()])
    assert len(blob) < 10_000_000
    seen = 0
    tracemalloc.start()
    for batch in rib_dump.cut("c", "d.gz", io.BytesIO(blob), frozenset((4,))):
        seen += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n + 1 and peak < 40_000_000


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("ending", ["mrt", "gz", "bz2"])
def test_pieces_of_any_window_are_the_content(window, ending):
    raw = dump() * (1 if window == 1 else 20)
    pack = {"mrt": lambda x: x, "gz": gzip.compress, "bz2": bz2.compress}[ending]
    blob = pack(raw) if ending == "mrt" else pack(raw[:50]) + pack(raw[50:]) + b"\0" * 9
    assert b"".join(rib_dump._pieces(f"x.{ending}", io.BytesIO(blob), window)) == raw


@pytest.mark.parametrize("ending", ["mrt", "gz", "bz2"])
def test_every_torn_file_says_so(ending):
    raw = dump() + rib(2, bytes([12, 0]), 16, [(0, as_path((2, [8])))]) * 300
    blob = {"mrt": raw, "gz": gzip.compress(raw), "bz2": bz2.compress(raw)}[ending]
    whole, status = cut_all(f"x.{ending}", blob)
    assert status["problem"] is None and status["family"] == rib_dump.STATUS and status["seq"] == 309
    for at in (5, len(blob) // 3, len(blob) - 1):
        rows, status = cut_all(f"x.{ending}", blob[:at])
        assert status["problem"] and rows == whole[:len(rows)]
    assert cut_all(f"x.{ending}", b"")[1]["problem"] is None


def test_damage_inside_and_absurd_lengths():
    blob = bytearray(gzip.compress(dump() * 50))
    blob[len(blob) // 2] ^= 0xFF
    assert "unpacking" in cut_all("x.gz", bytes(blob))[1]["problem"]
    rows, status = cut_all("x.mrt", dump() + struct.pack(">IHHI", 0, 13, 2, 0xFFFFFFF0) + b"zz")
    assert "record of" in status["problem"] and len(rows) == 6


def test_limit_ends_a_file_without_a_problem():
    rows, status = cut_all("x.mrt", dump(), limit=2)
    assert sum(r["family"] == 4 for r in rows) == 2 and status["problem"] is None


def test_collectors_stay_with_their_rows_and_peers_are_broadcast(spark, tmp_path):
    for c, net in (("a", 20), ("b", 30)):
        (tmp_path / c).mkdir()
        for i in range(3):
            blob = peer_table(("192.0.2.9", 64500 + net + i, True)) + rib(2, bytes([net, i, 0, 0]), 16, [(0, as_path((2, [1, net])))])
            (tmp_path / c / f"{i}.gz").write_bytes(gzip.compress(blob))
    e = rib_dump.read_rib(spark, {c: str(tmp_path / c) for c in "ab"}, torn="refuse")
    got = sorted((r.collector, r.prefix, r.peer_asn) for r in e.collect())
    assert got == sorted((c, f"{net}.{i}.0.0/16", 64500 + net + i) for c, net in (("a", 20), ("b", 30)) for i in range(3))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "collector" not in plan.split("BroadcastHashJoin")[1].split("\n")[0]
    framed = rib_dump.dump_frames(spark, {c: str(tmp_path / c) for c in "ab"})
    assert framed.where("family >= 0").count() == 12
    assert {(r.collector, r.peer_tables, r.records, r.complete) for r in rib_dump.dump_status(framed).collect()} == {("a", 1, 2, True), ("b", 1, 2, True)}


def test_torn_files_can_be_refused(spark, tmp_path):
    (tmp_path / "t.gz").write_bytes(gzip.compress(dump())[:-20])
    with pytest.raises(RuntimeError, match="t.gz"):
        rib_dump.read_rib(spark, {"a": str(tmp_path / "t.gz")}, torn="refuse")


def test_file_systems():
    system, path = rib_dump.file_system("file:/tmp/a b/x.gz")
    assert type(system).__name__ == "LocalFileSystem" and path == "/tmp/a b/x.gz"
    assert rib_dump.file_system("/tmp/x.gz")[1] == "/tmp/x.gz"
    with pytest.raises(Exception):
        rib_dump.file_system("nosuchscheme://h/x")
