"""TABLE_DUMP_V2 RIB dumps to flat RIB entries.

``rib_dump`` is a data source of its own: one partition per dump file, whose task reads the file as a stream, unpacks it in
windows of bounded size and hands records out as it cuts them, so a dump may be larger than any cell or worker. A compressed
dump cannot be split, but that task only cuts; the records are spread over the cluster and kept in a durable copy, and the
expensive part, decoding attributes, runs on all executors. Peers join as a dimension by (file, table, index).

Every file ends with a status row: how many records were read, and what was wrong if the file ended early or was damaged.
"""

from __future__ import annotations

import bz2
import io
import json
import struct
import zlib
from typing import BinaryIO, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import addr
from ..session import durable

# Record type, subtypes and attribute code of the dump format.
TABLE_DUMP_V2 = 13
PEER_INDEX = 1
RIB_SUBTYPES = {2: (4, False), 4: (6, False), 8: (4, True), 10: (6, True)}
AS_PATH = 2
#: Family of the row that ends a file.
STATUS = -1
#: Bytes unpacked at a time, bytes of records in a batch, and the size from which a record's length must be damage.
WINDOW, BATCH, LARGEST = 1 << 20, 4 << 20, 1 << 26
#: Rows of small files that share a batch.
ROWS = 10_000
#: Peers are broadcast up to this number; a peer takes this many bytes of its table at least.
FEW_PEERS, PEER_BYTES = 200_000, 11

FRAME_SCHEMA = "collector string, file string, tbl int, seq bigint, family int, addpath boolean, body binary, problem string"
ENTRY_SCHEMA = ("collector string, file string, tbl int, seq bigint, family int, plen int, hi bigint, lo bigint, "
                "peer_index int, asns array<bigint>, path_cut boolean")
PEER_SCHEMA = "file string, tbl int, peers array<struct<peer_asn:bigint,peer_ip:string>>"


class Damaged(Exception):
    """What makes the rest of a file unreadable."""


def _pieces(name: str, stream: BinaryIO, window: int = WINDOW) -> Iterator[bytes]:
    """Unpacked bytes, at most ``window`` at a time whatever the compression; several members may follow each other."""
    if not name.endswith((".gz", ".bz2")):
        while piece := stream.read(window):
            yield piece
        return
    gz = name.endswith(".gz")
    unpacker, data = None, b""
    try:
        while True:
            if not data and (unpacker is None or gz or unpacker.needs_input):
                data = stream.read(window)
                if not data:
                    break
            if unpacker is None:
                data = data.lstrip(b"\0")  # padding between members
                if not data:
                    continue
                unpacker = zlib.decompressobj(31) if gz else bz2.BZ2Decompressor()
            piece = unpacker.decompress(data, window)
            data = unpacker.unconsumed_tail if gz else b""
            if piece:
                yield piece
            if unpacker.eof:
                data, unpacker = unpacker.unused_data, None
        if unpacker is not None and gz:
            if piece := unpacker.flush():
                yield piece
            unpacker = None if unpacker.eof else unpacker
    except (zlib.error, OSError, EOFError) as e:
        raise Damaged(f"unpacking: {e}") from None
    if unpacker is not None:
        raise Damaged("ends inside a compressed member")


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(type, subtype, body) of every complete record."""
    buf = bytearray()
    for piece in pieces:
        buf += piece
        at = 0
        while len(buf) - at >= 12:
            kind, sub, size = struct.unpack_from(">HHI", buf, at + 4)
            if size > LARGEST:
                raise Damaged(f"a record of {size} bytes")
            if len(buf) - at - 12 < size:
                break
            yield kind, sub, bytes(buf[at + 12:at + 12 + size])
            at += 12 + size
        del buf[:at]
    if buf:
        raise Damaged("ends inside a record")


def cut(collector: str | None, file: str, stream: BinaryIO, families: frozenset[int], limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Records of one dump, then its status; default routes and unwanted families go before any decoding."""
    for rows in _cut_rows(collector, file, stream, families, limit):
        yield _frame_batch(rows)


def _cut_rows(collector: str | None, file: str, stream: BinaryIO, families: frozenset[int], limit: int | None) -> Iterator[list[tuple]]:
    """The rows of :func:`cut`, a list for each batch."""
    rows, weight, table, kept, seq, problem = [], 0, 0, 0, -1, None
    records = _records(_pieces(file, stream))
    while True:
        try:
            seq, (kind, sub, body) = seq + 1, next(records)
        except (StopIteration, Damaged) as e:
            problem, seq = str(e) if isinstance(e, Damaged) else None, seq + 1
            break
        if kind == TABLE_DUMP_V2:
            if sub == PEER_INDEX:
                table += 1
                rows.append((collector, file, table, seq, 0, False, body, None))
                weight += len(body)
            elif sub in RIB_SUBTYPES and len(body) > 4 and body[4] and RIB_SUBTYPES[sub][0] in families:
                rows.append((collector, file, table, seq, *RIB_SUBTYPES[sub], body, None))
                weight += len(body)
                kept += 1
        if weight > BATCH:
            yield rows
            rows, weight = [], 0
        if limit is not None and kept >= limit:
            seq += 1
            break
    yield rows + [(collector, file, table, seq, STATUS, False, None, problem)]


def _frame_batch(rows):
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    names = ["collector", "file", "tbl", "seq", "family", "addpath", "body", "problem"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there; raises where Python has none for the scheme."""
    scheme, _, rest = path.partition(":") if ":/" in path else ("file", "", path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, inside = rest.lstrip("/").partition("/")
    system, root = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, (inside if scheme in ("s3", "gs", "s3a") and not root.strip("/") else f"{root.rstrip('/')}/{inside}")


class DumpReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.families = frozenset(json.loads(options.get("families", "[4, 6]")))
        self.limit = json.loads(options.get("limit", "null"))

    def partitions(self):
        return [InputPartition(x) for x in self.files]

    def read(self, partition):
        if not self.files:
            return
        collector, path = partition.value
        system, inside = file_system(path)
        with system.open_input_stream(inside, compression=None) as stream:
            yield from cut(collector, path, stream, self.families, self.limit)


class DumpSource(DataSource):
    """``spark.read.format("rib_dump")`` with options ``files`` (JSON list of [collector, path]), ``families``, ``limit``."""

    @classmethod
    def name(cls):
        return "rib_dump"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return DumpReader(self.options)


def _as_path(attrs: bytes) -> tuple[list[int], bool]:
    """All ASNs of the AS_PATH attribute, segments in order, and whether it was cut short."""
    at, end = 0, len(attrs)
    while end - at >= 3:
        flags, code, size = attrs[at], attrs[at + 1], attrs[at + 2]
        at += 3
        if flags & 0x10:
            if at >= end:
                break
            size, at = size << 8 | attrs[at], at + 1
        if code != AS_PATH:
            at += size
            continue
        asns: list[int] = []
        stop = min(end, at + size)
        while stop - at >= 2:
            hops = attrs[at + 1]
            at += 2
            whole = min(hops, (stop - at) // 4)
            asns += struct.unpack_from(f">{whole}I", attrs, at)
            if whole < hops:
                return asns, True
            at += 4 * hops
        return asns, False
    return [], False


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _decode_entries(batches):
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(),
             pa.list_(pa.int64()), pa.bool_()]
    names = ["collector", "file", "tbl", "seq", "family", "plen", "hi", "lo", "peer_index", "asns", "path_cut"]
    for batch in batches:
        out = []
        held = (batch.column(c).to_pylist() for c in ("collector", "file", "tbl", "seq", "family", "addpath", "body"))
        for collector, file, tbl, seq, family, addpath, body in zip(*held):
            plen = body[4]
            width = 4 if family == 4 else 16
            used = (plen + 7) // 8
            net = int.from_bytes(body[5:5 + used].ljust(width, b"\0")[:width], "big")
            host = max(8 * width - plen, 0)
            net = net >> host << host
            hi, lo = _signed(net >> 64), _signed(net & (1 << 64) - 1)
            at = 5 + used
            count = int.from_bytes(body[at:at + 2], "big")
            at += 2
            skip = 8 if addpath else 4
            for _ in range(count):
                size_at = at + 2 + skip
                if size_at + 2 > len(body):
                    break
                peer = int.from_bytes(body[at:at + 2], "big")
                size = int.from_bytes(body[size_at:size_at + 2], "big")
                at = size_at + 2 + size
                asns, cut = _as_path(body[size_at + 2:at])
                if asns:
                    out.append((collector, file, tbl, seq, family, plen, hi, lo, peer, asns, cut))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _decode_peers(batches):
    import socket

    kinds = [pa.string(), pa.int32(), pa.list_(pa.struct([("peer_asn", pa.int64()), ("peer_ip", pa.string())]))]
    names = ["file", "tbl", "peers"]
    for batch in batches:
        out = []
        for file, tbl, packed in zip(*(batch.column(c).to_pylist() for c in ("file", "tbl", "body"))):
            body, peers = io.BytesIO(packed), []
            body.read(4)
            body.read(int.from_bytes(body.read(2), "big"))
            for _ in range(int.from_bytes(body.read(2), "big")):
                flags = body.read(5)[0]
                ip = socket.inet_ntop(socket.AF_INET6, body.read(16)) if flags & 1 else socket.inet_ntop(socket.AF_INET, body.read(4))
                asn = int.from_bytes(body.read(4 if flags & 2 else 2), "big")
                peers.append({"peer_asn": asn, "peer_ip": ip})
            out.append((file, tbl, peers))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _cut_cells(batches: Iterator[pa.RecordBatch], families: frozenset[int], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Records of many dumps; small files share a batch."""
    rows, weight = [], 0
    for b in batches:
        for collector, path, content in zip(*(c.to_pylist() for c in b.columns)):
            for more in _cut_rows(collector, path, io.BytesIO(content), families, limit):
                rows += more
                weight += sum(len(r[6]) for r in more if r[6] is not None)
                if weight > BATCH or len(rows) >= ROWS:
                    yield _frame_batch(rows)
                    rows, weight = [], 0
    if rows:
        yield _frame_batch(rows)


def frames(files: DataFrame, family: int | None = None, limit: int | None = None) -> DataFrame:
    """Records of dumps that are held as cells (``path``, ``content``, optionally ``collector``); ``limit`` prefixes per file."""
    wanted = frozenset((4, 6) if family is None else (family,))
    named = files if "collector" in files.columns else files.withColumn("collector", F.lit(None).cast("string"))

    return named.select("collector", "path", "content").mapInArrow(lambda batches: _cut_cells(batches, wanted, limit), FRAME_SCHEMA)


def dump_frames(spark: SparkSession, dumps: dict[str, str | list[str]], family: int | None = None, limit: int | None = None) -> DataFrame:
    """Records and status rows of the dumps ``{collector: path, folder or paths}``, spread over the cluster and written once.

    Spark lists the files (names only). Files in a store that Python cannot open are read as cells instead, up to 2 GiB each.
    """
    spark.dataSource.register(DumpSource)
    named = []
    for collector, paths in dumps.items():
        files = spark.read.format("binaryFile").load(paths if isinstance(paths, list) else [paths]).select("path")
        named += [(collector, r["path"]) for r in files.orderBy("path").collect()]  # a name per dump file
    streamed, cells = [], []
    for x in named:
        try:
            file_system(x[1])
            streamed.append(x)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            cells.append(x)
    out = (spark.read.format("rib_dump").option("files", json.dumps(streamed)).option("limit", json.dumps(limit))
           .option("families", json.dumps([4, 6] if family is None else [family])).load())
    for collector in {c for c, _ in cells}:
        held = spark.read.format("binaryFile").load([p for c, p in cells if c == collector]).withColumn("collector", F.lit(collector))
        out = out.unionByName(frames(held, family, limit))
    return durable(out.repartition("file", "seq"))


def dump_status(framed: DataFrame) -> DataFrame:
    """One row per file: collector, file, peer tables, records read, whether the file was whole, and what was wrong with it."""
    return framed.where(F.col("family") == STATUS).select("collector", "file", F.col("tbl").alias("peer_tables"), F.col("seq").alias("records"),
                                                          F.col("problem").isNull().alias("complete"), "problem")


def refuse_torn(framed: DataFrame) -> None:
    """Raise when a file is damaged or ends early."""
    torn = dump_status(framed).where(~F.col("complete")).select("file", "problem").limit(20).collect()
    if torn:
        raise RuntimeError("unusable dumps: " + "; ".join(f"{r['file']} {r['problem']}" for r in torn))


def entries_from_frames(framed: DataFrame) -> DataFrame:
    """RIB entries (one per prefix and peer) with collector and peer; a missing peer leaves NULLs.

    A file's peers are one row, a few hundred in an array; they are broadcast where the bytes of all peer tables show that they
    are few. ``framed`` should be a written table, as it is read for the peers and for the entries.
    """
    held = framed.where(F.col("family") == 0)
    peers = held.mapInArrow(_decode_peers, PEER_SCHEMA)
    few = (held.agg(F.sum(F.length("body"))).first()[0] or 0) <= FEW_PEERS * PEER_BYTES
    raw = framed.where(F.col("family") > 0).mapInArrow(_decode_entries, ENTRY_SCHEMA)
    point = addr.wide(F.col("hi"), F.col("lo"))
    peer = F.get("peers", F.col("peer_index"))
    return (raw.join(F.broadcast(peers) if few else peers, ["file", "tbl"], "left").withColumn("ip_start", point)
            .withColumns({"peer_asn": peer["peer_asn"], "peer_ip": peer["peer_ip"]})
            .withColumn("ip_end", addr.WIDE.last("ip_start", "plen", "family"))
            .withColumn("prefix", addr.network_text("family", "ip_start", "plen"))
            .select("collector", "file", "seq", "family", "prefix", "plen", "ip_start", "ip_end", "peer_asn", "peer_ip", "asns", "path_cut"))


def read_rib(spark: SparkSession, dumps: dict[str, str | list[str]], family: int | None = None, limit: int | None = None, torn: str = "keep") -> DataFrame:
    """RIB entries of several collectors: ``{collector: path, folder or paths}``.

    A file that ends early gives what could be read (``torn="keep"``) or an error (``"refuse"``).
    """
    framed = dump_frames(spark, dumps, family, limit)
    if torn == "refuse":
        refuse_torn(framed)
    return entries_from_frames(framed).drop("file", "seq")
