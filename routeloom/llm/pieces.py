"""SentencePiece vocabularies: reading the model file, a double-array trie of pieces, unigram Viterbi and decoding.

Text is escaped (space to the marker U+2581, with a marker in front), then split so that the sum of piece scores is
largest; characters without a piece fall back to byte pieces. A model whose scores are merge ranks gets log scores from
the rank by Zipf's law. Null and empty texts have no pieces and decode to the empty text. A literal U+2581 in a text
decodes to a space, as in every implementation of this format; any other text decodes to itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MARK = "▁"
#: The piece types of the file format that are used here.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Added to the smallest score for a character without a piece.
PENALTY = 10.0
#: Word cache of a task: entries at most, and characters of a cached word at most.
CACHE, CACHED_CHARS = 300_000, 40


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = out = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, buf[i:i + n]
            i += n


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) by id, and the model type (1 unigram, 2 merges) of a model file."""
    pieces, model_type = [], 1
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, 1)
    return pieces, model_type


def log_scores(pieces: list[tuple[str, float, int]], model_type: int) -> list[float]:
    """A unigram file's own scores; for merge ranks -ln(rank) - ln(sum of 1/rank), ranks by falling score, then id."""
    if model_type == 1:
        return [s for _, s, _ in pieces]
    order = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
    total = log(sum(1 / r for r in range(1, len(order) + 1))) if order else 0.0
    out = [0.0] * len(pieces)
    for r, i in enumerate(order, 1):
        out[i] = -log(r) - total
    return out


class Trie:
    """Double array: the child of node n by byte b is base[n] + b, provided that check there is n."""

    def __init__(self, keys: dict[bytes, int]):
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        words = sorted(keys)
        # Where a group of so many children was last placed; searching on from there keeps the build linear.
        last: dict[int, int] = {}
        todo = [(0, 0, len(words), 0)] if words else []
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(words[lo]) == depth:
                value[node] = keys[words[lo]]
                lo += 1
            groups, i = [], lo
            while i < hi:
                b, j = words[i][depth], i
                while j < hi and words[j][depth] == b:
                    j += 1
                groups.append((b, i, j))
                i = j
            if not groups:
                continue
            at = last.get(len(groups), 1)
            while True:
                while at + 300 > len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[at + b] < 0 for b, _, _ in groups):
                    break
                at += 1
            base[node] = last[len(groups)] = at
            for b, i, j in groups:
                check[at + b] = node
                todo.append((at + b, i, j, depth + 1))
        self.base, self.check, self.value = base, check, value

    def ends(self, raw: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, id) of every key that starts at a place, shortest first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for i in range(start, len(raw)):
            child = base[node] + raw[i]
            if check[child] != node:  # a leaf's base is 0, and no cell names a leaf as its parent
                return
            node = child
            if value[node] >= 0:
                yield i + 1, value[node]


class Pieces:
    """A vocabulary ready to encode and decode."""

    def __init__(self, data: bytes):
        self.pieces, kind = read_model(data)
        self.scores = log_scores(self.pieces, kind)
        normal = {p.encode(): i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL and p}
        self.trie = Trie(normal)
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.byte_ids = np.zeros(len(self.pieces), bool)
        self.byte_ids[list(self.bytes_of.values())] = True
        self.penalty = min((self.scores[i] for i in normal.values()), default=0.0) - PENALTY
        # A piece never holds a marker behind another character, nor these characters, so the best split breaks before them.
        alone = [c for c in "\n\t\r" if not any(c in p for p, _, t in self.pieces if t == NORMAL)]
        apart = "".join(map(re.escape, alone))
        whole = all(MARK not in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)
        self.chunks = re.compile(f"[{apart}]|{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+") if whole else re.compile("(?s).+")
        self.cache: dict[str, bytes] = {}
        self.plain = [(b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode()) for p, _, t in self.pieces]

    def best(self, chunk: str) -> bytes:
        """Ids of the best split, four bytes each. Of equal sums the one with the longer last piece wins."""
        raw = chunk.encode()
        n = len(raw)
        total, back = [None] * (n + 1), [(0, -1)] * (n + 1)
        total[0] = 0.0
        # The walk of Trie.ends, written out: it is the inner loop of all encoding.
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        i = 0
        while i < n:
            lead = raw[i]
            width = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            here, single, node, j = total[i], False, 0, i
            while j < n:
                child = base[node] + raw[j]
                if check[child] != node:
                    break
                node = child
                j += 1
                piece = value[node]
                if piece >= 0:
                    if j == i + width:
                        single = True
                    score = here + scores[piece]
                    if total[j] is None or score > total[j]:
                        total[j], back[j] = score, (i, piece)
            if not single:
                end, score = i + width, here + self.penalty
                if total[end] is None or score > total[end]:
                    total[end], back[end] = score, (i, -1)
            i += width
        out, end = [], n
        while end:
            start, piece = back[end]
            if piece >= 0:
                out.append(piece)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in reversed(raw[start:end])]
            else:
                out.append(self.unknown)
            end = start
        return np.array(out[::-1], "<i4").tobytes()

    def __getitem__(self, chunk: str) -> bytes:
        got = self.cache.get(chunk)
        if got is None:
            got = self.best(chunk)
            if len(chunk) <= CACHED_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks.findall(MARK + text.replace(" ", MARK)))), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        plain = self.plain
        out = b"".join([plain[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def _held(digest: bytes, holder: "_Model") -> Pieces:
    return Pieces(holder.data)


class _Model:
    """The bytes of a model file as they travel to the tasks; the trie is built once in each worker process."""

    def __init__(self, data: bytes):
        self.data, self.digest = data, hashlib.sha256(data).digest()

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Model) and self.digest == other.digest

    def pieces(self) -> Pieces:
        return _held(self.digest, self)


def load(spark: SparkSession, path: str) -> bytes:
    """A model file's bytes, by Spark's own reader for a URI and from the driver's disk otherwise. The vocabulary bounds its size."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, n_pieces, n_byte_pieces, ids_sha256 (little-endian 32-bit ids), round_trip."""
    holder = _Model(model)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = holder.pieces()
        for b in batches:
            held = b.column("text").to_pylist()
            step = 1000
            for at in range(0, len(held), step):
                part = held[at:at + step]
                ids = [p.encode(t) for t in part]
                lengths = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(at, step), pa.ListArray.from_arrays(offsets, values), pa.array(lengths),
                    pa.array([int(p.byte_ids[x].sum()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                    pa.array([p.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, part)], pa.bool_())],
                    names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    return d.mapInArrow(rows, "doc_id bigint, ids array<int>, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """All rows and columns with ``decoded``: the text of the ids; null ids give the empty text."""
    holder = _Model(model)
    keep = [c for c in encoded.columns if c.lower() != "decoded"]
    frame = encoded.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType(list(frame.schema.fields)).add("decoded", "string")
    at = keep.index(ids_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = holder.pieces()
        for b in batches:
            out = [p.decode(np.array([i for i in x if i is not None and 0 <= i < len(p.plain)], np.int32)) if x else "" for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return frame.mapInArrow(rows, schema)
