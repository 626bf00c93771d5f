"""Suffix dedup: a distributed merge sort of the suffixes that can repeat, exchanged as front-coded sorted runs.

A byte goes if it is covered by a ``length``-byte string that also starts in a document with a smaller id. Every such
string holds, by winnowing, an anchor: the place of the smallest k-gram hash among its k-grams, the same in every copy of
the string. The steps:

0. A document whose whole text an earlier one has is settled at once: all of it goes, and it takes no part below, as the
   earlier one stands for it.
1. Each part (a group of whole documents of bounded bytes) sends its distinct anchor hashes; hashes in two documents or
   more come back. Hashes are only a filter: collisions add work, not results.
2. Each part sorts the suffixes at those anchors into one run per key range, folds equal ones to their smallest document,
   front-codes the run (bytes shared with the suffix before, then the rest) and sends it.
3. Each range merges its runs with a loser tree that compares the known common prefixes first and bytes only beyond them,
   which also yields the common prefixes of neighbours in the merged order. Suffixes whose common prefix and left context
   together span a string of full length form a class, and its smallest document keeps it.
4. Marks go back to the parts, which delete the marked bytes.

An anchor that very many suffixes share is not sent with its context: its strings are sent one by one to ranges of their
own, so no range gathers an unbounded group. Null and empty texts lose nothing; rows with one id count as one document
(neither removes bytes of the other) and rows without an id come last in order, so they lose what any document repeats.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import flat, mix

LENGTH = 50
#: k of the anchor k-grams; raw bytes of a part; suffixes sharing an anchor from which its strings travel one by one.
GRAM, PART_BYTES, HOT = 24, 4 << 20, 20_000
#: Bytes hashed at a time.
_STEP = 1 << 19
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MASK48 = np.uint64((1 << 48) - 1)
_NO_ID = (1 << 63) - 1


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """48-bit hash of each k-gram, built from blocks of powers of two."""
    n = len(raw)
    if n < k:
        return np.zeros(0, np.uint64)
    at, width, parts, done = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    while width <= k:
        p = np.uint64(pow(int(_MUL), width, 1 << 64))
        if k & width:
            m = n - done - width + 1
            parts = at[done:done + m].copy() if parts is None else parts[:m] * p + at[done:done + m]
            done += width
        if width * 2 > k:
            break
        at = at[:-width] * p + at[width:]
        width *= 2
    return mix(parts) & _MASK48


def _sliding(x: np.ndarray, w: int, fold: np.ufunc) -> np.ndarray:
    """Fold of every window of w."""
    width = 1
    while width * 2 <= w:
        x = fold(x[:-width], x[width:])
        width *= 2
    return fold(x[:len(x) - (w - width)], x[w - width:]) if width < w else x


def anchors(raw: np.ndarray, offs: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``raw``, hashes) of the winnowed k-grams of each text of at least ``length`` bytes, in bounded steps."""
    w = length - k + 1
    n, i = len(offs) - 1, 0
    while i < n:
        j = i + 1
        while j < n and offs[j + 1] - offs[i] <= _STEP:
            j += 1
        lo, hi = int(offs[i]), int(offs[j])
        for at in range(lo, hi, _STEP):
            # A step looks back and ahead far enough to see every window that holds one of its k-grams.
            a, b = max(lo, at - w), min(hi, at + _STEP + length)
            h = gram_hashes(raw[a:b], k)
            if len(h) < w:
                continue
            # k-grams that run over the end of a text belong to no window and must never be the smallest.
            ends = offs[i + 1:j + 1]
            for e in ends[(ends > a) & (ends < b)]:
                h[max(0, int(e) - a - k + 1):int(e) - a] = _MASK48 + np.uint64(1)
            low = _sliding(h, w, np.minimum)
            # Windows over a text's end are no strings; they must choose nothing.
            top = low.copy()
            for e in ends[(ends > a) & (ends < b)]:
                top[max(0, int(e) - a - length + 1):int(e) - a] = 0
            pad = np.concatenate((np.zeros(w - 1, np.uint64), top, np.zeros(w - 1, np.uint64)))
            chosen = _chosen(h, pad, w) & (h <= _MASK48)
            p = np.flatnonzero(chosen)
            p = p[(p + a >= at) & (p + a < at + _STEP)]
            yield p + a, h[p]
        i = j


def _chosen(h: np.ndarray, pad: np.ndarray, w: int) -> np.ndarray:
    """Whether a k-gram is the smallest of any window: windows that hold p have minima of at most h[p]."""
    return _sliding(pad, w, np.maximum) == h


# ---------------------------------------------------------------- runs

def front_code(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(bytes shared with the item before, length, rests end to end) of a sorted run."""
    lcp, size, rest, before = [], [], [], b""
    for x in items:
        n = shared(before, x, 0)
        lcp.append(n)
        size.append(len(x))
        rest.append(x[n:])
        before = x
    return np.array(lcp, np.uint8), np.array(size, np.uint8), b"".join(rest)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    most = min(len(a), len(b))
    x, y = a[known:most], b[known:most]
    if x == y:
        return most
    differing = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + (8 * len(x) - differing.bit_length()) // 8


class Run:
    """Reads a front-coded run item by item; ``lcp`` is the prefix shared with the item before."""

    __slots__ = ("lcps", "sizes", "rest", "n", "at", "pos", "item", "lcp")

    def __init__(self, lcps: bytes, sizes: bytes, rest: bytes):
        self.lcps, self.sizes, self.rest, self.n = lcps, sizes, rest, len(lcps)
        self.at, self.pos, self.item, self.lcp = -1, 0, b"", 0

    def step(self) -> bool:
        self.at += 1
        if self.at >= self.n:
            return False
        self.lcp = self.lcps[self.at]
        end = self.pos + self.sizes[self.at] - self.lcp
        self.item = self.item[:self.lcp] + self.rest[self.pos:end]
        self.pos = end
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, prefix shared with the output before) in sorted order, by a loser tree.

    The common prefix of each waiting item with the last winner is known. Of two items the one with the longer known
    prefix is smaller; only for equal ones bytes are compared, from there on. Ties go to the lower run.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    live = [r.step() for r in runs] + [False] * (k - len(runs))
    known = [0] * k
    losers = [0] * k

    def beats(x: int, y: int) -> bool:
        """Whether x comes before y; afterwards the loser's known prefix is the one with the winner."""
        if not live[x] or not live[y]:
            return live[x] or not live[y] and x < y
        if known[x] != known[y]:
            return known[x] > known[y]
        a, b = runs[x].item, runs[y].item
        n = shared(a, b, known[x])
        first = (n == len(a) and (n < len(b) or x < y)) or (n < len(a) and n < len(b) and a[n] < b[n])
        known[y if first else x] = n
        return first

    winners = [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        x, y = winners[2 * i], winners[2 * i + 1]
        winners[i], losers[i] = (x, y) if beats(x, y) else (y, x)
    top = winners[1] if k > 1 else 0
    before = 0
    while live[top]:
        yield top, runs[top].at, before
        live[top] = runs[top].step()
        known[top] = runs[top].lcp
        x, node = top, (top + k) >> 1
        while node:
            y = losers[node]
            if known[x] == known[y] or not (live[x] and live[y]):
                if beats(y, x):
                    losers[node], x = x, y
            elif known[y] > known[x]:
                losers[node], x = x, y
            node >>= 1
        top, before = x, known[x]


def classify(lcp: np.ndarray, left: np.ndarray, left_size: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Bits l of each merged suffix: the string that begins l bytes before it is also in a smaller document.

    For each l the class is an interval of the merged order whose common prefixes reach ``length - l``, split by the l
    bytes to the left, which are ranked exactly, a byte further at each step.
    """
    n, deepest = len(lcp), left.shape[1]
    out = np.zeros(n, np.uint64)
    side = np.zeros(n, np.int64)
    for l in range(deepest + 1):
        if l:
            _, side = np.unique(side * 257 + np.where(left_size >= l, left[:, -l].astype(np.int64) + 1, 0), return_inverse=True)
        ok = (left_size >= l) & (size >= length - l)
        if not ok.any():
            continue
        interval = np.cumsum(lcp < length - l)
        _, cls = np.unique(interval * (n + 1) + side, return_inverse=True)
        least = np.full(cls.max() + 1, _NO_ID)
        np.minimum.at(least, cls[ok], doc[ok])
        out[ok & (doc > least[cls])] |= np.uint64(1 << l)
    return out


# ---------------------------------------------------------------- Spark steps

_HASHES = "bucket int, part int, once binary, more binary, often binary"
_REPLY = "part int, hot boolean, hashes binary, copy bigint, digest bigint"
_RUNS = "range int, part int, docs binary, owners binary, lcps binary, sizes binary, rest binary, lefts binary, left_sizes binary, copies binary, copy_bits binary"
_MARKS = "part int, owners binary, bits binary, copy bigint, digest bigint"
_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<bigint>"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, _KINDS[t]) for c, t in zip(columns, kinds)], names=list(names))


def _part_text(rows: pa.Table, notes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a part by id, then text, so that every step sees the same bytes in the same places: bytes, offsets,
    ids, and whether ``notes`` names the row as a copy of an earlier one."""
    rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
    raw, offs = flat(rows.column("text"))
    named = {(a, b) for a, b in zip(notes.column("copy").to_pylist(), notes.column("digest").to_pylist()) if a is not None}
    ids = rows.column("id")
    copy = np.array([x in named for x in zip(ids.to_pylist(), rows.column("digest").to_pylist())], bool)
    return raw[offs[0]:offs[-1]], offs - offs[0], ids.to_numpy(), copy


def _anchored(raw: np.ndarray, offs: np.ndarray, copy: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the documents that are no copies."""
    got = list(anchors(raw, offs, length, k))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
    own = ~copy[np.searchsorted(offs, at, side="right") - 1]
    return at[own], h[own]


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


def _split(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of each key 0 to n - 1."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.searchsorted(keys[order], np.arange(1, n)))


def _all_bits(size: np.ndarray, left_size: np.ndarray, length: int, deepest: int) -> np.ndarray:
    """Bits of all strings of full length that an item spans."""
    out = np.zeros(len(size), np.uint64)
    for l in range(deepest + 1):
        out[(left_size >= l) & (size >= length - l)] |= np.uint64(1 << l)
    return out


def _run(text: bytes, place: np.ndarray, size: np.ndarray, left_size: np.ndarray, doc: np.ndarray, length: int, deepest: int) -> tuple:
    """A front-coded sorted run. Items equal in suffix and left context are sent for their smallest document only; the
    others are copies, all of whose strings go."""
    items = sorted((text[p:p + n], text[p - m:p], d, p) for p, n, m, d in zip(place.tolist(), size.tolist(), left_size.tolist(), doc.tolist()))
    kept, copies, at = [], [], None
    for x in items:
        if at is None or x[0] != at[0] or x[1] != at[1]:
            at = x
        (kept if x[2] == at[2] else copies).append(x)
    lcps, sizes, rest = front_code([x[0] for x in kept])
    bits = _all_bits(np.array([len(x[0]) for x in copies], np.int64), np.array([len(x[1]) for x in copies], np.int64), length, deepest)
    return (np.array([x[2] for x in kept], "<i8").tobytes(), np.array([x[3] for x in kept], "<i8").tobytes(), lcps.tobytes(), sizes.tobytes(), rest,
            b"".join([x[1].rjust(deepest, b"\0") for x in kept]), np.array([len(x[1]) for x in kept], np.uint8).tobytes(),
            np.array([x[3] for x in copies], "<i8").tobytes(), bits.tobytes())


def _bounds(frame: DataFrame, length: int, k: int, n: int, rows: int) -> list[bytes]:
    """Range bounds from about 2,000 texts chosen by a hash; they balance the ranges and have no part in the result."""
    room = F.greatest(F.length("text") - k, F.lit(1))
    cuts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit(j)), room) + 1).cast("int"), F.lit(k)) for j in range(10)]
    held = frame.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // 2000))) == 0).where(F.octet_length("text") >= length).select(F.array(*cuts).alias("cuts")).collect()
    sample = sorted(c.encode()[:k] for r in held for c in r["cuts"])
    return [sample[len(sample) * i // n] for i in range(1, n)] if sample else []


def dedup(docs: DataFrame, length: int = LENGTH, k: int = GRAM, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (starts and stops in turn).

    ``length`` is at most 255 and ``length - k`` at most 63.
    """
    frame = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = frame.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, -(-(size["b"] or 0) // part_bytes))
    parts = frame.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("digest", F.xxhash64("text"))
    bounds = _bounds(frame, length, k, n, size["n"])
    lean = parts.select("part", "id", "digest", F.xxhash64(F.lit(1), "text").alias("second"), F.octet_length("text").alias("size")).where(F.col("size") >= length)
    least = lean.groupBy("digest", "second", "size").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    copies = lean.join(least, ["digest", "second", "size"]).where("id > first").select(F.col("part").alias("part"), F.col("id").alias("copy"), F.col("digest").alias("digest"))
    no_bytes, no_flag = F.lit(None).cast("binary"), F.lit(None).cast("boolean")
    deepest = length - k

    def hashes(rows: pa.Table, notes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _HASHES)
        raw, offs, ids, copy = _part_text(rows, notes)
        at, h = _anchored(raw, offs, copy, length, k)
        if not len(at):
            return _table([], _HASHES)
        doc = np.unique(ids, return_inverse=True)[1][np.searchsorted(offs, at, side="right") - 1]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        stops = np.append(begins[1:], len(h))
        value, often, single = h[begins], stops - begins, doc[begins] == doc[stops - 1]
        part, out = rows.column("part")[0].as_py(), []
        for b, pick in enumerate(_split((value >> np.uint64(24)).astype(np.int64) * n >> 24, n)):
            if len(pick):
                s = single[pick]
                out.append((b, part, _pack48(value[pick[s]]), _pack48(value[pick[~s]]), often[pick[~s]].astype("<u4").tobytes()))
        return _table(out, _HASHES)

    def reply(rows: pa.Table) -> pa.Table:
        held = [(r["part"], _unpack48(r["once"]), _unpack48(r["more"]), np.frombuffer(r["often"], "<u4")) for r in rows.to_pylist()]
        values = np.concatenate([np.concatenate((o, m)) for _, o, m, _ in held])
        counts = np.concatenate([np.concatenate((np.ones(len(o)), f)) for _, o, _, f in held])
        several = np.concatenate([np.repeat((0.0, 1.0), (len(o), len(m))) for _, o, m, _ in held])
        distinct, at = np.unique(values, return_inverse=True)
        total, multi = np.bincount(at, counts), (np.bincount(at) > 1) | (np.bincount(at, several) > 0)
        out = []
        for part, o, m, _ in held:
            own = np.concatenate((o, m))
            i = np.searchsorted(distinct, own)
            for is_hot in (False, True):
                pick = own[multi[i] & ((total[i] > hot) == is_hot)]
                if len(pick):
                    out.append((part, is_hot, _pack48(pick), None, None))
        return _table(out, _REPLY)

    def runs(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not rows.num_rows:
            return _table([], _RUNS)
        raw, offs, ids, copy = _part_text(rows, answers)
        at, h = _anchored(raw, offs, copy, length, k)
        text, part, out = raw.tobytes(), rows.column("part")[0].as_py(), []
        replies = [r for r in answers.to_pylist() if r["hashes"] is not None]
        for is_hot in (False, True):
            chosen = np.sort(np.concatenate([np.zeros(0, np.uint64), *[_unpack48(r["hashes"]) for r in replies if r["hot"] == is_hot]]))
            if not len(chosen):
                continue
            place = at[chosen[np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)] == h]
            d = np.searchsorted(offs, place, side="right") - 1
            if is_hot:  # every string of full length that holds the anchor travels on its own
                back = np.arange(deepest + 1)[None]
                place, d = (place[:, None] - back).ravel(), np.repeat(d, deepest + 1)
                inside = (place >= offs[d]) & (place + length <= offs[d + 1])
                place, pick = np.unique(place[inside], return_index=True)
                d = d[inside][pick]
            size = np.minimum(length, offs[d + 1] - place)
            left_size = np.zeros(len(place), np.int64) if is_hot else np.minimum(place - offs[d], deepest)
            if is_hot:
                keys = np.fromiter((zlib.crc32(text[p:p + length]) % n for p in place.tolist()), np.int64, len(place))
            else:
                keys = np.fromiter((bisect_right(bounds, text[p:p + k]) for p in place.tolist()), np.int64, len(place))
            for b, pick in enumerate(_split(keys, n)):
                if len(pick):
                    out.append((b + n * is_hot, part, *_run(text, place[pick], size[pick], left_size[pick], ids[d[pick]], length, deepest)))
        return _table(out, _RUNS)

    def merged(rows: pa.Table) -> pa.Table:
        held = sorted(rows.to_pylist(), key=lambda r: r["part"])
        order = np.fromiter((x for t in merge([Run(r["lcps"], r["sizes"], r["rest"]) for r in held]) for x in t), np.int64).reshape(-1, 3)
        starts = np.concatenate(([0], np.cumsum([len(r["lcps"]) for r in held])))
        at, lcp = starts[order[:, 0]] + order[:, 1], order[:, 2]

        def column(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[name], kind) for r in held])

        # Only suffixes with a neighbour that shares an anchor can be in a class with another.
        near = np.flatnonzero(np.maximum(lcp, np.append(lcp[1:], 0)) >= k)
        bits = np.zeros(len(at), np.uint64)
        if len(near):
            from_before = np.where(np.diff(near, prepend=-2) == 1, lcp[near], 0)
            i = at[near]
            bits[i] = classify(from_before, column("lefts", "u1").reshape(-1, deepest)[i], column("left_sizes", "u1").astype(np.int64)[i],
                               column("sizes", "u1").astype(np.int64)[i], column("docs", "<i8")[i], length)
        out = []
        for r, a in zip(held, starts):
            own = bits[a:a + len(r["lcps"])]
            pick = np.flatnonzero(own)
            if len(pick) or r["copies"]:
                out.append((r["part"], np.frombuffer(r["owners"], "<i8")[pick].tobytes() + r["copies"], own[pick].tobytes() + r["copy_bits"], None, None))
        return _table(out, _MARKS)

    def apply(rows: pa.Table, marks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _RESULT)
        raw, offs, ids, copy = _part_text(rows, marks)
        gone = np.zeros(len(raw) + 1, np.int32)
        np.add.at(gone, offs[:-1][copy], 1)
        np.add.at(gone, offs[1:][copy], -1)
        for owners, bits in zip(marks.column("owners").to_pylist(), marks.column("bits").to_pylist()):
            if owners is None:
                continue
            first, b = np.frombuffer(owners, "<i8"), np.frombuffer(bits, "<u8")
            for l in range(deepest + 1):
                p = first[(b >> np.uint64(l)) & np.uint64(1) == 1] - l
                np.add.at(gone, p, 1)
                np.add.at(gone, p + length, -1)
        lost = np.cumsum(gone[:-1]) > 0
        out = []
        for d, doc in enumerate(ids.tolist()):
            own, body = lost[offs[d]:offs[d + 1]], raw[offs[d]:offs[d + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).view(np.int8)))
            out.append((None if doc == _NO_ID else doc, len(own), int(own.sum()), len(edges) // 2, body[~own].tobytes() if len(edges) else body.tobytes(), edges.tolist()))
        return _table(out, _RESULT)

    noted = copies.withColumn("hot", no_flag).withColumn("hashes", no_bytes).select("part", "hot", "hashes", "copy", "digest")
    settled = copies.withColumn("owners", no_bytes).withColumn("bits", no_bytes).select("part", "owners", "bits", "copy", "digest")
    found = parts.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(hashes, _HASHES)
    answers = found.groupBy("bucket").applyInArrow(reply, _REPLY).unionByName(noted)
    sent = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(runs, _RUNS)
    marks = sent.groupBy("range").applyInArrow(merged, _MARKS).unionByName(settled)
    return parts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(apply, _RESULT)
