"""Document fingerprints: closed syncmers as anchors that do not depend on their surroundings, matched by position.

A k-mer of code points is an anchor if the smallest hash among its inner s-mers stands at its first or last place. The
fingerprint is the sequence of anchor hashes, six hex digits each. A text without anchors (shorter than k, or with none by
chance) has one anchor, the hash of the whole; a null or empty text has none and an empty fingerprint. Two empty
fingerprints are alike by 1, an empty and another by 0. Rows with one doc_id are ordered by text; a null doc_id stands
after all others; a single row is its own next document. A text edited in its second half shares an anchor with the
original from 37 code points on; shorter ones may share none, and below 23 they do so only if nothing changed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import flat, mix, slices, texts

#: An anchor is among every 2 k - s - 1 = 19 code points, so two texts with as many in common share one.
K, S = 12, 4
#: Rows of one id range at most, about; a range is streamed, so this bounds time and not memory.
ROWS_PER_RANGE = 50_000
#: Bytes of text whose anchors are found and compared at once, or one longer text.
SLICE = 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = -(1 << 63)


def _powers() -> dict[int, np.uint64]:
    return {n: np.uint64(pow(int(_MUL), n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32)}


_POW = _powers()


def anchors_of(many: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes (24 bits) of all texts end to end, each in text order, and the n + 1 offsets into them. ``s`` is a power
    of two, and s <= k <= 64."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in many], dtype=np.int64)))
    h = np.frombuffer("".join(many).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(h)
    at, got = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= k:
        h = mix(h + _MUL)
        at, width, inner, parts, done = h, 1, None, None, 0
        left = k  # the k-mer hash is put together from blocks of powers of two
        while width <= k:
            if width == s:
                inner = mix(at)
            if left & width:
                m = n - done - width + 1
                parts = at[done:done + m] if parts is None else parts[:m] * _POW[width] + at[done:done + m]
                done += width
            if width * 2 > k:
                break
            at = at[:-width] * _POW[width] + at[width:]
            width *= 2
        w = k - s + 1
        low, width = inner, 1
        while width * 2 <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < w:
            low = np.minimum(low[:len(low) - (w - width)], low[w - width:])
        m = n - k + 1
        chosen = (low == inner[:m]) | (low == inner[w - 1:w - 1 + m])
        # A k-mer never runs over the end of a text.
        over = (ends[1:-1, None] - np.arange(1, k)).ravel()
        chosen[over[(over >= 0) & (over < m)]] = False
        at = np.flatnonzero(chosen)
        got = parts[:m][at]
    values, first = (mix(got) >> np.uint64(40)).astype(np.int64), np.searchsorted(at, ends)
    bare = np.flatnonzero((np.diff(first) == 0) & (np.diff(ends) > 0))
    if len(bare):
        whole = [int.from_bytes(hashlib.blake2b(many[i].encode(), digest_size=3).digest(), "big") for i in bare.tolist()]
        values = np.insert(values, first[bare], whole)
        first = first + np.searchsorted(bare, np.arange(len(first)))
    return values, first


def anchors(text: str, k: int = K, s: int = S) -> np.ndarray:
    """Anchor hashes of one text."""
    return anchors_of([text], k, s)[0]


def digits(a: np.ndarray) -> str:
    """Six hex digits for each anchor."""
    return a.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()


def _rising(places: list[int]) -> int:
    """Length of the longest rising subsequence of distinct numbers."""
    tails: list[int] = []
    for p in places:
        i = bisect_left(tails, p)
        tails[i:i + 1] = [p]
    return len(tails)


def alike(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair the share of anchors that can be matched in the same order: 2 * matched / (anchors of both). Of repeated
    anchors the i-th on the one side goes with the i-th on the other."""
    n = np.array([len(x) for p in pairs for x in p], np.int64)
    both = n[0::2] + n[1::2]
    if not both.any():
        return np.ones(len(pairs))
    # All anchors of all pairs end to end, the left side of a pair before its right side; sorted by anchor, then place.
    values = np.concatenate([x for p in pairs for x in p])
    run = np.repeat(np.arange(len(n)), n)
    bits = len(values).bit_length()
    key = np.sort(values << bits | np.arange(len(values)))
    place, value = key & ((1 << bits) - 1), key >> bits
    pair = run[place] >> 1
    start = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (pair[1:] != pair[:-1]))))
    size = np.diff(np.append(start, len(values)))
    right = np.add.reduceat(run[place] & 1, start)
    count = np.minimum(right, size - right)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    to = np.full(len(values), -1)
    to[place[np.repeat(start, count) + within]] = place[np.repeat(start + size - right, count) + within]
    left = np.flatnonzero(to >= 0)
    to = to[left]
    if not len(to):
        return (both == 0).astype(np.float64)
    # Where all places before are smaller than all after, a new block begins; what rises in the blocks adds up.
    top, low = np.maximum.accumulate(to), np.minimum.accumulate(to[::-1])[::-1]
    first = np.flatnonzero(np.concatenate(([True], top[:-1] < low[1:])))
    size = np.diff(np.append(first, len(to)))
    rising = np.ones(len(first), np.int64)
    for i in np.flatnonzero(size > 1).tolist():
        rising[i] = _rising(to[first[i]:first[i] + size[i]].tolist())
    matched = np.bincount(run[left[first]] >> 1, rising, len(pairs))
    return np.where(both == 0, 1.0, 2 * matched / np.maximum(both, 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of two texts that can be matched in the same order."""
    return float(alike([(a, b)])[0])


def _ranges(ids: DataFrame) -> list[int]:
    """Ascending lower bounds of id ranges with about equal rows; one approximate-quantile pass over the ids alone."""
    n = ids.count()
    most = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))
    if n == 0 or most < 2:
        return []
    at = ids.agg(F.percentile_approx("doc_id", [i / most for i in range(1, most)], 10 * most).alias("q")).first()["q"] or []
    return sorted(set(at))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, place) ordered by descending id within a part; the row that follows a part's last one is added to
    it with ``carry`` set. Every text moves once; only the head of each range, one row, is copied."""
    d = texts(docs).select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    bounds = _ranges(d.select("doc_id"))
    at = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(), side="right").astype(np.int32))

    d = d.withColumn("part", part_of("doc_id") if bounds else F.lit(0))
    # One head per range reaches the driver; their number is that of the ranges.
    heads = sorted((r["part"], r["top"]) for r in d.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    d = d.withColumn("carry", F.lit(0))
    if not heads:
        return d
    spark = docs.sparkSession
    follow = [(top, heads[(i + 1) % len(heads)][0]) for i, (_, top) in enumerate(heads)]
    wanted = spark.createDataFrame(follow, "doc_id bigint, part int")
    carried = d.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "part").agg(F.min("text").alias("text"))
    d = d.unionByName(carried.select("doc_id", F.lit(False).alias("no_id"), "text", "part", F.lit(1).alias("carry")))
    # One task for each range: by a hash of the number, several ranges would fall to one task and none to others.
    return d.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "carry", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple] = []  # the last row so far, whose next one is still to come
        for b in batches:
            for i, j in slices(flat(b.column("text"))[1], SLICE):
                doc_id, no_id, many, part, carry = (b.column(c).slice(i, j - i).to_pylist() for c in ("doc_id", "no_id", "text", "part", "carry"))
                values, first = anchors_of(many, k, s)
                own = [values[x:y] for x, y in zip(first, first[1:])]
                ids = [None if none else x for x, none in zip(doc_id, no_id)]
                seen = before + list(zip(ids, many, own, part, carry))
                yield finish([(x, y) for x, y in zip(seen, seen[1:]) if not x[4] and x[3] == y[3]])
                # A copy: the row must not hold the anchors of its whole slice.
                before = [(*seen[-1][:2], seen[-1][2].copy(), *seen[-1][3:])]

    def finish(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
        edited = [t[:len(t) - len(t) // 2] + following[:len(t) // 2] for (_, t, *_), (_, following, *_) in pairs]
        values, first = anchors_of(edited, k, s)
        changed = [values[x:y] for x, y in zip(first, first[1:])]
        own = [x[2] for x, _ in pairs]
        columns = [[x[0] for x, _ in pairs], [len(x[1]) for x, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [digits(a) for a in own], [digits(a) for a in changed],
                   alike(list(zip(own, changed))), alike([(x[2], y[2]) for x, y in pairs]), [len(a) for a in own]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return neighbours(docs).mapInArrow(rows, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors bigint")
