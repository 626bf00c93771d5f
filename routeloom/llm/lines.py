"""Line dedup by pairwise alignment: documents meet in shared lines, patience diff aligns them, and aligned common
blocks are deleted from the later one.

Lines are compared without surrounding blanks; blank lines belong to a block but never start a match. A document meets the first
document that holds a line with it, by two kinds of hashes: of a rare line (in at most ``rare`` documents), and of a window, the
consecutive lines from one on until they hold ``min_words`` words, however frequent it is. A block that could be deleted holds a
window, so windows lose no block: each goes with the first document that has it, also when every line of the block
has a different first holder. A block that the alignment leaves out because it lies in another order is aligned on its own.
So after the pass no window is left that an earlier document has. A pair is a document and a first holder, never all pairs.

Hashes of very many documents are joined by broadcast (fewer than ``HOT_SHARE`` such hashes can exist), so no task gathers them.

Rows with equal id and text are one document and get the same result; rows with one id and different texts are ordered by
a hash of the text. A null id takes no part and its row stays as it is; null and empty texts stay as they are. A very long text is
one row of hashes, 16 bytes a line; ties of windows within a document count once; further columns keep their names and values.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType

from routeloom.session import durable

from .common import _powers, mix

#: Documents that hold a rare line, at most. Windows are paired whatever their number.
RARE = 100
#: A hash held by more than one in so many of all rows is joined by broadcast.
HOT_SHARE = 2000
#: Words that an aligned block must hold to be deleted.
MIN_WORDS = 8


def _anchors(a: list[int], b: list[int], lo: int, hi: int, low: int, high: int) -> list[tuple[int, int]]:
    """Lines that occur once in either range, in the longest common order; without any, k-th occurrences stand for each other."""
    def once(x: list[int], i: int, j: int) -> dict[int, int]:
        seen: dict[int, int] = {}
        for k in range(i, j):
            seen[x[k]] = -1 if x[k] in seen else k
        return {v: k for v, k in seen.items() if k >= 0 and v}

    def numbered(x: list[int], i: int, j: int) -> dict[tuple[int, int], int]:
        count: dict[int, int] = {}
        out = {}
        for k in range(i, j):
            if x[k]:
                count[x[k]] = n = count.get(x[k], 0) + 1
                out[x[k], n] = k
        return out

    for index in (once, numbered):
        left, right = index(a, lo, hi), index(b, low, high)
        pairs = sorted((i, right[v]) for v, i in left.items() if v in right)
        if pairs:
            break
    else:
        return []
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        tops[p:p + 1] = [j]
        at[p:p + 1] = [n]
        back.append(at[p - 1] if p else -1)
    out, n = [], at[-1]
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), ascending; 0 stands for a blank line. A stack takes the place of recursion."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        i, j = lo, low
        found = _anchors(a, b, lo, hi, low, high)
        for x, y in found:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        if found:
            todo.append((i, hi, j, high))
    return sorted(out)


def common_lines(later: list[int], earlier: list[int], n_words: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Line numbers of ``later`` in aligned blocks (consecutive in both) of at least ``min_words`` words."""
    out, block, before = [], [], None
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if before is not None and (i, j) != (before[0] + 1, before[1] + 1):
            if sum(n_words[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(i)
        before = (i, j)
    return out


def windows(hashes: np.ndarray, n_words: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash) of the windows of documents that lie end to end, document d ending at ``ends[d]``."""
    total = np.concatenate(([0], np.cumsum(n_words, dtype=np.int64)))
    start = np.flatnonzero(hashes != 0)
    stop = np.searchsorted(total, total[start] + min_words)
    inside = stop <= ends[np.searchsorted(ends, start, side="right")] if len(start) else np.zeros(0, bool)
    start, stop = start[inside], stop[inside]
    up, down = _powers(len(hashes) + 1)
    folded = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(mix(hashes.astype(np.uint64)) * up[:-1])))
    return start, stop, mix((folded[stop] - folded[start]) * down[start] + (stop - start).astype(np.uint64)).view(np.int64)


def _with_windows(min_words: int):
    """Adds the hashes of each document's windows to batches of (doc_id, text_hash, hashes, n_words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("hashes")
            sizes = np.diff(column.offsets.to_numpy())
            ends = np.cumsum(sizes)
            start, _, key = windows(column.flatten().to_numpy(), b.column("n_words").flatten().to_numpy(), ends, min_words)
            each = np.searchsorted(start, np.concatenate(([0], ends)))
            held = pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.array(key, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, held], names=[*b.schema.names, "windows"])

    return run


def left_windows(later: list[int], earlier: list[int], n_words: list[int], gone: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Line numbers of windows of ``later`` that stay in spite of ``gone`` and that ``earlier`` has, in any order."""
    lost, known = set(gone), set(earlier)
    if all(i in lost or not h or h not in known for i, h in enumerate(later)):
        return []
    at: dict[int, list[int]] = {}
    for j, h in enumerate(earlier):
        if h:
            at.setdefault(h, []).append(j)
    start, stop, _ = windows(np.array(later, np.int64), np.array(n_words, np.int64), np.array([len(later)]), min_words)
    out: list[int] = []
    for i, j in zip(start.tolist(), stop.tolist()):
        if any(k not in lost for k in range(i, j)) and any(earlier[x:x + j - i] == later[i:j] for x in at.get(later[i], ())):
            out += range(i, j)
    return out


def candidate_pairs(d: DataFrame, rare: int = RARE) -> DataFrame:
    """(doc_id, text_hash, other_id, other_hash): each document with the first holders of its rare lines and of its windows."""
    short = F.array_except(F.filter("hashes", lambda h: h != 0), "windows")
    keys = F.concat(F.transform(F.array_distinct("windows"), lambda h: F.struct(h.alias("line"), F.lit(True).alias("window"))), F.transform(short, lambda h: F.struct(h.alias("line"), F.lit(False).alias("window"))))
    each = d.select("doc_id", "text_hash", F.explode(keys).alias("k")).select("doc_id", "text_hash", "k.line", "k.window")
    shared = each.groupBy("line", "window").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = durable(shared.where((F.col("n") > 1) & (F.col("window") | (F.col("n") <= rare))))
    # A hash with more than a share of the rows: by the share, there are few.
    most = max(1000, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot, cold = shared.where(F.col("n") > most).drop("n"), shared.where(F.col("n") <= most).drop("n")
    key = ["line", "window"]
    met = each.join(F.broadcast(hot), key).unionByName(each.join(cold, key))
    met = met.where(F.struct("doc_id", "text_hash") > F.col("first"))
    return met.select("doc_id", "text_hash", F.col("first.doc_id").alias("other_id"), F.col("first.text_hash").alias("other_hash")).distinct()


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(doc_id, text_hash, gone): line numbers to delete, for the documents that lose any."""
    lines = F.split("text", "\n")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"),
                 F.transform(trimmed, lambda x: F.when(x == "", 0).otherwise(F.xxhash64(x))).alias("hashes"),
                 F.transform(trimmed, lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("n_words"))
    d = d.dropDuplicates(["doc_id", "text_hash"])
    d = durable(d.mapInArrow(_with_windows(min_words), "doc_id bigint, text_hash bigint, hashes array<bigint>, n_words array<int>, windows array<bigint>"))
    pairs = candidate_pairs(d, rare)
    own = d.select("doc_id", "text_hash", "hashes", "n_words")
    other = d.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), F.col("hashes").alias("other"))
    both = pairs.join(own, ["doc_id", "text_hash"]).join(other, ["other_id", "other_hash"]).select("doc_id", "text_hash", "hashes", "n_words", "other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for i in range(b.num_rows):
                x, y, n = (b.column(c)[i].as_py() for c in ("hashes", "other", "n_words"))
                found = common_lines(x, y, n, min_words)
                gone.append(found + left_windows(x, y, n, found, min_words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "gone"])

    found = both.mapInArrow(align, "doc_id bigint, text_hash bigint, gone array<int>").where(F.size("gone") > 0)
    return found.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


@F.pandas_udf(ArrayType(BooleanType()))
def _kept(n: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for size, lost in zip(n, gone):
        mask = np.ones(size, bool)
        mask[np.asarray(lost, np.int64)] = False
        out.append(mask)
    return pd.Series(out)


def dedup(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns with the shortened text, and line_count, lines_removed and lines_left (whether any text is left).

    A document that loses no line keeps its text byte for byte; otherwise the remaining lines are joined again.
    """
    own = [c for c in docs.columns if c.lower() not in ("line_count", "lines_removed", "lines_left")]
    gone = removed_lines(docs, min_words, rare).withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*[F.col(f"`{c}`") for c in own])
    d = d.join(gone, (F.col("doc_id").cast("bigint") == F.col("gone_id")) & (F.xxhash64(body) == F.col("gone_hash")), "left")
    n = F.size(F.split(body, "\n"))
    d = d.withColumn("gone_mask", F.when(F.col("gone").isNotNull(), _kept(n, F.coalesce("gone", F.array().cast("array<int>")))))
    rest = F.array_join(F.filter(F.split(body, "\n"), lambda x, i: F.get(F.col("gone_mask"), i)), "\n")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest)
    return d.select(*[left.alias(c) if c == "text" else F.col(f"`{c}`") for c in own], F.when(body == "", 0).otherwise(n).cast("bigint").alias("line_count"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("lines_removed"), (F.col("gone").isNull() | F.trim(rest).rlike(r"\S")).alias("lines_left"))
