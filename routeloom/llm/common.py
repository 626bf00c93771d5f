"""Helpers shared by the text operators: input columns, Arrow buffers, batches bounded by bytes, a size-checked semi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Ids up to this number (8 MB) may be broadcast after they have been counted.
BROADCAST_IDS = 1_000_000
#: A to Z, the only letters that are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that folds A to Z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty; every other column is pruned before the scan."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fold_of(doc_id: Column | str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def flat(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings end to end, and the n + 1 offsets into them; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    kind = pa.large_binary() if not pa.types.is_string(arr.type) else pa.large_string()
    arr = arr.cast(kind)
    if arr.null_count:
        arr = arr.fill_null("" if kind == pa.large_string() else b"")
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) whose texts hold at most ``most`` bytes together, or a single longer text, which costs its readers
    about 60 bytes a byte."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the runs of bytes other than space and tab to carriage return."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place of the array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hashed_words(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, first): 64-bit hashes of the words of texts i to j - 1 with A to Z folded; text d has first[d - i] to first[d - i + 1]."""
    for i, j in slices(offs):
        lo, hi = int(offs[i]), int(offs[j])
        part, ends_at, m = FOLD[raw[lo:hi]], offs[i:j + 1] - lo, j - i
        # A word never runs over the end of a text: breaks are put between texts, and taken out of the places again.
        starts, ends = words(np.insert(part, ends_at[1:-1], 32))
        shift = np.searchsorted(ends_at[1:-1] + np.arange(m - 1), starts, side="right")
        starts, ends = starts - shift, ends - shift
        up, down = _powers(len(part) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate((part.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _WORD)
        # Word number of each text's start; a word at the very end of a text belongs to it.
        yield i, j, hashes, np.searchsorted(starts, ends_at)


def semi(df: DataFrame, ids: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows whose key is (not) among ``ids``; ids are broadcast only after a count shows that they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti" if anti else "left_semi")
