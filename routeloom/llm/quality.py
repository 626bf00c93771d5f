"""Quality classifier: Bradley-Terry ranking on pairs of documents, cut at a quantile of the scores.

Null and empty texts have the feature row of an empty text and get a score like any other. Repeated rows get equal
scores. Without labels of both kinds there is nothing to rank: every score is then 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from routeloom.session import durable

from .common import flat, fold_of, slices, texts

#: Labelled rows that the ranking is fitted on at most, chosen by a hash of their id.
MAX_LABELLED = 20_000
#: A document is kept at this score; the quantile cut is mapped to it.
CUT = 0.3
PAIRS, STEPS, RATE, SHRINK = 2048, 400, 0.05, 1e-4

# Byte classes: control, newline, space, lower, upper, digit, stop, comma, quote and bracket, mark, dash and slash, high lead, high tail
_CLASSES = 13


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for k, chars in enumerate(["", "\n", " \t\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".!?", ",;:", "\"'()[]{}", "#$%&*+<=>@^_`|~", "-/\\"]):
        for c in chars:
            t[ord(c)] = k
    t[192:256], t[128:192] = 11, 12
    return t


_TABLE = _classes()
#: Shape numbers, counts of class pairs, and one share per printable ASCII byte.
N_FEATURES = 12 + _CLASSES * _CLASSES + 96


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of numbers per text, from its bytes alone: lengths, class pairs, single bytes and repetition."""
    n = len(offs) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    for i, j in slices(offs):
        lo, hi = int(offs[i]), int(offs[j])
        part, o = raw[lo:hi], (offs[i:j + 1] - lo).astype(np.int64)
        size = np.diff(o)
        m, whole = j - i, np.maximum(size, 1)[:, None]
        owner = np.repeat(np.arange(m), size)
        cls = _TABLE[part].astype(np.int64)
        before = np.concatenate(([0], cls[:-1])) if len(cls) else cls
        if len(cls):
            before[o[:-1][size > 0]] = 0
        pairs = np.bincount(owner * (_CLASSES ** 2) + before * _CLASSES + cls, minlength=m * _CLASSES ** 2).reshape(m, -1)
        single = np.bincount(owner * 96 + np.clip(part.astype(np.int64) - 32, 0, 95), minlength=m * 96).reshape(m, 96)
        per = pairs.reshape(m, _CLASSES, _CLASSES).sum(1)
        n_words = pairs.reshape(m, _CLASSES, _CLASSES)[:, :3, 3:].sum((1, 2))
        n_lines = per[:, 1] + 1
        packed = np.array([len(zlib.compress(part[o[k]:o[k + 1]], 1)) for k in range(m)], np.float64)
        letters = np.maximum(per[:, 3] + per[:, 4], 1)
        rows = out[i:j]
        rows[:, 0] = np.log1p(size)
        rows[:, 1] = np.log1p(n_words)
        rows[:, 2] = np.log1p(n_lines)
        rows[:, 3] = size / np.maximum(n_words, 1)
        rows[:, 3] = np.minimum(rows[:, 3], 40)
        rows[:, 4] = packed / whole[:, 0]
        rows[:, 4] = np.minimum(rows[:, 4], 2)
        rows[:, 5] = np.log1p(packed) - np.log1p(size)
        rows[:, 6] = per[:, 4] / letters
        rows[:, 7] = per[:, 9] / np.maximum(n_words, 1)
        rows[:, 8] = per[:, 6] / np.maximum(n_words, 1)
        rows[:, 9] = per[:, 5] / whole[:, 0]
        rows[:, 10] = n_words / n_lines.clip(1)
        rows[:, 10] = np.log1p(rows[:, 10])
        rows[:, 11] = size == 0
        rows[:, 12:12 + _CLASSES ** 2] = np.sqrt(pairs / whole)
        rows[:, 12 + _CLASSES ** 2:] = np.sqrt(single / whole)
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, the cut on the raw score, and the slope that maps raw scores to 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, increasing in the raw score; the quantile cut maps to ``CUT``."""
        if not len(self.weights):
            return np.full(len(x), 0.5)
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranking:
    """Logistic loss on feature differences of (better, worse) pairs; the cut is the score quantile with the best balanced accuracy."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(0), 0.0, 1.0)
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    w, first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        g = -(d / (1 + np.exp(np.clip(d @ w, -60, 60)))[:, None]).mean(0) + SHRINK * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    s = z @ w
    levels = np.quantile(s, np.linspace(0, 1, 401))
    balance = [((s[good] >= t).mean() + (s[bad] < t).mean()) / 2 for t in levels]
    best = np.flatnonzero(np.isclose(balance, max(balance)))
    cut = float(levels[best[0]] + levels[best[-1]]) / 2
    slopes = np.geomspace(0.01, 20, 60)
    base = np.log(CUT / (1 - CUT))
    loss = [np.logaddexp(0, -np.where(y == 1, 1, -1) * np.clip(a * (s - cut) + base, -60, 60)).mean() for a in slopes]
    return Ranking(mean, scale, w, cut, float(slopes[int(np.argmin(loss))]))


def labelled(labels: DataFrame, most: int = MAX_LABELLED, quality_col: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """At most ``most`` training labels, chosen by a hash of the id so that any size of table gives an even draw; the held-out fold never enters."""
    ok = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(quality_col).cast("int").alias("y"))
    ok = ok.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold_of("doc_id", folds) != held))
    return ok.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Ranking:
    """Fit on the labelled sample. The label sample is bounded, so it may be broadcast. Only features reach the driver, of at most
    ``most`` rows: of more (where labelled ids repeat), those with the smallest hashes of id and features."""
    picked = texts(docs).join(F.broadcast(labelled(labels, most)), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(*flat(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    found = durable(picked.mapInArrow(rows, "doc_id bigint, y int, x binary"))
    if found.count() > most:
        found = durable(found.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "y", "x").limit(most))
    got = found.toPandas().sort_values(["doc_id", "y", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), N_FEATURES)
    return fit(x, got["y"].to_numpy())


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """All rows and columns of ``docs`` with quality_score and quality_kept in place of any columns of these names."""
    back = [c for c in docs.columns if c.lower() not in ("quality_score", "quality_kept")]
    frame = docs.select(*[F.col(f"`{c}`") for c in back], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("quality_score"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(*flat(b.column(b.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names])

    schema = StructType([*frame.schema.fields[:-1], StructField("quality_score", DoubleType())])
    return frame.mapInArrow(rows, schema).withColumn("quality_kept", F.col("quality_score") >= CUT)
