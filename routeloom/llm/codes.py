"""Vector code compression: vectors are cut into parts, and each part is coded as the index of its nearest codebook entry.
Codebooks come from Lloyd's rounds in whole numbers, assigned with two trees.

Each batch of rows builds, for each part, a tree over its points (box, number and sum of every node) and a tree over the
entries. A pair of nodes is judged by the least and the largest distance between their boxes: an entry node whose least
distance is beyond another's largest is pruned for all points of the node, and when one entry is left the whole node goes to it
with its cached sum. Otherwise the wider of the two nodes is opened; a leaf of points that is still uncertain computes
distances in whole numbers. A pair is pruned only when it is strictly farther, so ties reach the leaves and go to the lower index.

Tasks send one row per codebook cell (sum or count), which Spark sums; the driver holds the codebooks alone (``entries``
vectors). Numbers are 64-bit while that is proven exact and Python's own beyond, so any finite component is exact; an error beyond
a long is null. A row is dropped if its vector is null, holds a null or non-finite component, or differs in length from the
vector of the smallest id. A length that the parts do not divide is filled up with zeros. Rows with one id are ordered by
their vectors where an order matters; a null id comes last. An empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from routeloom.session import durable

from .common import BROADCAST_IDS

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points of a leaf; bytes of vectors (as long) in one pair of trees.
LEAF, TREE_BYTES = 64, 16 << 20
#: Cell sums travel in digits of this base, so that they fit a decimal whatever their size.
_LIMB = 1 << 64


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as long where every distance and sum of a batch is then exact, as Python numbers otherwise."""
    with np.errstate(over="ignore"):
        y = x * scale
    if not y.size or np.abs(y).max() * np.sqrt(y.shape[-1]) < 2.0 ** 29:
        return np.floor(y).astype(np.int64)
    exact = [int(np.floor(b)) if np.isfinite(b) else int(a) * scale for a, b in zip(x.ravel(), y.ravel())]
    return np.array(exact, dtype=object).reshape(x.shape)


class Tree:
    """A box tree by medians of the widest side: node i spans order[start[i]:stop[i]]; sums are kept for every node."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.order = x, np.arange(len(x))
        lo, hi, start, stop, left, total = [], [], [], [], [], []
        todo = [(0, len(x))]
        for a, b in todo:  # grows: children of a node stand side by side
            own = x[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            lo.append(low)
            hi.append(high)
            start.append(a)
            stop.append(b)
            total.append(own.sum(0))
            side = int(np.argmax(high - low)) if own.shape[1] else 0
            if b - a > leaf and own.shape[1] and high[side] > low[side]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argsort(own[:, side], kind="stable")]
                left.append(len(todo))
                todo += [(a, a + mid), (a + mid, b)]
            else:
                left.append(-1)
        self.lo, self.hi, self.total = np.array(lo, x.dtype), np.array(hi, x.dtype), np.array(total, x.dtype)
        self.start, self.stop, self.left = np.array(start), np.array(stop), np.array(left)
        self.width = ((self.hi - self.lo) ** 2).sum(1)


def assign(points: np.ndarray, entries: np.ndarray, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of each point, sums and counts by entry); both inputs hold whole numbers of one kind, entries are not empty."""
    p = tree or Tree(points, LEAF)
    # Of equal entries the lowest index wins every tie, so the tree holds it alone.
    distinct: dict[bytes | tuple, int] = {}
    for i, row in enumerate(entries.tolist()):
        distinct.setdefault(tuple(row), i)
    index = np.array(list(distinct.values()))
    e = Tree(entries[index], 1)
    square = (entries ** 2).sum(1)
    nearest = np.zeros(len(points), np.int64)
    sums, counts = np.zeros(entries.shape, entries.dtype), np.zeros(len(entries), np.int64)
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        node, front = todo.pop()
        lo, hi = p.lo[node], p.hi[node]
        while True:
            a, b = e.lo[front] - hi, lo - e.hi[front]
            least = (np.maximum(np.maximum(a, b), 0) ** 2).sum(1)
            most = (np.maximum(-a, -b) ** 2).sum(1)
            front = front[least <= most.min()]
            wide = (e.left[front] >= 0) & (e.width[front] >= p.width[node])
            if not wide.any():
                break
            children = e.left[front[wide]]
            front = np.concatenate((front[~wide], children, children + 1))
        own = p.order[p.start[node]:p.stop[node]]
        if len(front) == 1 and e.left[front[0]] < 0:
            best = index[e.order[e.start[front[0]]]]
            nearest[own] = best
            sums[best] += p.total[node]
            counts[best] += len(own)
        elif p.left[node] >= 0:
            todo += [(p.left[node], front), (p.left[node] + 1, front)]
        else:
            among = np.sort(index[np.concatenate([e.order[e.start[f]:e.stop[f]] for f in front])])
            far = square[among] - 2 * (points[own] @ entries[among].T)
            best = among[np.argmin(far, axis=1)]
            nearest[own] = best
            np.add.at(sums, best, points[own])
            np.add.at(counts, best, 1)
    return nearest, sums, counts


def _vectors(column: pa.Array, width: int, full: int) -> np.ndarray:
    """The vectors of a column (all of one width) as doubles, filled up with zeros."""
    out = np.zeros((len(column), full))
    out[:, :width] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return out


def _blocks(column: pa.Array, books: list[np.ndarray], width: int, scale: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, part, points, entries) with both as whole numbers of one kind."""
    part = books[0].shape[1]
    step = max(1, TREE_BYTES // (8 * max(1, part * len(books))))
    for i in range(0, len(column), step):
        x = whole(_vectors(column.slice(i, step), width, part * len(books)), scale)
        for k, book in enumerate(books):
            own, small = x[:, k * part:(k + 1) * part], book.astype(np.float64)
            if x.dtype == object or small.size and np.abs(small).max() * np.sqrt(part) >= 2.0 ** 29:
                yield i, i + len(x), k, own.astype(object), book
            else:
                yield i, i + len(x), k, np.ascontiguousarray(own), book.astype(np.int64)


def _sums(books: list[np.ndarray], width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = books[0].shape[1]
        total = np.zeros((len(books), len(books[0]), part + 1), dtype=object)
        for b in batches:
            for _, _, k, own, entries in _blocks(b.column("vector"), books, width, scale):
                _, sums, counts = assign(own, entries)
                total[k, :, :part] += sums
                total[k, :, part] += counts
        rows = []
        for cell, v in enumerate(total.ravel().tolist()):
            sign, v, limb = (-1, -v, 0) if v < 0 else (1, v, 0)
            while v:
                v, low = divmod(v, _LIMB)
                rows.append((cell, limb, Decimal(sign * low)))
                limb += 1
        cells, limbs, values = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(limbs, pa.int32()), pa.array(values, pa.decimal128(20, 0))], names=["cell", "limb", "v"])

    return run


def _codes(books: list[np.ndarray], width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            code, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, dtype=object)
            for i, j, k, own, entries in _blocks(b.column("vector"), books, width, scale):
                nearest, _, _ = assign(own, entries)
                code[i:j, k] = nearest
                error[i:j] += ((own - entries[nearest]) ** 2).sum(1)
            names = [c for c in b.schema.names if c != "vector"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array([x.tobytes().hex() for x in code], pa.string()), pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())],
                                             names=[*names, "code", "error"])

    return run


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Codebooks:
    """Fitted entries: ``books[part][entry]`` holds whole numbers; ``width`` is the length of the vectors."""

    def __init__(self, books: list[np.ndarray], width: int, scale: int):
        self.books, self.width, self.scale = books, width, scale

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(v) for b in self.books for row in b.tolist() for v in row).encode()).hexdigest()


def _rows(vectors: DataFrame, vec_col: str, *others: Column) -> DataFrame:
    v = F.col(f"`{vec_col}`").cast("array<double>")
    return vectors.select(*others, v.alias("vector")).where(usable(F.col("vector")))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks that start as the vectors of the smallest ids, after ``rounds`` of assigning and floored means. At most 256 entries."""
    rows = _rows(vectors, vec_col, F.col(f"`{id_col}`").cast("bigint").alias("vec_id"))
    smallest = F.col("vec_id").asc_nulls_last()
    head = rows.orderBy(smallest, "vector").limit(1).collect()
    width = len(head[0]["vector"]) if head else 0
    held = rows.where(F.size("vector") == width)
    start = [r["vector"] for r in held.orderBy(smallest, "vector").limit(entries).collect()] if head else []
    part = -(-width // parts)
    first = np.zeros((len(start), part * parts))
    first[:, :width] = np.array(start, np.float64).reshape(len(start), width)
    books = [whole(first[:, k * part:(k + 1) * part], scale).astype(object) for k in range(parts)]
    for _ in range(rounds if start and part else 0):
        sent = held.select("vector").mapInArrow(_sums(books, width, scale), "cell bigint, limb int, v decimal(20,0)")
        total = np.zeros(parts * len(start) * (part + 1), dtype=object)
        for r in sent.groupBy("cell", "limb").agg(F.sum("v").alias("v")).collect():  # entries * (width + parts) cells
            total[r["cell"]] += int(r["v"]) * _LIMB ** r["limb"]
        total = total.reshape(parts, len(start), part + 1)
        books = [np.where(t[:, part:] > 0, t[:, :part] // np.maximum(t[:, part:], 1), b) for t, b in zip(total, books)]
    return Codebooks(books, width, scale)


def encode(vectors: DataFrame, model: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, code, error) of every usable row; a code has two hex digits for each part."""
    others = [F.col(f"`{c}`") for c in (id_col, *keep)]
    rows = _rows(vectors, vec_col, *others).where(F.size("vector") == model.width)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "vector")
    if not len(model.books[0]):
        return rows.where("false").select(id_col, *keep, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    return rows.mapInArrow(_codes(model.books, model.width, model.scale), f"{kinds}, code string, error bigint")


def decode(codes: DataFrame, model: Codebooks, code_col: str = "code") -> DataFrame:
    """All columns and ``vector``: the components of the coded entries, divided by the scale again."""
    part = model.books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [b.astype(np.float64) / model.scale for b in model.books]
        for b in batches:
            out = []
            for code in b.column(code_col).to_pylist():
                out.append(None if code is None else np.concatenate([book[i] for book, i in zip(books, bytes.fromhex(code))])[:model.width])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, "vector"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.drop("vector").schema.fields)
    return codes.drop("vector").mapInArrow(run, f"{kinds}, vector array<double>") if part else codes.withColumn("vector", F.array().cast("array<double>"))


def compress(vectors: DataFrame, label_col: str = "label", **how) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256 of every usable row."""
    model = fit(vectors, **how)
    coded = durable(encode(vectors.withColumnRenamed(label_col, "code_label"), model, keep=("code_label",)))
    sums = coded.groupBy(F.col("code_label").alias("own_label")).agg(
        F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).alias("total"))  # none where one does not fit a long
    few = sums.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = coded.join(F.broadcast(sums) if few else sums, F.col("code_label").eqNullSafe(F.col("own_label")))
    return out.select("vec_id", "code", "error", F.expr("try_cast(total AS bigint)").alias("label_error"), F.lit(model.digest()).alias("codebooks_sha256"))
