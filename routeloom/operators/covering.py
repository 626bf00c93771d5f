"""The most specific block around a point, by one sweep in address order.

Blocks nest, so along the address order the blocks that are open at a place form a stack, and its top is the most specific
match. Blocks and points are put into one range-partitioned order with one row each, whatever their families and lengths;
each partition is folded with a stack. Blocks that reach beyond their partition are handed to the partitions they reach,
which are at most one chain of lengths (33 or 129 blocks) for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import addr
from . import ordered
from .ordered import PART

_KEYS = ["_fam", "_hi", "_lo", "_kind", "_plen", "_last_hi", "_last_lo"]
#: Kinds of rows at one address: blocks come before points.
BLOCK, POINT = 0, 1


def _halves(axis: addr.Axis, point: Column) -> list[Column]:
    return [F.lit(0).cast("bigint"), point] if axis is addr.NARROW else [point["hi"], point["lo"]]


def _rows(df: DataFrame, axis: addr.Axis, kind: int, plen: Column, last: Column | None, body: Column) -> DataFrame:
    hi, lo = _halves(axis, F.col("ip_start"))
    ends = _halves(axis, last) if last is not None else [F.lit(None).cast("bigint")] * 2
    return df.select(F.col("family").cast("int").alias("_fam"), hi.alias("_hi"), lo.alias("_lo"), F.lit(kind).alias("_kind"), plen.cast("int").alias("_plen"),
                     ends[0].alias("_last_hi"), ends[1].alias("_last_lo"), body.alias("_body"))


def _ranks(*columns: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Whole numbers in the order of (family, hi, lo), the same for all columns."""
    fam, hi, lo = (np.concatenate([c[i] for c in columns]) for i in range(3))
    order = np.lexsort((lo, hi, fam))
    changed = (np.diff(fam[order]) != 0) | (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)
    rank = np.empty(len(fam), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(changed))) if len(fam) else order
    return np.split(rank, np.cumsum([len(c[0]) for c in columns])[:-1])


def _fold(wanted: int):
    """Rows of the wanted kind with the body of the innermost other block around them."""

    def run(t: pa.Table) -> pa.Table:
        def ints(name: str) -> np.ndarray:
            return t.column(name).fill_null(0).to_numpy()

        fam, plen, kind, carried = ints("_fam"), ints("_plen"), ints("_kind"), ints("_carried")
        begin, end = _ranks((fam, ints("_hi"), ints("_lo")), (fam, ints("_last_hi"), ints("_last_lo")))
        order = np.lexsort((plen, kind, begin))
        top = np.full(len(fam), -1, np.int64)
        stack: list[int] = []
        ends: list[int] = []
        for i, at, is_point, stop in zip(order.tolist(), begin[order].tolist(), (kind[order] == POINT).tolist(), end[order].tolist()):
            while stack and ends[-1] < at:
                stack.pop()
                ends.pop()
            if is_point:
                top[i] = stack[-1] if stack else -1
                continue
            up = len(stack) - 1  # a block equal to this one is no block around it
            while up >= 0 and plen[stack[up]] >= plen[i]:
                up -= 1
            top[i] = stack[up] if up >= 0 else -1
            stack.append(i)
            ends.append(stop)
        pick = np.flatnonzero((kind == wanted) & (carried == 0))
        found = pa.array(top[pick], mask=top[pick] < 0)
        body = t.column("_body").combine_chunks()
        own = t.take(pa.array(pick))
        around = body.take(found)
        return pa.table([own.column("_fam"), own.column("_hi"), own.column("_lo"), own.column("_body"), around], names=["_fam", "_hi", "_lo", "_own", "_around"])

    return run


def _sweep(rows: DataFrame, wanted: int, kind: str, parts: int | None) -> DataFrame:
    """(_fam, _hi, _lo, _own, _around) of the rows of the wanted kind."""
    pinned = ordered.pin(rows, "_fam", "_hi", "_lo", "_kind", "_plen", parts=parts)
    at = F.struct("_fam", "_hi", "_lo")
    # One row for each range partition: its first place, and the next one's.
    firsts = pinned.groupBy(PART).agg(F.min(at).alias("first"))
    nexts = firsts.select(PART, F.lead("first").over(Window.orderBy(PART)).alias("beyond"))
    starts = firsts.agg(F.collect_list(F.struct(F.col(PART).alias("p"), "first"))).scalar()
    last = F.struct(F.col("_fam"), F.col("_last_hi").alias("_hi"), F.col("_last_lo").alias("_lo"))
    open_ = pinned.where(F.col("_kind") == BLOCK).join(F.broadcast(nexts), PART).where(last >= F.col("beyond")).drop("beyond")
    reached = F.filter(F.col("_starts"), lambda x: (x["p"] > F.col(PART)) & (x["first"] <= last) & (x["first"]["_fam"] == F.col("_fam")))
    carried = (open_.withColumn("_starts", starts).withColumn("_to", F.explode(F.transform(reached, lambda x: x["p"])))
               .drop("_starts").withColumn(PART, F.col("_to")).drop("_to").withColumn("_carried", F.lit(1)))
    every = pinned.withColumn("_carried", F.lit(0)).unionByName(carried.select(*pinned.columns, "_carried"))
    return every.groupBy(PART).applyInArrow(_fold(wanted), f"_fam int, _hi bigint, _lo bigint, _own {kind}, _around {kind}")


def _place(axis: addr.Axis) -> Column:
    return F.col("_lo") if axis is addr.NARROW else F.struct(F.col("_hi").alias("hi"), F.col("_lo").alias("lo"))


def deepest(points: DataFrame, blocks: DataFrame, carry: list[str], parts: int | None = None) -> DataFrame:
    """(family, ip_start, *carry) for the distinct ``points`` (family, ip_start) that lie in a block: the columns of the most specific one.

    ``blocks`` needs family, ip_start and plen; either address form, and both families in the wide one.
    """
    axis = addr.axis_of(blocks)
    body = F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in carry])
    kind = blocks.select(body.alias("b")).schema["b"].dataType.simpleString()
    good = blocks.where(F.col("plen").between(0, addr.family_width("family")))
    rows = _rows(good, axis, BLOCK, F.col("plen"), axis.last("ip_start", "plen", "family"), body)
    asked = points.where(F.col("ip_start").isNotNull() & F.col("family").isNotNull()).select("family", "ip_start").distinct()
    rows = rows.unionByName(_rows(asked, axis, POINT, F.lit(0), None, F.lit(None).cast(kind)))
    out = _sweep(rows, POINT, kind, parts).where("_around IS NOT NULL")
    return out.select(F.col("_fam").alias("family"), _place(axis).alias("ip_start"), *[F.col(f"_around.{c}").alias(c) for c in carry])


def enclosing(blocks: DataFrame, keep: list[str], parts: int | None = None) -> DataFrame:
    """Structs (own, around) of ``keep`` for every block that lies in a shorter one: the block and the next one around it."""
    axis = addr.axis_of(blocks)
    body = F.struct(*[F.col(c) for c in keep])
    kind = blocks.select(body.alias("b")).schema["b"].dataType.simpleString()
    good = blocks.where(F.col("plen").between(0, addr.family_width("family")))
    rows = _rows(good, axis, BLOCK, F.col("plen"), axis.last("ip_start", "plen", "family"), body)
    return _sweep(rows, BLOCK, kind, parts).where("_around IS NOT NULL").select(F.col("_own").alias("own"), F.col("_around").alias("around"))
