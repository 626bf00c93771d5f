"""Pages of an ordered result by key, not by offset.

A page is the rows between two keys. ``after`` continues from the last row shown, which needs nothing prepared. For jumping to any
page, ``page_starts`` numbers the keys once, range partition by range partition, and keeps the first key of each page; a page is
then a predicate on the sort key, which prunes sorted files, and only the page's own rows are sorted.

The order must be total: its last key tells rows apart that agree on the others.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import durable
from . import ordered


@dataclass(frozen=True)
class Key:
    """A sort key: a column (or a field, as in ``ip_start.hi``), its direction, and where NULL goes (as Spark does by default)."""

    name: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    def order(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last() if self.last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.last else c.asc_nulls_first()

    def beyond(self, value) -> Column:
        """Rows whose key comes strictly after a value."""
        c = F.col(self.name)
        if value is None:
            return F.lit(False) if self.last else c.isNotNull()
        past = F.coalesce((c < F.lit(value)) if self.descending else (c > F.lit(value)), F.lit(False))
        return past | c.isNull() if self.last else past

    def outside(self, value) -> Column | None:
        """A plain comparison that all rows at or after the value meet, for the scan; none where NULL comes later."""
        if value is None or self.last:
            return None
        return (F.col(self.name) <= F.lit(value)) if self.descending else (F.col(self.name) >= F.lit(value))


def keys(*order: str | Key) -> list[Key]:
    return [k if isinstance(k, Key) else Key(k) for k in order]


def _following(order: list[Key], values: list, own: bool) -> Column:
    """Rows after the place of ``values`` in the order, with the row itself if ``own``."""
    out, equal = None, None
    for k, v in zip(order, values):
        step = k.beyond(v) if equal is None else equal & k.beyond(v)
        out = step if out is None else out | step
        same = F.col(k.name).eqNullSafe(F.lit(v))
        equal = same if equal is None else equal & same
    return out | equal if own else out


def _columns(order: list[Key]) -> list[Column]:
    return [F.col(k.name).alias(f"_k{i}") for i, k in enumerate(order)]


def cursor(row: Row, order: list[Key]) -> str:
    """Text that marks a row's place in the order."""
    def value(name):
        out = row
        for part in name.split("."):
            out = out[part]
        return out

    return json.dumps([value(k.name) for k in order])


def after(df: DataFrame, order: list[Key], mark: str | None, limit: int) -> DataFrame:
    """The ``limit`` rows after a cursor (the first ones without), with ``more``: whether others follow."""
    rows = df
    if mark is not None:
        values = json.loads(mark)
        rows = df.where(_following(order, values, own=False))
        bound = order[0].outside(values[0])
        rows = rows if bound is None else rows.where(bound)
    w = Window.orderBy(*[k.order() for k in order])
    # A report of one page: limit + 1 rows reach the numbering.
    head = rows.orderBy(*[k.order() for k in order]).limit(limit + 1).withColumn("row_no", F.row_number().over(w))
    return head.withColumn("more", F.max("row_no").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("row_no") <= limit).drop("row_no")


def page_starts(df: DataFrame, order: list[Key], rows: int, parts: int | None = None) -> DataFrame:
    """(page, rows, _k0, _k1, ...): the key at which each page of ``rows`` rows begins, from 0. Raises if the order is not total."""
    renamed = [Key(f"_k{i}", k.descending, k.nulls_last) for i, k in enumerate(order)]
    by = [k.order() for k in renamed]
    pinned = ordered.pin(df.select(*_columns(order)), *by, parts=parts)
    sizes = pinned.groupBy(ordered.PART).count()
    # One row for each range partition.
    offsets = sizes.select(ordered.PART, F.coalesce(F.sum("count").over(Window.orderBy(ordered.PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy(ordered.PART).orderBy(*by)
    own = F.struct(*[F.col(k.name) for k in renamed])
    # Rows of one key lie in one partition, so a neighbour inside it is enough to find them.
    numbered = pinned.withColumns({"_n": F.row_number().over(w), "_twin": F.lag(own).over(w).eqNullSafe(own)}).join(F.broadcast(offsets), ordered.PART)
    at = F.col("_off") + F.col("_n") - 1
    starts = durable(numbered.where((at % rows == 0) | F.col("_twin")).select((at / rows).cast("bigint").alias("page"), F.lit(rows).alias("rows"), "_twin", *[k.name for k in renamed]))
    if not starts.where("_twin").isEmpty():
        raise ValueError("the order does not tell all rows apart; add a key that does")
    return starts.drop("_twin")


def page(df: DataFrame, order: list[Key], starts: DataFrame, number: int) -> DataFrame:
    """The rows of one page with ``row_no`` (from 1 over the whole result) and ``more``."""
    held = {r["page"]: r for r in starts.where(F.col("page").isin(number, number + 1)).collect()}  # two rows at most
    if number not in held:
        return df.limit(0).withColumns({"row_no": F.lit(0).cast("bigint"), "more": F.lit(False)})
    place = lambda r: [r[f"_k{i}"] for i in range(len(order))]
    first, rows = place(held[number]), held[number]["rows"]
    inside = df.where(_following(order, first, own=True))
    bound = order[0].outside(first[0])
    inside = inside if bound is None else inside.where(bound)
    if number + 1 in held:
        stop = place(held[number + 1])
        inside = inside.where(~_following(order, stop, own=True))
        if stop[0] is not None:  # the other bound, for the scan; where NULL comes first it is let through
            c, v = F.col(order[0].name), F.lit(stop[0])
            upto = (c >= v) if order[0].descending else (c <= v)
            inside = inside.where(upto if first[0] is not None else upto | c.isNull())
    w = Window.orderBy(*[k.order() for k in order])  # the page's own rows
    return inside.withColumns({"row_no": F.row_number().over(w) + F.lit(number * rows).cast("bigint"), "more": F.lit(number + 1 in held)})
