"""Scans along a global order without a global window.

A window without a partition key runs in one task; a window over fixed address blocks breaks down when one
block holds a large share of the rows. Instead the rows are range-partitioned on the order key, which
splits hot blocks by construction, and the partition number is pinned by a durable copy. A scan is then a
window inside each partition plus a carry from the partitions before (or after) it. The carry table has
one row per range partition and family, so broadcasting it is bounded by the partition count, whatever
the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

PART = "_part"


def pin(df: DataFrame, *order, parts: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and fix the partition number in column ``_part``.

    Later keys in ``order`` break ties, so that even rows sharing one address spread out.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    return durable(df.repartitionByRange(n, *cols).withColumn(PART, F.spark_partition_id()))


def scan(df: DataFrame, order: list, by: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """Add one column per ``name=(kind, value)`` to a pinned frame.

    Kinds, all along ``order`` within the groups ``by``:

    * ``last``      latest non-NULL value up to and including the row
    * ``max_before`` largest value strictly before the row
    * ``sum``       running total including the row
    * ``lag``/``lead`` value of the neighbouring row (wrap it in a struct if NULL must differ from absence)

    ``order`` names ascending columns, or ``Column`` sort orders for ``max_before`` and ``sum``.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    inside = Window.partitionBy(PART, *by).orderBy(*cols)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    parts_before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts_after = Window.partitionBy(*by).orderBy(PART).rowsBetween(1, Window.unboundedFollowing)

    key = lambda: F.struct(*[F.col(o) for o in order])
    edge, carry, local, final = {}, {}, {}, {}
    for name, (kind, value) in wanted.items():
        v, c, r = f"_v_{name}", f"_c_{name}", f"_l_{name}"
        if kind == "last":
            edge[v] = F.max_by(value, F.when(value.isNotNull(), key()))
            carry[c] = F.last(v, ignorenulls=True).over(parts_before)
            local[r] = F.last(value, ignorenulls=True).over(upto)
            final[name] = F.coalesce(F.col(r), F.col(c))
        elif kind == "max_before":
            edge[v] = F.max(value)
            carry[c] = F.max(v).over(parts_before)
            local[r] = F.max(value).over(before)
            final[name] = F.greatest(F.col(r), F.col(c))
        elif kind == "sum":
            edge[v] = F.sum(value)
            carry[c] = F.sum(v).over(parts_before)
            local[r] = F.sum(value).over(upto)
            final[name] = F.col(r) + F.coalesce(F.col(c), F.lit(0))
        elif kind == "lag":
            edge[v] = F.max_by(F.struct(value.alias("v")), key())
            carry[c] = F.last(v, ignorenulls=True).over(parts_before)
            local[r] = F.lag(F.struct(value.alias("v"))).over(inside)
            final[name] = F.coalesce(F.col(r), F.col(c))["v"]
        elif kind == "lead":
            edge[v] = F.min_by(F.struct(value.alias("v")), key())
            carry[c] = F.first(v, ignorenulls=True).over(parts_after)
            local[r] = F.lead(F.struct(value.alias("v"))).over(inside)
            final[name] = F.coalesce(F.col(r), F.col(c))["v"]
        else:
            raise ValueError(kind)
    edges = df.groupBy(PART, *by).agg(*[e.alias(n) for n, e in edge.items()])
    # One row per range partition (and family): bounded by the partition count.
    carries = edges.select(PART, *by, *[e.alias(n) for n, e in carry.items()])
    out = df.withColumns(local).join(F.broadcast(carries), [PART, *by], "left").withColumns(final)
    return out.drop(*local, *carry)


def ranked(df: DataFrame, by: str | list[str], *order, k: int | None = None) -> DataFrame:
    """Rows with their place ``ord`` in an order inside each group; with ``k`` the first so many of each, which Spark cuts before the shuffle."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    out = df.withColumn("ord", F.row_number().over(w))
    return out if k is None else out.where(F.col("ord") <= k)


def number_rows(df: DataFrame, order: list[str], name: str = "pid", parts: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 along a global order: a local row number plus the partition's offset."""
    pinned = pin(df, *order, parts=parts)
    sizes = pinned.groupBy(PART).count()
    offsets = sizes.select(PART, F.coalesce(F.sum("count").over(
        Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return (pinned.withColumn("_n", local).join(F.broadcast(offsets), PART)
            .withColumn(name, F.col("_offset") + F.col("_n")).drop(PART, "_offset", "_n"))
