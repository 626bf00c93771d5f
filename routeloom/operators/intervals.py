"""Algebra on closed address intervals, as sweeps over range-partitioned boundaries.

Every frame has ``family``, ``ip_start`` and ``ip_end`` in either address form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import addr
from . import ordered
from .containment import nearest_parents

BY = ["family"]


def _struct(cols, **named):
    return F.struct(*[F.col(c).alias(c) for c in cols], *[v.alias(k) for k, v in named.items()])


def effective_ranges(prefixes: DataFrame) -> DataFrame:
    """The addresses each prefix is the most specific match for, as ordered gaps between its children.

    Boundary sweep: at a start the deepest prefix starting there takes over; past an end the parent of the
    outermost prefix ending there does. One row per boundary, so a parent with very many children is no
    hot group.
    """
    axis = addr.axis_of(prefixes)
    keep = ["pid", "ip_start", "ip_end", "plen"]
    base = prefixes.select("family", *keep)
    up = nearest_parents(prefixes).select("pid", "parent_pid")
    owners = base.select(F.col("pid").alias("parent_pid"), _struct(keep).alias("_owner"))
    with_parent = base.join(up, "pid", "left").join(owners, "parent_pid", "left")
    starts = base.select("family", F.col("ip_start").alias("point"), _struct(keep).alias("owner"),
                         F.struct(F.lit(1).alias("s"), F.col("plen").alias("d")).alias("rank"))
    ends = with_parent.select("family", axis.succ(F.col("ip_end")).alias("point"), F.col("_owner").alias("owner"),
                              F.struct(F.lit(0).alias("s"), (-F.col("plen")).alias("d")).alias("rank"))
    marks = (starts.unionByName(ends).where(F.col("point").isNotNull())
             .groupBy("family", "point").agg(F.max_by("owner", "rank").alias("owner")))
    swept = ordered.scan(ordered.pin(marks, "family", "point"), ["point"], BY, nxt=("lead", F.col("point")))
    return (swept.where(F.col("owner").isNotNull())
            .select("family", F.col("owner.pid").alias("pid"), F.col("point").alias("ip_start"),
                    F.coalesce(axis.pred(F.col("nxt")), F.col("owner.ip_end")).alias("ip_end")))


def _sweep(left: DataFrame, right: DataFrame, left_keep: list[str], right_keep: list[str]) -> DataFrame:
    """Elementary pieces of two disjoint interval sets with the open interval of either side."""
    axis = addr.axis_of(left)
    bodies = {"l": (left, _struct(["ip_start", "ip_end", *left_keep])), "r": (right, _struct(["ip_start", "ip_end", *right_keep]))}
    kinds = {side: df.select(b.alias("b")).schema["b"].dataType.simpleString() for side, (df, b) in bodies.items()}
    sides = []
    for me, other in (("l", "r"), ("r", "l")):
        df, body = bodies[me]
        state = lambda open_, iv: F.struct(F.lit(open_).alias("open"), iv.cast(kinds[me]).alias("iv"))
        none = F.lit(None).cast(f"struct<open:boolean,iv:{kinds[other]}>")
        opened = df.select("family", F.col("ip_start").alias("point"), state(True, body).alias(me), none.alias(other))
        closed = df.select("family", axis.succ(F.col("ip_end")).alias("point"), state(False, F.lit(None)).alias(me),
                           none.alias(other)).where(F.col("point").isNotNull())
        sides += [opened, closed]
    marks = sides[0]
    for s in sides[1:]:
        marks = marks.unionByName(s)
    # "open" compares first and true is larger, so a start beats an end at the same address.
    marks = marks.groupBy("family", "point").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    marks = marks.withColumn("r_starts", F.coalesce(F.col("r.open"), F.lit(False)))
    pinned = ordered.pin(marks, "family", "point")
    return ordered.scan(pinned, ["point"], BY, lc=("last", F.col("l")), rc=("last", F.col("r")),
                        nxt=("lead", F.col("point")))


def overlap_join(left: DataFrame, right: DataFrame, left_keep: list[str], right_keep: list[str]) -> DataFrame:
    """Intersections of two disjoint interval sets, in address order within each partition."""
    axis = addr.axis_of(left)
    s = _sweep(left, right, left_keep, right_keep).where(F.col("lc.open") & F.col("rc.open"))
    return s.select("family", F.col("point").alias("ip_start"),
                    F.coalesce(axis.pred(F.col("nxt")), F.least("lc.iv.ip_end", "rc.iv.ip_end")).alias("ip_end"),
                    *[F.col(f"lc.iv.{c}").alias(c) for c in left_keep],
                    *[F.col(f"rc.iv.{c}").alias(c) for c in right_keep])


def carve(ranges: DataFrame, geo: DataFrame, cap: int | None = None) -> DataFrame:
    """Cut disjoint ranges (with ``pid``) along geo intervals, keeping the parts with a country.

    With ``cap``, a range in which more geo intervals start stays whole: it gets the country of its first
    address and no province or city, or drops out when that address has none.
    """
    axis = addr.axis_of(ranges)
    s = _sweep(ranges, geo, ["pid"], ["cc", "province", "city"]).where(F.col("lc.open"))
    s = s.select("family", "point", "nxt", "r_starts", F.col("lc.iv").alias("rg"),
                 F.when(F.col("rc.open"), F.col("rc.iv")).alias("gi"))
    fine_end = F.coalesce(axis.pred(F.col("nxt")), F.least("rg.ip_end", "gi.ip_end"))
    if cap is None:
        return s.where(F.col("gi.cc").isNotNull()).select("family", F.col("rg.pid").alias("pid"), F.col("point").alias("ip_start"), fine_end.alias("ip_end"),
                                                          *[F.col(f"gi.{c}").alias(c) for c in ("cc", "province", "city")])
    busy = (s.groupBy("family", F.col("rg.ip_start").alias("at")).agg(F.count_if("r_starts").alias("n"))
            .where(F.col("n") > cap).withColumn("coarse", F.lit(True)).drop("n"))
    pieces = (s.where(F.col("gi.cc").isNotNull()).withColumn("at", F.col("rg.ip_start"))
              .join(busy, ["family", "at"], "left").withColumn("coarse", F.coalesce("coarse", F.lit(False))))
    detail = lambda c: F.when(~F.col("coarse"), F.col(f"gi.{c}"))
    return (pieces.where(~F.col("coarse") | (F.col("point") == F.col("rg.ip_start")))
            .select("family", F.col("rg.pid").alias("pid"), F.col("point").alias("ip_start"),
                    F.when(F.col("coarse"), F.col("rg.ip_end")).otherwise(fine_end).alias("ip_end"),
                    F.col("gi.cc").alias("cc"), detail("province").alias("province"), detail("city").alias("city")))


def resolve_overlaps(raw: DataFrame, attrs: list[str], priority: str = "prio", tie: str = "tie") -> DataFrame:
    """Overlapping intervals to disjoint ones.

    Taken by start, then higher priority, then smaller tie value; each keeps what lies beyond everything
    taken before it. Copies of one interval fold first: only the first of them can leave a trace.
    """
    axis = addr.axis_of(raw)
    body = F.struct(*[F.col(a) for a in attrs], F.col(priority).alias("_p"), F.col(tie).alias("_t"))
    once = (raw.groupBy("family", "ip_start", "ip_end")
            .agg(F.min_by(body, F.struct(-F.col(priority), F.col(tie))).alias("b"))
            .select("family", "ip_start", "ip_end", "b.*").withColumn("_np", -F.col("_p")))
    order = ["ip_start", "_np", "_t"]
    s = ordered.scan(ordered.pin(once, "family", *order), order, BY, reach=("max_before", F.col("ip_end")))
    trimmed = F.when(F.col("ip_start") <= F.col("reach"), axis.succ(F.col("reach"))).otherwise(F.col("ip_start"))
    return (s.where(F.col("reach").isNull() | (F.col("ip_end") > F.col("reach")))
            .select("family", trimmed.alias("ip_start"), "ip_end", *attrs))


def merge_equal(intervals: DataFrame, attrs: list[str], extra: dict | None = None) -> DataFrame:
    """Join neighbours of a disjoint set that touch and agree on ``attrs`` (NULLs agree).

    Gaps and islands: a lag finds the breaks, a running total numbers the islands. ``extra`` maps output
    names to aggregate columns over an island.
    """
    axis = addr.axis_of(intervals)
    pinned = ordered.pin(intervals, "family", "ip_start")
    before = F.struct(F.col("ip_end").alias("e"), *[F.col(a).alias(a) for a in attrs])
    s = ordered.scan(pinned, ["ip_start"], BY, prev=("lag", before))
    joins = axis.succ(F.col("prev.e")) == F.col("ip_start")
    for a in attrs:
        joins = joins & F.col(f"prev.{a}").eqNullSafe(F.col(a))
    s = s.withColumn("breaks", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("prev")
    s = ordered.scan(s, ["ip_start"], BY, island=("sum", F.col("breaks")))
    carried = [F.first(a).alias(a) for a in attrs]
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return (s.groupBy("family", "island").agg(F.min("ip_start").alias("ip_start"), F.max("ip_end").alias("ip_end"),
                                              *carried, *more).drop("island"))


def union_intervals(intervals: DataFrame) -> DataFrame:
    """Touching or overlapping intervals of a family to their union."""
    axis = addr.axis_of(intervals)
    once = intervals.groupBy("family", "ip_start").agg(F.max("ip_end").alias("ip_end"))
    s = ordered.scan(ordered.pin(once, "family", "ip_start"), ["ip_start"], BY, reach=("max_before", F.col("ip_end")))
    beyond = F.col("reach").isNull() | F.coalesce(F.col("ip_start") > axis.succ(F.col("reach")), F.lit(False))
    s = ordered.scan(s.withColumn("breaks", F.when(beyond, 1).otherwise(0)).drop("reach"), ["ip_start"], BY,
                     island=("sum", F.col("breaks")))
    return (s.groupBy("family", "island").agg(F.min("ip_start").alias("ip_start"), F.max("ip_end").alias("ip_end"))
            .drop("island"))


def as_of(lookups: DataFrame, intervals: DataFrame, attrs: list[str], point: str = "ip_start") -> DataFrame:
    """Each lookup with the attributes of the latest interval starting at or before it, if that reaches it.

    Lookup points are made distinct for the sweep and joined back on equality.
    """
    body = _struct(["ip_end", *attrs])
    kind = intervals.select(body.alias("b")).schema["b"].dataType.simpleString()
    marks = (lookups.where(F.col(point).isNotNull())
             .select("family", F.col(point).alias("point"), F.lit(True).alias("asked"), F.lit(None).cast(kind).alias("g"))
             .unionByName(intervals.select("family", F.col("ip_start").alias("point"), F.lit(False).alias("asked"),
                                           body.alias("g")))
             .groupBy("family", "point").agg(F.bool_or("asked").alias("asked"), F.max("g").alias("g")))
    s = ordered.scan(ordered.pin(marks, "family", "point"), ["point"], BY, hit=("last", F.col("g")))
    found = (s.where(F.col("asked") & (F.col("point") <= F.col("hit.ip_end")))
             .select("family", F.col("point").alias(point), *[F.col(f"hit.{a}").alias(a) for a in attrs]))
    return lookups.join(found, ["family", point], "left")
