"""The search tables and the searches on them. Every search is one lazy DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import PathPattern, compile_pattern
from . import containment, ordered


def follow_from_paths() -> dict[str, Column]:
    """Columns of the search table that follow from its ``paths``, as :func:`rib.paths_per_prefix` makes them."""
    return {"paths_blob": F.array_join("paths", "|"), "best_path": F.get("paths", F.lit(0))}


def search_table(prefixes: DataFrame, pathobs: DataFrame, per_prefix: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """One row per (prefix, origin).

    ``n_paths`` is the prefix total on every row; ``is_primary`` marks the representative origin, so a
    search by path alone can return each prefix once.
    """
    pairs = pathobs.select("pid", "origin_asn").distinct()
    # The codes come first: the blobs are then joined once a prefix, and are not shuffled again for each of its origins.
    if statuses is not None:
        pairs = pairs.join(statuses, ["pid", "origin_asn"], "left")
    codes = [c for c in pairs.columns if c not in ("pid", "origin_asn")]
    head = prefixes.select("pid", "family", "prefix", "plen", F.col("origin_asn").alias("_rep"), "n_origins", "n_paths",
                           *[F.col(c) if c in prefixes.columns else F.lit(None).cast("string").alias(c)
                             for c in ("cc", "province", "city")])
    out = head.join(pairs, "pid").join(per_prefix.select("pid", "paths", "paths_blob", "best_path"), "pid", "left")
    if statuses is not None:
        rest = [c for c in out.columns if c not in ("pid", "origin_asn", *codes)]
        out = out.select("pid", "origin_asn", *rest, *codes)
    else:
        out = out.withColumn("rpki", F.lit(0)).withColumn("irr", F.lit(0))
    return (out.withColumn("is_primary", F.col("origin_asn").eqNullSafe(F.col("_rep"))).drop("_rep")
            .withColumn("rpki", F.coalesce("rpki", F.lit(0))).withColumn("irr", F.coalesce("irr", F.lit(0))))


def low_cut(dfz_ref: float | None) -> int:
    """Least n_paths that counts as visible for a family's reference."""
    return math.ceil(max(3, 0.2 * (dfz_ref or 1)))


def visible(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows at or above the visibility cut of their family (from ``rib.visibility_reference``).

    The family follows from the prefix text. ``reference`` has one row per family.
    """
    cut = reference.select(F.col("family").alias("_fam"), F.ceil(F.greatest(F.lit(3.0), F.col("dfz_ref") * 0.2)).alias("_cut"))
    fam = F.when(F.contains("prefix", F.lit(":")), 6).otherwise(4)
    joined = df.withColumn("_fam", fam).join(F.broadcast(cut), "_fam", "left")  # two families at most
    return joined.where(F.col("n_paths") >= F.coalesce(F.col("_cut"), F.lit(3))).drop("_fam", "_cut")


def with_path(df: DataFrame, pattern: PathPattern | str) -> DataFrame:
    """Prefixes with some path matching the include part and none through an excluded AS; adds best_hit."""
    p = compile_pattern(pattern) if isinstance(pattern, str) else pattern
    out = df if p.empty else df.where(p.accepts("paths"))
    return out.withColumn("best_hit", p.best_hit("best_path"))


def by_origin(df: DataFrame, origins: list[int] | DataFrame) -> DataFrame:
    """Rows of the given origins; a DataFrame of origins (column ``asn``) becomes a semi join."""
    if isinstance(origins, DataFrame):
        return df.join(origins.select(F.col("asn").alias("origin_asn")).distinct(), "origin_asn", "left_semi")
    return df.where(F.col("origin_asn").isin([int(o) for o in origins]))


def by_person(df: DataFrame, owners: DataFrame, person: str) -> DataFrame:
    """Rows of the networks a person answers for (``owners`` has asn, person)."""
    return by_origin(df, owners.where(F.col("person") == person))


def search(table: DataFrame, *, path: str | None = None, origins: list[int] | DataFrame | None = None,
           cc: str | None = None, city: str | None = None, family: int | None = None,
           reference: DataFrame | None = None, include_low: bool = False) -> DataFrame:
    """The table search: filters, best-path hit, and the low-visibility cut unless ``include_low``."""
    df = table
    if family is not None:
        df = df.where(F.col("family") == family)
    if cc is not None:
        df = df.where(F.col("cc") == cc)
    if city:
        df = df.where(F.col("city") == city)
    df = df.where("is_primary") if origins is None else by_origin(df, origins)
    df = with_path(df, path or "")
    if not include_low and reference is not None:
        df = visible(df, reference)
    return df


def best_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("best_hit"), F.desc("n_paths"), "pid")


def page(df: DataFrame, order: list[Column], limit: int, page_no: int = 0) -> DataFrame:
    """One page and whether more follows (column ``more``).

    Fetches one row beyond the page; numbering and counting touch at most ``limit + 1`` rows.
    """
    # A top-(limit + 1) report: only this many rows reach the numbering.
    rows = df.orderBy(*order).offset(page_no * limit).limit(limit + 1)
    w = Window.orderBy(*order)
    n = F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (rows.withColumn("row_no", F.row_number().over(w)).withColumn("more", n > limit)
            .where(F.col("row_no") <= limit))


def sort_by(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Order by any column; NULL counts as smallest. ``pid`` breaks ties where there is one."""
    c = F.desc_nulls_last(column) if descending else F.asc_nulls_first(column)
    return df.orderBy(c, *(["pid"] if "pid" in df.columns and column != "pid" else []))


def subnet(prefixes: DataFrame, start, end, cc: str | None = None, city: str | None = None) -> DataFrame:
    """Everything overlapping an interval, most specific first."""
    df = containment.overlapping(prefixes, start, end)
    if cc:
        df = df.where(F.col("cc") == cc)
    if city:
        df = df.where(F.col("city") == city)
    return df.orderBy(F.desc("plen"), "ip_start")


def names_matching(names: DataFrame, query: str, cap: int | None = None) -> DataFrame:
    """Networks whose name contains the text: whole name first, then at a word start, then inside.

    ``names`` has (asn, name) with several names per network; the best rank counts. With ``cap`` a report of so many
    rows, and ``more`` tells whether others follow.
    """
    q = query.strip().lower()
    low = F.lower("name")
    at = F.instr(low, q)
    prior = F.substring(low, at - 1, F.lit(1))
    rank = (F.when(low == q, 0).when((at == 1) | prior.rlike(r"[^a-zA-Z0-9_]"), 1).otherwise(2))
    hits = (names.where((F.lit(q) != "") & (F.col("asn") != 0) & F.col("name").isNotNull())
            .where(at > 0).groupBy("asn").agg(F.min(rank).alias("rank")))
    return hits.orderBy("rank", "asn").withColumn("more", F.lit(False)) if cap is None else page(hits, [F.col("rank"), F.col("asn")], cap)


def asn_counts(table: DataFrame) -> DataFrame:
    """Originated prefixes per AS and family."""
    v6 = F.contains("prefix", F.lit(":"))
    return (table.where(F.col("origin_asn").isNotNull()).groupBy("origin_asn")
            .agg(F.count_if(~v6).alias("count4"), F.count_if(v6).alias("count6")))


def asn_prefixes(table: DataFrame, k: int | None = None) -> DataFrame:
    """The prefixes per origin (or the ``k`` most visible), most visible first."""
    return ordered.ranked(table.where(F.col("origin_asn").isNotNull()), "origin_asn", F.desc("n_paths"), "pid", k=k)


def export_rows(df: DataFrame, columns: list[str], order: list[Column], cap: int | None = None) -> DataFrame:
    """The chosen columns of a result in order, with ``capped``; with ``cap`` a report of at most so many rows."""
    if cap is None:
        return df.orderBy(*order).select(*columns, F.lit(False).alias("capped"))
    return page(df, order, cap).select(*columns, F.col("more").alias("capped"))
