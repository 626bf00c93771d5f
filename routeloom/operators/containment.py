"""Prefix containment as equi-joins, and the closest block by a sweep.

CIDR blocks nest, so "block B covers address A" is "A cut to B's length is B's start". Where all covering blocks are wanted, a
row is expanded over the block lengths that occur (at most 33 for IPv4 and 129 for IPv6, whatever the data size) and
joined on equality. A range condition on both ends would become a nested loop. Where only the closest block is wanted, one
sweep in address order (``covering.py``) needs one row for each block and address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import addr
from . import ordered
from .covering import deepest, enclosing


def lengths(blocks: DataFrame) -> DataFrame:
    """Distinct (family, length) present; at most 162 rows by the width of the address families."""
    return (blocks.where(F.col("plen").between(0, F.when(F.col("family") == 4, 32).otherwise(128)))
            .select("family", "plen").distinct())


def candidates(rows: DataFrame, blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Each row with every block (b_plen, b_start) that could cover it.

    ``rows`` needs family, ip_start, plen. ``strict`` leaves out the row's own length. The lengths come in
    as one small array, so the expansion is a generator inside the scan's stage and no join.
    """
    axis = addr.axis_of(rows)
    present = lengths(blocks).agg(F.collect_set(F.struct("family", "plen"))).scalar()
    x = F.col("_x")
    fits = (x["family"] == F.col("family")) & ((x["plen"] < F.col("plen")) if strict else (x["plen"] <= F.col("plen")))
    return (rows.withColumn("_x", present).withColumn("_x", F.explode("_x")).where(fits)
            .withColumn("b_plen", x["plen"]).drop("_x").withColumn("b_start", axis.mask("ip_start", F.col("b_plen"), "family")))


def covering(rows: DataFrame, blocks: DataFrame, carry: list[str], strict: bool = False) -> DataFrame:
    """Rows with every block covering them; block columns ``carry`` come back as ``b_<name>``.

    ``blocks`` is unique on (family, plen, ip_start) or the duplicates are wanted.
    """
    b = blocks.select("family", F.col("plen").alias("b_plen"), F.col("ip_start").alias("b_start"),
                      *[F.col(c).alias(f"b_{c}") for c in carry])
    return candidates(rows, blocks, strict).join(b, ["family", "b_plen", "b_start"])


def nearest_parents(prefixes: DataFrame) -> DataFrame:
    """(pid, parent_pid, parent_plen) for every prefix lying inside another one."""
    return enclosing(prefixes, ["pid", "plen"]).select(
        F.col("own.pid").alias("pid"), F.col("around.pid").alias("parent_pid"), F.col("around.plen").alias("parent_plen"))


def longest_match(lookups: DataFrame, prefixes: DataFrame, carry: list[str], point: str = "ip") -> DataFrame:
    """Each lookup address with the most specific prefix covering it; NULLs when there is none.

    Addresses are made distinct for the sweep, so a hot address costs one lookup. ``lookups`` needs family and ``point`` in
    the prefixes' address form; ``carry`` names prefix columns to bring back.
    """
    best = deepest(lookups.select("family", F.col(point).alias("ip_start")), prefixes, carry)
    return lookups.join(best.withColumnRenamed("ip_start", point), ["family", point], "left")


def parents(prefixes: DataFrame, k: int | None = None) -> DataFrame:
    """All other prefixes around each prefix (or the ``k`` smallest), smallest first (column ``ord``)."""
    pairs = covering(prefixes.select("family", "ip_start", "plen", "pid"), prefixes, ["pid", "prefix"], strict=True)
    return (ordered.ranked(pairs, "pid", F.desc("b_plen"), k=k)
            .select("pid", "ord", F.col("b_pid").alias("parent_pid"), F.col("b_prefix").alias("parent_prefix"),
                    F.col("b_plen").alias("parent_plen")))


def children(prefixes: DataFrame, k: int | None = None) -> DataFrame:
    """All prefixes inside each prefix (or the first ``k``) in address order (shorter first at one address)."""
    pairs = covering(prefixes.select("family", "ip_start", "plen", "pid", "prefix"), prefixes, ["pid"], strict=True)
    return (ordered.ranked(pairs, "b_pid", "ip_start", "plen", k=k)
            .select(F.col("b_pid").alias("pid"), "ord", F.col("pid").alias("child_pid"),
                    F.col("prefix").alias("child_prefix"), F.col("plen").alias("child_plen")))


def overlapping(prefixes: DataFrame, start, end) -> DataFrame:
    """Prefixes sharing an address with a literal interval: everything around it and everything inside.

    Plain comparisons on the stored columns, so Parquet statistics prune.
    """
    return prefixes.where((F.col("ip_start") <= end) & (F.col("ip_end") >= start))
