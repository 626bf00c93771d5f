"""Places of prefixes: building the geo table, tagging, cutting into segments, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import addr
from ..functions.fixed import COUNTRY_OVERRIDE, GEO_PRIORITY
from ..functions.text import literal_map
from . import intervals as I, ordered

PLACE = ["cc", "province", "city"]


def combine_providers(city_rows: DataFrame, network_rows: DataFrame) -> DataFrame:
    """Rows of the delimited source (CN only) and of the network table, with provider and priority.

    Where the delimited source has rows, it replaces the network table for CN in IPv4.
    """
    have = city_rows.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    net = network_rows.where(~(have & (F.col("cc") == "CN") & (F.col("family") == 4)))
    cols = ["family", "ip_start", "ip_end", *PLACE]
    both = (city_rows.select(*cols).withColumn("provider", F.lit("ipdb"))
            .unionByName(net.select(*cols).withColumn("provider", F.lit("geolite"))))
    return both.withColumn("prio", F.coalesce(F.element_at(literal_map(GEO_PRIORITY), F.col("provider")), F.lit(1)))


def build_geo(raw: DataFrame, tie: str = "tie") -> DataFrame:
    """Overlapping provider intervals to a disjoint, coalesced geo table."""
    attrs = [*PLACE, *(["provider"] if "provider" in raw.columns else [])]
    flat = I.resolve_overlaps(raw, attrs, tie=tie)
    return I.merge_equal(flat, PLACE, {"provider": F.min_by("provider", "ip_start")} if "provider" in attrs else None)


def country_dimension(names: DataFrame) -> DataFrame:
    """(cc, name_zh, name_en) with the fixed overrides on top."""
    base = names.groupBy("cc").agg(F.min("name_zh").alias("name_zh"), F.min("name_en").alias("name_en"))
    spark = names.sparkSession
    over = spark.createDataFrame([(c, COUNTRY_OVERRIDE["zh"][c], COUNTRY_OVERRIDE["en"][c]) for c in COUNTRY_OVERRIDE["zh"]],
                                 "cc string, zh string, en string")
    return (base.join(F.broadcast(over), "cc", "full")
            .select("cc", F.coalesce("zh", "name_zh").alias("name_zh"), F.coalesce("en", "name_en").alias("name_en")))


def asn_organisations(rows: DataFrame) -> DataFrame:
    """First organisation per ASN in source order (``ord``), at most 80 characters."""
    return (rows.where((F.col("asn") != 0) & (F.coalesce("org", F.lit("")) != ""))
            .groupBy("asn").agg(F.substring(F.min_by("org", "ord"), 1, 80).alias("org")))


def tag_places(prefixes: DataFrame, geo: DataFrame | None) -> DataFrame:
    """Country, province and city of each prefix's network address; NULLs without a geo table."""
    if geo is None:
        return prefixes.withColumns({c: F.lit(None).cast("string") for c in PLACE})
    return I.as_of(prefixes, geo, PLACE)


def segments(prefixes: DataFrame, geo: DataFrame, cap: int | None = None, cidr_cap: int | None = None) -> DataFrame:
    """One row per (prefix, country, city): province, its CIDRs in address order, and prefix facts.

    With ``cidr_cap`` only so many CIDRs: each merged piece yields at least one, so no more pieces of a group are
    then collected. The province is the one of the group's last piece and is taken from all of them.
    """
    axis = addr.axis_of(prefixes)
    cut = I.carve(I.effective_ranges(prefixes), geo, cap)
    # Pieces of one prefix and place that touch become one before they are written as CIDRs.
    last = F.max_by(F.struct("ip_start", "province"), "ip_start")
    whole = I.merge_equal(cut, ["pid", "cc", "city"], {"tail": last})
    group = ["family", "pid", "cc", "city"]
    piece = F.struct("ip_start", addr.interval_cidrs(axis, "family", "ip_start", "ip_end").alias("cidrs"))
    if cidr_cap is not None:
        w = Window.partitionBy(*group).orderBy("ip_start")
        whole = whole.withColumn("ord", F.row_number().over(w))
        piece = F.when(F.col("ord") <= cidr_cap, piece)
    # List and province come from one pass over the pieces.
    listed = whole.groupBy(*group).agg(F.sort_array(F.collect_list(piece)).alias("_l"), F.max_by("tail.province", "ip_start").alias("province"))
    cidrs = F.flatten(F.transform("_l", lambda x: x["cidrs"]))
    out = listed.select(*group, "province", (cidrs if cidr_cap is None else F.slice(cidrs, 1, cidr_cap)).alias("segs"))
    facts = [c for c in ("prefix", "plen", "origin_asn", "n_origins", "n_paths") if c in prefixes.columns]
    return out.join(prefixes.select("pid", *facts), "pid")


def segment_rows(prefixes: DataFrame, geo: DataFrame, cap: int | None = None) -> DataFrame:
    """The segments with one row per CIDR: (family, pid, cc, city, province, at, cidr); a row is bounded, whatever the size of a place.

    ``at`` is the first address of the CIDR's piece; (pid, cc, city, at, cidr) in address order is the list of :func:`segments`.
    """
    axis = addr.axis_of(prefixes)
    pieces = I.merge_equal(I.carve(I.effective_ranges(prefixes), geo, cap), ["pid", "cc", "city", "province"])
    return pieces.select("family", "pid", "cc", "city", "province", F.col("ip_start").alias("at"), F.explode(addr.interval_cidrs(axis, "family", "ip_start", "ip_end")).alias("cidr"))


def counts_by(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Rows per key, NULL keys left out, groups below ``least`` dropped."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def top_origins(tagged: DataFrame, k: int | None = None) -> DataFrame:
    """The origins per country (or the ``k`` largest) by their IPv4 prefixes, smaller ASN on ties."""
    v4 = tagged.where((F.col("family") == 4) & F.col("cc").isNotNull() & F.col("origin_asn").isNotNull())
    n = v4.groupBy("cc", "origin_asn").agg(F.count(F.lit(1)).alias("n"))
    return ordered.ranked(n, "cc", F.desc("n"), "origin_asn", k=k)


def resolve_country(queries: DataFrame, countries: DataFrame, text: str = "text") -> DataFrame:
    """Country texts to codes: by label or code of a known country, else any two letters upper-cased.

    ``countries`` has (cc, label).
    """
    known = (countries.select(F.lower("label").alias("_k"), F.col("cc").alias("_cc"))
             .unionByName(countries.select(F.lower("cc").alias("_k"), F.col("cc").alias("_cc"))).dropDuplicates(["_k"]))
    t = F.trim(F.col(text))
    return (queries.withColumn("_k", F.lower(t)).join(known, "_k", "left")
            .withColumn("cc", F.coalesce("_cc", F.when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)))).drop("_k", "_cc"))
