"""From RIB entries to distinct paths and one row per prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions import paths as P
from . import ordered

PLACE = ["family", "plen", "ip_start", "ip_end"]
#: AS numbers are below this.
_ASNS = 1 << 32


def keep_family(df: DataFrame, family: int | None) -> DataFrame:
    return df if family is None else df.where(F.col("family") == family)


def union_collectors(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several collectors, each tagged with its name."""
    tagged = [df.withColumn("collector", F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def cleaned(entries: DataFrame) -> DataFrame:
    """Entries with path text, length and origin; empty paths drop out."""
    c = P.clean_path("asns")
    return (entries.where(F.size("asns") > 0).withColumn("_clean", c)
            .select(*[x for x in entries.columns if x != "asns"], P.path_key("_clean").alias("path"),
                    F.size("_clean").alias("path_len"), F.element_at("_clean", -1).alias("origin_asn")))


def _least(df: DataFrame, columns: list[str]) -> list[Column]:
    """Minima of columns that agree within a group. A 128-bit address is folded as its two words: a struct cannot be updated in a
    hash table's row, and the aggregation would sort instead."""
    def least(c):
        kind = df.schema[c].dataType
        return F.struct(*[F.min(f"{c}.{f.name}").alias(f.name) for f in kind]) if isinstance(kind, StructType) else F.min(c)

    return [least(c).alias(c) for c in columns]


def _fold(df: DataFrame, keys: list[str], peers) -> DataFrame:
    return df.groupBy(*keys).agg(*_least(df, [*PLACE, "path_len", "origin_asn"]), peers.alias("n_peers"))


def observations(entries: DataFrame) -> DataFrame:
    """Distinct paths per collector and prefix; ``n_peers`` counts RIB entries."""
    return _fold(cleaned(entries), ["collector", "prefix", "path"], F.count(F.lit(1)))


def merge_collectors(obs: DataFrame) -> DataFrame:
    """Distinct paths per prefix over all collectors."""
    return _fold(obs, ["prefix", "path"], F.sum("n_peers"))


def distinct_paths(entries: DataFrame) -> DataFrame:
    """``merge_collectors(observations(entries))`` in one shuffle: the counts simply add up."""
    return _fold(cleaned(entries), ["prefix", "path"], F.count(F.lit(1)))


def origin_weights(pathobs: DataFrame) -> DataFrame:
    """Peers and distinct paths per (prefix, origin)."""
    return pathobs.groupBy("prefix", "origin_asn").agg(
        *_least(pathobs, PLACE), F.sum("n_peers").alias("ns"), F.count(F.lit(1)).alias("np"))


def prefix_dimension(pathobs: DataFrame) -> DataFrame:
    """One row per prefix: totals, number of origins and the origin most peers see (smallest on ties).

    The first level folds a hot prefix down to its origins before the second shuffle. Peers and origin are packed into one
    number (peers first, then the smaller origin as the larger rest; up to 2^30 peers), whose maximum is hash-aggregated.
    """
    weights = origin_weights(pathobs)
    rest = F.coalesce(F.lit(_ASNS) - F.col("origin_asn"), F.lit(0).cast("bigint"))  # 0: no origin
    best = F.max(F.col("ns") * F.lit(2 * _ASNS) + rest) % F.lit(2 * _ASNS)
    return weights.groupBy("prefix").agg(
        *_least(weights, PLACE), best.alias("_best"),
        F.count("origin_asn").alias("n_origins"),
        F.sum("ns").alias("n_paths"),
        F.sum("np").alias("n_distinct_paths")).select(
        "prefix", *PLACE, F.when(F.col("_best") > 0, F.lit(_ASNS) - F.col("_best")).alias("origin_asn"), "n_origins", "n_paths", "n_distinct_paths")


def with_pids(prefixes: DataFrame) -> DataFrame:
    """Surrogate ids in address order, prefix text breaking ties."""
    return ordered.number_rows(prefixes, ["ip_start", "prefix"], "pid")


def attach_pids(pathobs: DataFrame, prefixes: DataFrame) -> DataFrame:
    return pathobs.join(prefixes.select("pid", "prefix"), "prefix")


def ranked_paths(pathobs: DataFrame, cap: int | None = None, key: str = "pid") -> DataFrame:
    """All paths per prefix with their rank: shortest, then most peers, then text.

    With ``cap`` only so many best ones; the rank filter then lets Spark cut each group down before the shuffle.
    """
    w = Window.partitionBy(key).orderBy("path_len", F.desc("n_peers"), "path")
    ranked = pathobs.withColumn("rank", F.row_number().over(w))
    return (ranked if cap is None else ranked.where(F.col("rank") <= cap)).withColumn("is_best", F.col("rank") == 1)


def exported_paths(ranked: DataFrame) -> DataFrame:
    """The published path table."""
    return ranked.select("pid", P.padded("path").alias("path_str"), P.path_array("path").alias("path_arr"),
                         "path_len", "n_peers", "is_best")


def paths_per_prefix(ranked: DataFrame, key: str = "pid") -> DataFrame:
    """All kept paths of a prefix in rank order as an array, the blob form and the best one.

    The paths of one prefix are as many as the collectors' peers can make; ranks make their order.
    """
    listed = F.sort_array(F.collect_list(F.struct("rank", P.padded("path").alias("p"))))
    return (ranked.groupBy(key).agg(listed.alias("_l"))
            .select(key, F.transform("_l", lambda x: x["p"]).alias("paths"))
            .withColumn("paths_blob", F.array_join("paths", "|"))
            .withColumn("best_path", F.get("paths", F.lit(0))))


def multi_origin(weights: DataFrame, statuses: DataFrame | None = None, key: str = "prefix") -> DataFrame:
    """For prefixes with several origins: aligned arrays of origins, peers, RPKI and IRR codes.

    ``weights`` has (key, origin_asn, ns); ``statuses`` optionally (key, origin_asn, rpki, irr).
    """
    w = weights.select(key, "origin_asn", "ns")
    if statuses is not None:
        w = w.join(statuses.select(key, "origin_asn", "rpki", "irr"), [key, "origin_asn"], "left")
    else:
        w = w.withColumn("rpki", F.lit(0)).withColumn("irr", F.lit(0))
    item = F.struct((-F.col("ns")).alias("o"), F.col("origin_asn").alias("asn"), F.col("ns").alias("n"),
                    F.coalesce("rpki", F.lit(0)).cast("int").alias("rpki"),
                    F.coalesce("irr", F.lit(0)).cast("int").alias("irr"))
    # One row per distinct origin of a prefix has been aggregated already; the array is the result itself.
    g = w.where(F.col("origin_asn").isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_o"))
    pick = lambda f: F.transform("_o", lambda x: x[f])
    return g.where(F.size("_o") > 1).select(
        key, pick("asn").alias("origin_asns"), pick("n").alias("origin_npaths"),
        pick("rpki").alias("origin_rpki"), pick("irr").alias("origin_irr"))


def visibility_reference(prefixes: DataFrame) -> DataFrame:
    """0.9 quantile (interpolated) of ``n_paths`` per family, rounded; at least a row of 1 is implied.

    Equal values are counted first, so the quantile state grows with distinct values, not rows.
    """
    counts = prefixes.groupBy("family", "n_paths").count()
    q = F.percentile("n_paths", F.lit(0.9), F.col("count"))
    return counts.groupBy("family").agg(q.alias("q")).select(
        "family", "q", F.rint(F.coalesce("q", F.lit(1.0))).cast("bigint").alias("dfz_ref"))


def snapshot_totals(prefixes: DataFrame, pathobs: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Prefixes, paths and segments per family."""
    parts = [prefixes.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("prefixes")),
             pathobs.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("paths"))]
    if segments is not None:
        parts.append(segments.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("segments")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("what", "family", "n")
