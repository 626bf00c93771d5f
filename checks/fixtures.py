"""BGP-shaped inputs derived from the given star-schema tables.

The DuckDB side of the same derivations is in ``oracle_base.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from routeloom.functions import addr
from routeloom.functions.fixed import TIER1
from routeloom.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blocks(spark, sf) -> DataFrame:
    """One IPv4 block per part: k, family, prefix, plen, ip_start, ip_end, origin0."""
    k = F.col("p_partkey")
    plen = F.when(k % 10 == 0, 16).when(k % 10 <= 2, 20).when(k % 10 <= 5, 22).otherwise(24)
    raw = (F.lit(10) + k % 3) * 16777216 + ((k * 2053) % 65536) * 256
    df = table(spark, sf, "part").select(k.alias("k"), plen.alias("plen"), raw.alias("raw"), (F.lit(65000) + k % 50).alias("origin0"))
    return df.select("k", F.lit(4).alias("family"), "plen", addr.v4_mask("raw", "plen").alias("ip_start"),
                     (addr.v4_mask("raw", "plen") + addr.v4_size("plen") - 1).alias("ip_end"), "origin0"
                     ).withColumn("prefix", F.concat(addr.v4_text("ip_start"), F.lit("/"), F.col("plen").cast("string")))


def blocks6(spark, sf) -> DataFrame:
    """Distinct IPv6 blocks: prefix, plen, ip_start, ip_end (wide form)."""
    k = F.col("p_partkey")
    nib = F.when(k % 10 == 0, 8).when(k % 10 <= 2, 11).when(k % 10 <= 5, 12).otherwise(16)
    full = F.concat(F.when(k % 7 == 0, F.lit("fd00db8")).otherwise(F.lit("20010db")),
                    F.substring(F.lit("0123456789abcdef"), (k % 16 + 1).cast("int"), F.lit(1)),
                    F.substring(F.md5(k.cast("string").cast("binary")), 1, 24))
    cut = F.substring(F.col("full"), F.lit(1), F.col("nib"))
    return (table(spark, sf, "part").select(full.alias("full"), nib.alias("nib"))
            .select(F.lit(6).alias("family"), (F.col("nib") * 4).alias("plen"),
                    F.rpad(cut, 32, "0").alias("s"), F.rpad(cut, 32, "f").alias("e")).distinct()
            .select("family", "plen", addr.wide_from_hex("s").alias("ip_start"), addr.wide_from_hex("e").alias("ip_end"))
            .withColumn("prefix", addr.network_text("family", "ip_start", "plen")))


def entries(spark, sf) -> DataFrame:
    """One RIB entry per line item."""
    sk, ln = F.col("l_suppkey"), F.col("l_linenumber")
    tier = F.array(*[F.lit(x).cast("bigint") for x in TIER1])
    o = F.col("origin0") + F.when(F.col("l_quantity") > 45, 1).otherwise(0)
    hops = F.array((F.lit(64500) + ln).cast("bigint"),
                   F.when(sk % 7 != 0, F.get(tier, (sk % 24).cast("int"))),
                   F.when(sk % 3 == 0, F.get(tier, ((sk * 5) % 24).cast("int"))),
                   (F.lit(30000) + sk % 20).cast("bigint"), o, o)
    li = spread(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return (li.join(blocks(spark, sf), li.l_partkey == F.col("k"))
            .select(F.when(ln % 2 == 1, "rrc01").otherwise("rrc06").alias("collector"), "family", "prefix", "plen",
                    "ip_start", "ip_end", (F.lit(64500) + ln).cast("bigint").alias("peer_asn"),
                    F.concat(F.lit("192.0.2."), ln.cast("string")).alias("peer_ip"), F.array_compact(hops).alias("asns")))


def vrps(spark, sf) -> DataFrame:
    """One payload per part; half of them lie in address space no route uses."""
    k = F.col("k")
    b = blocks(spark, sf)
    wide20 = k % 10 == 7
    away = F.when((k % 10).isin(0, 1, 3, 6, 7), 0).otherwise(16 * 16777216)
    return b.select(
        "family", (F.when(wide20, F.col("ip_start") - F.col("ip_start") % 4096).otherwise(F.col("ip_start")) + away).alias("ip_start"),
        F.when(wide20, 20).otherwise(F.col("plen")).alias("plen"),
        F.when(wide20, 22).otherwise(F.least(F.col("plen") + k % 3, F.lit(32))).cast("int").alias("maxlen"),
        (F.col("origin0") + F.when(~wide20 & (k % 12 == 0), 7).otherwise(0)).alias("asn"))


def irr_routes(spark, sf) -> DataFrame:
    """One route object per part (some far from any route), every sixth registered twice."""
    k = F.col("k")
    away = F.when(k % 3 == 0, 0).otherwise(16 * 16777216)
    first = F.when(k % 2 == 0, "RIPE").otherwise("RADB")
    both = F.when(k % 6 == 0, F.array(F.lit("RIPE"), F.lit("RADB"))).otherwise(F.array(first))
    return (blocks(spark, sf).select("family", (F.col("ip_start") + away).alias("ip_start"), (F.col("ip_end") + away).alias("ip_end"),
                                     "plen", (F.col("origin0") + F.when(k % 9 == 0, 7).otherwise(0)).alias("origin"),
                                     F.explode(both).alias("source")))


def geo_raw(spark, sf) -> DataFrame:
    """Overlapping geo intervals, one per customer."""
    c = F.col("c_custkey")
    s = (F.lit(10) + c % 3) * 16777216 + ((c * 7919) % 65536) * 256
    return table(spark, sf, "customer").select(
        F.lit(4).alias("family"), s.alias("ip_start"), (s + (F.lit(1) + c % 7) * 4096 - 1).alias("ip_end"),
        F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("cc"),
        F.concat(F.lit("P"), (c % 5).cast("string")).alias("province"), F.col("c_mktsegment").alias("city"),
        F.when(c % 2 == 0, "ipdb").otherwise("geolite").alias("provider"),
        F.when(c % 2 == 0, 3).otherwise(2).alias("prio"), c.alias("tie"))
