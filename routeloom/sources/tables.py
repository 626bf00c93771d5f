"""Delimited and JSON feeds. Every reader has a fixed schema; row functions take frames so they can be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import addr
from .rpsl import asn_number

ROA_SCHEMA = "struct<metadata:struct<buildtime:string>,roas:array<struct<prefix:string,asn:string,maxLength:string>>>"
NETWORK_SCHEMA = ("network string, country_iso string, registered_iso string, subdivisions array<struct<en:string>>, "
                  "city_zh string, city_en string, country_zh string, country_en string")


# ---------------------------------------------------------------- origin payloads

def read_roas(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return roa_rows(raw.select(F.col("value").alias("json")))


def roa_rows(docs: DataFrame, json: str = "json") -> DataFrame:
    """Payload documents to (family, ip_start, ip_end, plen, maxlen, asn, as_of); bad rows drop out.

    A missing or zero maxLength means the prefix's own length.
    """
    d = docs.select(F.from_json(json, ROA_SCHEMA).alias("d"))
    built = F.try_to_timestamp(F.substring("d.metadata.buildtime", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    r = d.select(built.alias("as_of"), F.explode("d.roas").alias("r"))
    r = r.select("as_of", addr.cidr_bounds("r.prefix").alias("net"), asn_number(F.col("r.asn")).alias("asn"), F.trim("r.maxLength").alias("m"))
    none = F.coalesce("m", F.lit("")).isin("", "0", "null", "false")
    maxlen = F.when(none, F.col("net.plen")).otherwise(F.col("m").try_cast("int"))
    return (r.withColumn("maxlen", maxlen).where(F.col("net").isNotNull() & F.col("asn").isNotNull() & F.col("maxlen").isNotNull())
            .select("net.family", "net.ip_start", "net.ip_end", "net.plen", "maxlen", "asn", "as_of"))


# ---------------------------------------------------------------- geo

def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def city_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """``|``-separated city rows (13 fields and more), CN only; (family, ip_start, ip_end, cc, province, city).

    A header line has no numeric bounds and so drops out like any unreadable row.
    """
    f = F.split(F.regexp_replace(line, "\r$", ""), r"\|")
    at = lambda i: F.get(f, F.lit(i))
    num = lambda i: F.trim(at(i)).try_cast("bigint")
    rows = lines.where((F.size(f) >= 13) & (at(12) == "CN")).select(
        F.lit(4).alias("family"), num(2).alias("ip_start"), num(3).alias("ip_end"), F.lit("CN").alias("cc"),
        F.nullif(at(6), F.lit("")).alias("province"), F.nullif(at(7), F.lit("")).alias("city"), F.nullif(at(5), F.lit("")).alias("country_zh"))
    return rows.where(F.col("ip_start").isNotNull() & F.col("ip_end").isNotNull())


def network_rows(networks: DataFrame) -> DataFrame:
    """City-level network table to wide geo rows; the registered country stands in for a missing one."""
    n = networks.withColumn("net", addr.cidr_bounds("network"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    cc = F.coalesce(some("country_iso"), some("registered_iso"))
    return n.where(F.col("net").isNotNull() & cc.isNotNull()).select(
        "net.family", "net.ip_start", "net.ip_end", cc.alias("cc"), F.nullif(F.get("subdivisions", F.lit(0))["en"], F.lit("")).alias("province"),
        F.coalesce(some("city_zh"), some("city_en")).alias("city"), F.col("country_zh").alias("name_zh"), F.col("country_en").alias("name_en"))


def delegated_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Address-registry statistics: allocated and assigned IPv4 ranges with their country."""
    f = F.split(line, r"\|")
    at = lambda i: F.get(f, F.lit(i))
    keep = ((F.size(f) >= 7) & ~F.col(line).startswith("#") & (at(2) == "ipv4") & (at(1) != "") & (at(3) != "*")
            & at(6).isin("allocated", "assigned"))
    rows = lines.where(keep).select(addr.v4_int(at(3)).alias("ip_start"), F.trim(at(4)).try_cast("bigint").alias("n"), at(1).alias("cc"))
    return rows.where(F.col("ip_start").isNotNull() & F.col("n").isNotNull()).select(
        F.lit(4).alias("family"), "ip_start", (F.col("ip_start") + F.col("n") - 1).alias("ip_end"), "cc",
        F.lit(None).cast("string").alias("province"), F.lit(None).cast("string").alias("city"))


# ---------------------------------------------------------------- names

def asn_name_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """``<asn> <handle - description, CC>`` lines to (asn, name): the handle, at most 40 characters."""
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    rx = r"^(\d+)\s+(.*)$"
    body = F.regexp_extract(t, rx, 2)
    body = F.trim(F.when(F.contains(body, F.lit(",")), F.regexp_extract(body, r"^(.*),", 1)).otherwise(body))
    handle = F.trim(F.split_part(body, F.lit(" - "), F.lit(1)))
    return lines.where(t.rlike(rx)).select(F.regexp_extract(t, rx, 1).try_cast("bigint").alias("asn"), F.substring(handle, 1, 40).alias("name")).where(
        (F.col("name") != "") & F.col("asn").isNotNull())


def read_asn_registry(spark: SparkSession, path: str) -> DataFrame:
    """The curated name file: commented CSV with asn, name, name_en, op."""
    raw = spark.read.csv(path, header=True, comment="#", schema="asn string, name string, name_en string, op string", enforceSchema=False)
    return asn_registry_rows(raw)


def asn_registry_rows(raw: DataFrame) -> DataFrame:
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return raw.where(F.trim("asn").rlike(r"^\d+$")).select(F.trim("asn").try_cast("bigint").alias("asn"), text("name").alias("name"),
                                                            F.nullif(text("name_en"), F.lit("")).alias("name_en"), text("op").alias("op"))


# ---------------------------------------------------------------- document corpora

def read_json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON document per file: (name, json)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("json"))


def read_rdap(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """RDAP answers as (kind, key, json); the key is the file name without its ending."""
    return read_json_documents(spark, path).select(F.lit(kind).alias("kind"), F.regexp_replace("name", r"\.json$", "").alias("key"), "json")


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files by explicit list."""
    return spark.read.parquet(*paths)
