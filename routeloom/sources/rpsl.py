"""Registry objects: dumps of blank-line separated blocks, one-object files, change feeds.

An object is an ordered list of (key, value) pairs; keys repeat and their order matters, so it is an array
and not a map. Parsing is column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import addr
from ..operators.owners import first_of, values_of

_JOIN = "\x01"


def read_objects(spark: SparkSession, path: str | list[str], line_end: str = "\n") -> DataFrame:
    """One row (``object``) per block of a Latin-1 dump.

    Spark splits the file at blank lines; separators holding only blanks are cut afterwards. For CRLF
    files pass ``line_end="\\r\\n"``, so that the file still splits.
    """
    raw = spark.read.option("lineSep", line_end * 2).text(path)
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return split_objects(raw.select(text.alias("text")))


def split_objects(texts: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of dump texts, one row each; other columns stay. Columns object and block."""
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    blocks = F.split(t, r"\n[ \t]*\n\s*?(?=\S|[ \t+]\S|$)")
    return (texts.select(*[c for c in texts.columns if c != text], F.posexplode(blocks).alias("block", "object"))
            .where(F.trim(F.regexp_replace("object", r"\s", "")) != ""))


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A directory of one-object files to (type, name, attrs); the file name is the key.

    Hadoop paths cannot hold colons, so names of IPv6 objects are expected percent-encoded.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    # Spark reports the name percent-encoded once more.
    return raw.select(F.lit(kind).alias("type"), plain(plain(F.col("name"))).alias("name"),
                      attributes("value", file=True).alias("attrs"))


def attributes(text, file: bool = False) -> Column:
    """Object text to ``ARRAY<STRUCT<key, value>>``.

    Lines starting with blank, tab or plus continue the value above; ``#`` and ``%`` lines are remarks;
    keys are lower case. ``file=True`` is the one-object-per-file dialect: blank lines are skipped, keys
    must look like names and a continuation's plus signs are not part of the value.
    """
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "\r\n?", "\n")
    if not file:
        t = F.regexp_replace(t, r"(?m)^[#%].*\n?", "")
    t = F.regexp_replace(t, r"(?m)^\s*\n", "")
    head = r"[A-Za-z0-9][A-Za-z0-9_-]*:" if file else r"[^:\n]*:"
    # Lines that are neither a pair nor a continuation vanish, so the continuation below joins the pair above.
    t = F.regexp_replace(t, rf"(?m)^(?!{head})[^ \t+\n].*\n?", "")
    t = F.regexp_replace(t, r"\n(?=[ \t+])", _JOIN)
    lines = F.filter(F.split(t, "\n"), lambda l: l.rlike(rf"^(?![ \t+]){head}"))
    plus = r"^[ \t]*\+*[ \t]*" if file else r"^[ \t]+"

    def pair(line):
        key = F.lower(_strip(F.regexp_extract(line, r"^([^:]*):", 1)))
        parts = F.split(F.substring(line, F.instr(line, ":") + 1, F.length(line)), _JOIN)
        clean = F.transform(parts, lambda p, i: F.when(i == 0, _strip(p)).otherwise(_strip(F.regexp_replace(p, plus, ""))))
        return F.struct(key.alias("key"), F.array_join(F.filter(clean, lambda p: p != ""), " ").alias("value"))

    return F.transform(lines, pair)


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _bare(value: Column) -> Column:
    return _strip(F.split_part(value, F.lit("#"), F.lit(1)))


def asn_number(text: Column) -> Column:
    return F.regexp_extract(F.upper(_strip(text)), r"^(?:AS)?(\d+)$", 1).try_cast("bigint")


def _source(default: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(_bare(F.col("_source"))), F.lit("")), default)


def _parsed(objects: DataFrame) -> DataFrame:
    # A hard cut between parsing and use keeps the expressions from being evaluated once per field.
    return objects.withColumn("attrs", attributes("object")).drop("object")


def routes(objects: DataFrame, default_source: str | Column = "") -> DataFrame:
    """Route objects: (family, ip_start, ip_end, plen, origin, source), the first value of each key counting."""
    default = F.lit(default_source) if isinstance(default_source, str) else default_source
    kind = F.get("attrs", F.lit(0))["key"]
    keep = [c for c in objects.columns if c not in ("object", "block")]
    a = _parsed(objects).withColumn("kind", kind).where(F.col("kind").isin("route", "route6"))
    a = a.withColumn("net", addr.cidr_bounds(_bare(F.when(F.col("kind") == "route", first_of("route")).otherwise(first_of("route6")))))
    a = a.withColumn("origin", asn_number(_bare(first_of("origin")))).withColumn("_source", first_of("source"))
    return (a.where(F.col("net").isNotNull() & F.col("origin").isNotNull())
            .select(*keep, "net.family", "net.ip_start", "net.ip_end", "net.plen", "origin", _source(default).alias("source")))


def as_sets(objects: DataFrame, default_source: str | Column = "") -> DataFrame:
    """As-set objects: (name, source, descr, members); members split at commas and blanks, remarks cut."""
    default = F.lit(default_source) if isinstance(default_source, str) else default_source
    keep = [c for c in objects.columns if c not in ("object", "block")]
    a = _parsed(objects).where(F.get("attrs", F.lit(0))["key"] == "as-set").withColumn("_source", first_of("source"))
    words = F.flatten(F.transform(values_of("members"), lambda v: F.split(F.regexp_replace(F.split_part(v, F.lit("#"), F.lit(1)), " ", ","), ",")))
    words = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    words = F.filter(words, lambda w: w != "+")  # the sign of a continuation line is no member
    return (a.withColumn("name", F.upper(F.trim(first_of("as-set")))).where(F.col("name") != "")
            .select(*keep, "name", _source(default).alias("source"), F.trim(F.coalesce(first_of("descr"), F.lit(""))).alias("descr"),
                    words.alias("members")))


def registry_routes(objects: DataFrame) -> DataFrame:
    """Route objects of a registry directory, one row per origin (an object may name several)."""
    kind = F.col("type")
    net = addr.cidr_bounds(F.when(kind == "route", first_of("route")).otherwise(first_of("route6")))
    rows = (objects.where(kind.isin("route", "route6")).withColumn("net", net).where(F.col("net").isNotNull())
            .withColumn("max_text", first_of("max-length")).select("net.*", "max_text", F.explode(values_of("origin")).alias("o")))
    rows = rows.withColumn("origin", asn_number(F.col("o"))).where(F.col("origin").isNotNull())
    return rows.select("family", "ip_start", "ip_end", "plen", "origin", F.lit("DN42").alias("source"), "max_text")


def registry_vrps(objects: DataFrame) -> DataFrame:
    """The same objects as origin payloads; an unreadable max-length drops the object."""
    r = registry_routes(objects).withColumn("maxlen", F.when(F.coalesce("max_text", F.lit("")) == "", F.col("plen"))
                                            .otherwise(F.trim("max_text").try_cast("int")))
    return r.where(F.col("maxlen").isNotNull()).select("family", "ip_start", "ip_end", "plen", "maxlen", F.col("origin").alias("asn"))


def registry_sets(objects: DataFrame) -> DataFrame:
    words = F.flatten(F.transform(values_of("members"), lambda v: F.split(F.regexp_replace(F.split_part(v, F.lit("#"), F.lit(1)), " ", ","), ",")))
    return objects.where(F.col("type") == "as-set").select(
        F.upper(F.trim(F.coalesce(first_of("as-set"), F.col("name")))).alias("name"), F.lit("DN42").alias("source"),
        F.coalesce(first_of("descr"), F.lit("")).alias("descr"), F.filter(words, lambda w: w != "").alias("members"))


def feed_operations(feeds: DataFrame, text: str = "text") -> DataFrame:
    """Every operation of a change feed, whatever its object: (feed columns, seg, op, serial, text).

    A feed that lacks its start or its end mark yields nothing at all. An operation without a serial gets the one of its
    place in the range that the start mark names, or none where it names none.
    """
    others = [c for c in feeds.columns if c != text]
    whole = F.contains(text, F.lit("%START")) & F.contains(text, F.lit("%END"))
    first = F.regexp_extract(text, r"(?m)^[ \t]*%START[^\n]*?(\d+)-\d+", 1).try_cast("bigint")
    t = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(?m)^[ \t]*%.*$", "")
    parts = F.filter(F.split(t, r"(?mi)^[ \t]*(?=(?:ADD|DEL)(?:[ \t]|$))"), lambda p: p.rlike(_OPERATION))
    seg = feeds.where(whole).select(*others, first.alias("_first"), F.posexplode(parts).alias("seg", "s"))
    serial = F.coalesce(F.regexp_extract("s", _OPERATION, 2).try_cast("bigint"), F.col("_first") + F.col("seg"))
    return seg.select(*others, "seg", F.upper(F.regexp_extract("s", _OPERATION, 1)).alias("op"), serial.alias("serial"), F.regexp_replace("s", _OPERATION, "").alias("text"))


_OPERATION = r"(?i)^(ADD|DEL)[ \t]*(\d*)[^\n]*\n?"


def delta_operations(feeds: DataFrame, text: str = "text") -> DataFrame:
    """A change feed text to ordered route operations: (feed columns, ord, op, serial, route columns)."""
    blocks = split_objects(feed_operations(feeds, text)).withColumn("ord", F.struct("seg", "block")).drop("seg")
    return routes(blocks, "RADB")
