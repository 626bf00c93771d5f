"""Traceroute and ping measurements, probe locations, DNS answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import addr
from ..functions.fixed import CENTROIDS, DNS_TYPES, TIER1_PLACES, UNKNOWN_PLACE
from ..functions.text import literal_map, place_key, place_slug
from . import containment, intervals

_STATS = "struct<min:double,max:double,avg:double,total:bigint,rcv:bigint,drop:bigint,loss:double>"
RESULT_SCHEMA = (
    "struct<results:array<struct<probe:struct<city:string,country:string,network:string,asn:bigint,latitude:double,longitude:double>,"
    "result:struct<status:string,resolvedAddress:string,"
    f"hops:array<struct<resolvedAddress:string,resolvedHostname:string,asn:array<bigint>,timings:array<struct<rtt:double>>,stats:{_STATS}>>,"
    f"timings:array<struct<rtt:double>>,stats:{_STATS}>>>>")
DNS_SCHEMA = "struct<Status:int,Answer:array<struct<name:string,type:int,TTL:bigint,data:string>>>"


def half_up(value: Column, digits: int) -> Column:
    """Round half up; what a browser's rounding gives."""
    scale = 10.0 ** digits
    return F.floor(value * scale + 0.5) / scale


def round_trip(stats: Column, timings: Column) -> Column:
    """Best round trip in ms to one decimal: the statistics' minimum, else the least sample, else NULL."""
    sampled = F.array_min(F.transform(timings, lambda t: t["rtt"]))
    return F.when(stats["rcv"] > 0, half_up(F.coalesce(stats["min"], stats["avg"], F.lit(0.0)), 1)).otherwise(half_up(sampled, 1))


def parse_results(docs: DataFrame, json: str = "json") -> DataFrame:
    """(measurement, type, target, json) to one row per probe with its result."""
    parsed = docs.withColumn("d", F.from_json(json, RESULT_SCHEMA)).drop(json)
    addresses = F.filter(F.transform("d.results", lambda r: r["result"]["resolvedAddress"]), lambda a: a.isNotNull() & (a != ""))
    return (parsed.withColumn("target_ip", F.coalesce(F.get(addresses, F.lit(0)), F.col("target")))
            .select("measurement", "type", "target_ip", F.posexplode("d.results").alias("probe", "r"))
            .select("measurement", "type", "probe", "r.probe.*", F.col("r.result").alias("result"),
                    F.coalesce(F.when(F.col("r.result.resolvedAddress") != "", F.col("r.result.resolvedAddress")), F.col("target_ip")).alias("target_ip")))


def hops(results: DataFrame) -> DataFrame:
    """One row per answered hop: (measurement, probe, type, ttl, ip, hop_asn, host, rtt, loss, is_target).

    Silent hops drop out but keep their place in the count; a ping is one hop to the target.
    """
    base = results.where(F.col("type") != "ping").select(
        "measurement", "probe", "type", "target_ip", F.posexplode("result.hops").alias("i", "h"))
    loss = lambda s: F.floor(F.coalesce(s["loss"], F.lit(0.0)) + 0.5).cast("bigint")
    trace = base.where(F.coalesce(F.col("h.resolvedAddress"), F.lit("")) != "").select(
        "measurement", "probe", "type", (F.col("i") + 1).alias("ttl"), F.col("h.resolvedAddress").alias("ip"),
        F.get("h.asn", F.lit(0)).alias("hop_asn"), F.col("h.resolvedHostname").alias("host"),
        round_trip(F.col("h.stats"), F.col("h.timings")).alias("rtt"), loss(F.col("h.stats")).alias("loss"),
        (F.col("h.resolvedAddress") == F.col("target_ip")).alias("is_target"))
    ping = results.where(F.col("type") == "ping").select(
        "measurement", "probe", "type", F.lit(1).alias("ttl"), F.col("target_ip").alias("ip"), F.lit(None).cast("bigint").alias("hop_asn"),
        F.lit(None).cast("string").alias("host"), round_trip(F.col("result.stats"), F.col("result.timings")).alias("rtt"),
        loss(F.col("result.stats")).alias("loss"), F.lit(True).alias("is_target"))
    return trace.unionByName(ping)


def public_addresses(results: DataFrame) -> DataFrame:
    """Distinct public addresses of targets and hops."""
    found = F.concat(F.array("result.resolvedAddress"),
                     F.coalesce(F.transform("result.hops", lambda h: h["resolvedAddress"]), F.array().cast("array<string>")))
    return results.select(F.explode(found).alias("ip")).where(~addr.is_private("ip")).distinct()


def unusable_place(lat: Column, lon: Column, *texts: Column) -> Column:
    """No coordinates, the null island, or an anycast address."""
    said = F.concat_ws(" ", *texts)
    return lat.isNull() | lon.isNull() | ((lat == 0) & (lon == 0)) | F.coalesce(said.rlike("(?i)anycast"), F.lit(False))


def centroid(cc) -> Column:
    """struct(lat, lon) of a country, with a fixed default."""
    c = F.upper(F.coalesce(F.col(cc) if isinstance(cc, str) else cc, F.lit("")))
    at = lambda i: F.element_at(literal_map({k: v[i] for k, v in CENTROIDS.items()}), c)
    return F.struct(F.coalesce(at(0), F.lit(UNKNOWN_PLACE[0])).alias("lat"), F.coalesce(at(1), F.lit(UNKNOWN_PLACE[1])).alias("lon"))


def tier1_place(asn) -> Column:
    a = (F.col(asn) if isinstance(asn, str) else asn).cast("int")
    at = lambda i: F.element_at(literal_map({k: v[i] for k, v in TIER1_PLACES.items()}), a)
    return F.when(at(0).isNotNull(), F.struct(at(0).alias("lat"), at(1).alias("lon")))


def _points(rows: DataFrame, text: str, blocks: DataFrame) -> DataFrame:
    """Rows with ``family`` and ``ip`` of an address text, in the address form of ``blocks``; NULL when malformed or not of their families."""
    p = addr.point_of(text, addr.axis_of(blocks))
    return rows.withColumn("_p", p).withColumns({"family": F.col("_p.family"), "ip": F.col("_p.ip")}).drop("_p")


def place_addresses(ips: DataFrame, prefixes: DataFrame, city_points: DataFrame) -> DataFrame:
    """Distinct address texts of either family with prefix facts and coordinates.

    City coordinates where known, else the country's centroid. ``prefixes`` has prefix, origin_asn, cc, city, province; narrow
    addresses hold IPv4 only, wide ones both families. ``city_points`` has place_key, lat, lon.
    """
    texts = _points(ips.select(F.col("ip").alias("text")).distinct(), "text", prefixes)
    m = containment.longest_match(texts, prefixes, ["prefix", "origin_asn", "cc", "city", "province"])
    m = m.withColumn("cc", F.when(F.col("cc") != "ZZ", F.col("cc"))).withColumn("place_key", place_key("cc", "city"))
    pts = city_points.select("place_key", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    c = centroid("cc")
    placed = m.join(pts, "place_key", "left")
    has_city = F.col("cc").isNotNull() & (F.coalesce("city", F.lit("")) != "") & F.col("_lat").isNotNull()
    pick = lambda i, fall: F.when(has_city, F.col(i)).when(F.col("cc").isNotNull(), fall)
    return placed.select(F.col("text").alias("ip"), "prefix", F.col("origin_asn").alias("geo_asn"), "cc", "city", "province",
                         pick("_lat", c["lat"]).alias("lat"), pick("_lon", c["lon"]).alias("lon"),
                         F.when(has_city, "city").when(F.col("cc").isNotNull(), "centroid").otherwise("none").alias("source"))


def enrich_hops(hop_rows: DataFrame, places: DataFrame) -> DataFrame:
    """Hops with network and place; unusable places lose their coordinates, private hops have none.

    A ping hop without a usable place drops out.
    """
    p = places.select("ip", "geo_asn", "cc", "city", "province", "lat", "lon")
    j = hop_rows.join(p, "ip", "left").withColumn("private", addr.is_private("ip"))
    bad = F.col("private") | unusable_place(F.col("lat"), F.col("lon"), F.col("city"), F.col("province"), F.col("cc"))
    geo_asn = F.when(~F.col("private"), F.col("geo_asn"))
    out = j.withColumn("asn", F.coalesce("hop_asn", geo_asn, F.lit(0))).withColumn("placed", ~bad)
    out = out.where((F.col("type") != "ping") | F.col("placed"))
    clear = lambda c: F.when(F.col("placed"), F.col(c)).alias(c)
    keep = lambda c: F.when(~F.col("private"), F.col(c)).alias(c)
    return out.select("measurement", "probe", "type", "ttl", "ip", "asn", "rtt", "loss", "is_target", keep("cc"), keep("city"), clear("lat"), clear("lon"))


def merge_ping(rounds: DataFrame, key: str = "probe") -> DataFrame:
    """Statistics over several rounds (avg, rcv, total, drop, min, max); all parts simply add up."""
    g = rounds.groupBy(key).agg(
        F.sum(F.coalesce("avg", F.lit(0.0)) * F.coalesce("rcv", F.lit(0))).alias("sum_rtt"), F.sum(F.coalesce("rcv", F.lit(0))).alias("rcv"),
        F.sum(F.coalesce("total", F.lit(0))).alias("total"), F.sum(F.coalesce("drop", F.lit(0))).alias("drop"),
        F.min("min").alias("min"), F.max("max").alias("max"))
    return show_ping(g, key)


def show_ping(sums: DataFrame, key: str = "probe") -> DataFrame:
    any_ = (F.col("total") != 0) | (F.col("rcv") != 0) | F.col("min").isNotNull()
    avg = F.when(F.col("rcv") > 0, F.col("sum_rtt") / F.col("rcv")).otherwise(0.0)
    loss = F.when(F.col("total") > 0, (F.lit(1) - F.col("rcv") / F.col("total")) * 100).otherwise(0.0)
    return sums.where(any_).select(key, half_up(F.col("min"), 3).alias("min"), half_up(F.col("max"), 3).alias("max"),
                                   half_up(avg, 3).alias("avg"), "total", "rcv", "drop", half_up(loss, 3).alias("loss"))


def probe_locations(probes: DataFrame, networks: int = 12) -> DataFrame:
    """Probes per (country, city): count, mean coordinates, the ``networks`` most common networks for display, and all of them.

    Counted per network first, so ``all_networks`` holds one item per network of the place.
    """
    p = (probes.where((F.coalesce("city", F.lit("")) != "") & (F.coalesce("country", F.lit("")) != ""))
         .withColumn("place_key", place_key("country", "city")))
    loc = p.groupBy("place_key").agg(
        F.min(F.struct("country", "city")).alias("n"), F.count(F.lit(1)).alias("count"),
        F.avg(F.coalesce("latitude", F.lit(0.0))).alias("lat"), F.avg(F.coalesce("longitude", F.lit(0.0))).alias("lon"))
    nets = p.where(F.coalesce("network", F.lit("")) != "").groupBy("place_key", "network").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce("asn", F.lit(0))).alias("asn"))
    w = Window.partitionBy("place_key").orderBy(F.desc("n"), "network")
    ranked = nets.withColumn("ord", F.row_number().over(w))
    arrays = ranked.groupBy("place_key").agg(F.sort_array(F.collect_list(F.struct("ord", "network", "asn", "n"))).alias("all_networks"))
    arrays = arrays.withColumn("networks", F.filter("all_networks", lambda x: x["ord"] <= networks))
    return loc.join(arrays, "place_key", "left").select(
        place_slug("n.country", "n.city").alias("slug"), "place_key", F.col("n.country").alias("cc"), F.col("n.city").alias("city"),
        "count", "lat", "lon", "networks", "all_networks")


def suggestions(locations: DataFrame, query: str) -> DataFrame:
    """What a text may mean: 6 places, 4 countries, 5 networks, as (kind, ord, label, n).

    ``locations`` as from :func:`probe_locations`, plus ``country`` (its display name). Networks are counted from
    all networks of each place.
    """
    q = query.strip().lower()
    hit = lambda c: F.contains(F.lower(c), F.lit(q))
    places = locations.where(hit(F.concat_ws(" ", "city", "country", "cc")))
    wl = Window.orderBy(F.desc("n"), "label")

    def ranked(df, kind, k):
        # A top-k report: the numbering sees k rows.
        top = df.orderBy(F.desc("n"), "label").limit(k)
        return top.select(F.lit(kind).alias("kind"), F.row_number().over(wl).alias("ord"), "label", "n")

    cities = places.select(F.col("slug").alias("label"), F.col("count").alias("n"))
    countries = (locations.where(hit(F.concat_ws(" ", "country", "cc"))).groupBy(F.col("cc").alias("label")).agg(F.sum("count").alias("n")))
    nets = locations.select(F.explode("all_networks").alias("w")).where(
        hit(F.col("w.network")) | F.contains(F.concat(F.lit("as"), F.col("w.asn").cast("string")), F.lit(q)))
    nets = nets.groupBy(F.col("w.asn").cast("string").alias("label")).agg(F.sum("w.n").alias("n"))
    out = ranked(cities, "city", 6).unionByName(ranked(countries, "country", 4)).unionByName(ranked(nets, "network", 5))
    return out if q else out.where(F.lit(False))


def egress_census(reports: DataFrame) -> DataFrame:
    """Reports (ip, source) to one row per canonical address: reports, distinct sources, family, default.

    The address reported most is the default (smallest text on ties).
    """
    g = (reports.where(F.coalesce("ip", F.lit("")) != "").groupBy(addr.normalize_ip("ip").alias("ip"))
         .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources")))
    top = g.agg(F.min_by("ip", F.struct(-F.col("n"), F.col("ip")))).scalar()
    return g.select("ip", "n", "sources", F.when(F.contains("ip", F.lit(":")), 6).otherwise(4).alias("family"),
                    (F.col("ip") == top).alias("is_default"))


def normalise_places(rows: DataFrame, lang: str = "en") -> DataFrame:
    """Third-party geo rows to one form; rows without finite coordinates drop out.

    Input columns ip, lat, lng, asnumber, prefix, country_code and city/prov/country with ``_en`` variants
    (texts).
    """
    def pick(base):
        z, e = F.col(base), F.col(f"{base}_en")
        first, second = (z, e) if lang == "zh" else (e, z)
        return F.coalesce(F.when(first != "", first), F.when(second != "", second), F.lit(""))

    num = lambda c: F.regexp_extract(F.col(c).cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    asn = F.regexp_extract(F.regexp_replace(F.col("asnumber").cast("string"), "(?i)^AS", ""), r"^\s*(\d+)", 1).try_cast("bigint")
    out = rows.select("ip", F.coalesce("country_code", F.lit("")).alias("cc"), pick("city").alias("_c"), pick("prov").alias("_p"),
                      pick("country").alias("_n"), asn.alias("asn"), "prefix", num("lat").alias("lat"), num("lng").alias("lon"))
    parts = F.array_distinct(F.filter(F.transform(F.array("_c", "_p", "_n"), lambda x: F.trim(x)), lambda x: x != ""))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "ip", "cc", F.coalesce(some("_c"), some("_p"), F.col("_n")).alias("city"), F.col("_p").alias("province"), "asn", "prefix",
        "lat", "lon", F.array_join(parts, " · ").alias("place"))


# ---------------------------------------------------------------- DNS and bootstrap

def dns_records(answers: DataFrame, json: str = "json") -> DataFrame:
    """(domain, qtype, json) to records of the asked type, with the answer status; TXT without its quotes."""
    code = F.element_at(literal_map(DNS_TYPES), F.col("qtype"))
    rows = (answers.withColumn("d", F.from_json(json, DNS_SCHEMA)).withColumn("code", code)
            .select("domain", "qtype", "code", F.col("d.Status").alias("status"), F.posexplode("d.Answer").alias("ord", "a")))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("a.data", F.lit("")), r'"\s+"', ""), r'^"|"$', "")
    return rows.where(F.col("a.type") == F.col("code")).select(
        "domain", "qtype", "status", "ord", F.col("a.name").alias("name"), F.col("a.TTL").alias("ttl"),
        F.when(F.col("qtype") == "TXT", plain).otherwise(F.col("a.data")).alias("data"))


def dns_status(answers: DataFrame, json: str = "json") -> DataFrame:
    """One status per domain, from the first answered type in the fixed asking order."""
    order = F.element_at(literal_map({t: i for i, t in enumerate(DNS_TYPES)}), F.col("qtype"))
    s = answers.select("domain", order.alias("o"), F.from_json(json, DNS_SCHEMA)["Status"].alias("status")).where(F.col("status").isNotNull())
    label = F.when(F.col("status") == 0, "NOERROR").when(F.col("status") == 3, "NXDOMAIN").otherwise(F.col("status").cast("string"))
    return s.groupBy("domain").agg(F.min_by("status", "o").alias("status")).withColumn("label", label)


def enrich_dns(records: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Address records (A and AAAA) with the most specific covering prefix and its origin."""
    a = _points(records.where(F.col("qtype").isin("A", "AAAA")), "data", prefixes)
    return containment.longest_match(a, prefixes, ["prefix", "origin_asn"])


def base_url(urls) -> Column:
    """The first https address, else the first, with a final slash."""
    u = F.col(urls) if isinstance(urls, str) else urls
    one = F.coalesce(F.get(F.filter(u, lambda x: x.startswith("https://")), F.lit(0)), F.get(u, F.lit(0)))
    return F.when(one.endswith("/"), one).otherwise(F.concat(one, F.lit("/")))


def bootstrap_for_asn(asns: DataFrame, services: DataFrame) -> DataFrame:
    """Registry address per AS number. ``services`` has range (``lo-hi`` or one number) and urls; ranges do not overlap."""
    lo = F.split_part("range", F.lit("-"), F.lit(1)).try_cast("bigint")
    hi = F.coalesce(F.split_part("range", F.lit("-"), F.lit(2)).try_cast("bigint"), lo)
    iv = services.select(F.lit(0).alias("family"), lo.alias("ip_start"), hi.alias("ip_end"), base_url("urls").alias("base"))
    asked = asns.select("asn", F.lit(0).alias("family"), F.col("asn").alias("ip_start"))
    return intervals.as_of(asked, iv, ["base"]).select("asn", "base")


def bootstrap_for_ip(ips: DataFrame, services: DataFrame) -> DataFrame:
    """Registry address per address or CIDR text of either family; of a CIDR its first address counts. ``services`` has cidr and urls."""
    nets = services.select(addr.cidr_bounds("cidr").alias("b"), base_url("urls").alias("base")).select("b.family", "b.ip_start", "b.plen", "base")
    texts = ips.select(F.col("ip").alias("text"), F.split_part("ip", F.lit("/"), F.lit(1)).alias("first"))
    return containment.longest_match(_points(texts, "first", nets), nets, ["base"]).select(F.col("text").alias("ip"), "base")


def bootstrap_for_domain(domains: DataFrame, services: DataFrame) -> DataFrame:
    """Registry address per domain name, by its last label. ``services`` has tld and urls; case and a final dot do not count."""
    label = F.element_at(F.split(F.regexp_replace(F.lower("domain"), r"\.$", ""), r"\."), -1)
    known = services.select(F.lower("tld").alias("_label"), base_url("urls").alias("base")).groupBy("_label").agg(F.min("base").alias("base"))
    return domains.select("domain", label.alias("_label")).join(known, "_label", "left").select("domain", "base")
