"""Queries on tables that hold both families in one address order; the oracles compute in UHUGEINT."""

import pyarrow as pa
from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.operators import containment as C, intervals as I, measure as M, paging, rib
from routeloom.session import durable, spread
from routeloom.sources import rib_dump, rpsl

from . import base, fixtures as fx
from .oracle_base import cte
from .q_records import scratch
from .q_stream import dump_folders
from .registry import query


def number(hex32: str) -> str:
    """SQL for the 128-bit number of 32 hex digits."""
    return f"(('0x' || substr({hex32}, 1, 16))::UBIGINT::UHUGEINT * 18446744073709551616::UHUGEINT + ('0x' || substr({hex32}, 17, 16))::UBIGINT::UHUGEINT)"


def text_of(n: str) -> str:
    """SQL for the 32 hex digits of a 128-bit number."""
    half = lambda x: f"lpad(lower(printf('%x', ({x})::UBIGINT)), 16, '0')"
    return f"({half(f'{n} // 18446744073709551616::UHUGEINT')} || {half(f'{n} % 18446744073709551616::UHUGEINT')})"


cte("mx", f"""SELECT DISTINCT 4 AS family, plen, ip_start::UHUGEINT AS s, ip_end::UHUGEINT AS e FROM fx_block
  UNION ALL SELECT 6, plen, {number('s')}, {number('e')} FROM fx_block6""")
_FULL = """((CASE WHEN {k}%7=0 THEN 'fd00db8' ELSE '20010db' END) || substr('0123456789abcdef', ({k}%16+1)::INT, 1) || substr(md5(CAST({k} AS VARCHAR)),1,24))"""
_SIX = f"substr({_FULL}, 1, 18) || substr(md5('x' || {{id}}), 1, 14)"
_FOUR = "(10 + {id}%4)*16777216 + (({k}*7919)%65536)*256 + {id}%256"


def blocks(spark, sf):
    """Both families' blocks in the wide form, with facts that follow from family and length."""
    four = fx.blocks(spark, sf).select("family", "plen", addr.wide_from_v4("ip_start").alias("ip_start"), addr.wide_from_v4("ip_end").alias("ip_end")).distinct()
    both = four.unionByName(fx.blocks6(spark, sf).select("family", "plen", "ip_start", "ip_end"))
    return both.withColumns({"prefix": addr.network_text("family", "ip_start", "plen"), "origin_asn": F.col("plen").cast("bigint") + 60000,
                             "cc": F.when(F.col("family") == 4, "DE").otherwise("FR"), "city": F.concat(F.lit("town"), F.col("plen").cast("string")),
                             "province": F.lit(None).cast("string")})


def _six(k, i):
    """Address of the second family near block ``k``, as 32 hex digits."""
    full = F.concat(F.when(k % 7 == 0, F.lit("fd00db8")).otherwise(F.lit("20010db")), F.substring(F.lit("0123456789abcdef"), (k % 16 + 1).cast("int"), F.lit(1)),
                    F.substring(F.md5(k.cast("string").cast("binary")), 1, 24))
    return F.concat(F.substring(full, 1, 18), F.substring(F.md5(F.concat(F.lit("x"), i.cast("string")).cast("binary")), 1, 14))


def _four(k, i):
    return (F.lit(10) + i % 4) * 16777216 + ((k * 7919) % 65536) * 256 + i % 256


def _best(points: str, extra: str) -> str:
    """SQL of the most specific block for each row of (id, family, num)."""
    return f"""SELECT p.*, b.plen AS b_plen, b.s AS b_s, {extra} FROM (SELECT p.id, p.family, p.num, max(b.plen) AS best FROM {points} p LEFT JOIN mx b ON b.family = p.family AND b.s <= p.num AND b.e >= p.num
      GROUP BY ALL) p LEFT JOIN mx b ON b.family = p.family AND b.plen = p.best AND b.s <= p.num AND b.e >= p.num"""


cte("mx_order", f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey%2 = 0 THEN 4 ELSE 6 END AS family,
  CASE WHEN o_orderkey%2 = 0 THEN ({_FOUR.format(k='o_custkey', id='o_orderkey')})::UHUGEINT ELSE {number('h')} END AS num
  FROM (SELECT *, {_SIX.format(k='o_custkey', id='o_orderkey')} AS h FROM orders)""")


@query(f"SELECT id, family, {text_of('num')} AS point, b_plen AS plen, CASE WHEN b_s IS NOT NULL THEN {text_of('coalesce(b_s, 0::UHUGEINT)')} END AS cover FROM ({_best('mx_order', '0 AS x')})")
def longest_match_mixed(spark, sf):
    """Addresses of both families in one sweep."""
    k, i = F.col("o_custkey"), F.col("o_orderkey")
    four = i % 2 == 0
    asked = fx.table(spark, sf, "orders").select(i.alias("id"), F.when(four, 4).otherwise(6).alias("family"),
                                                 F.when(four, addr.wide_from_v4(_four(k, i))).otherwise(addr.wide_from_hex(_six(k, i))).alias("ip"))
    b = blocks(spark, sf).withColumn("cover", addr.wide_hex("ip_start"))
    return C.longest_match(asked, b, ["plen", "cover"]).select("id", "family", addr.wide_hex("ip").alias("point"), "plen", "cover")


@query(f"""SELECT c.family, c.plen, {text_of('c.s')} AS child, p.plen AS parent_plen, {text_of('p.s')} AS parent FROM (SELECT c.family, c.plen, c.s, c.e, max(p.plen) AS best FROM mx c
  JOIN mx p ON p.family = c.family AND p.plen < c.plen AND p.s <= c.s AND p.e >= c.e GROUP BY ALL) c JOIN mx p ON p.family = c.family AND p.plen = c.best AND p.s <= c.s AND p.e >= c.e""")
def nearest_parents_mixed(spark, sf):
    b = blocks(spark, sf).withColumn("pid", F.struct("family", "plen", addr.wide_hex("ip_start").alias("at")))
    return C.nearest_parents(b).select("pid.family", "pid.plen", F.col("pid.at").alias("child"), "parent_plen", F.col("parent_pid.at").alias("parent"))


cte("mx_point", "SELECT DISTINCT family, s AS num FROM mx UNION SELECT family, e + 1 FROM mx")
cte("mx_owner", """SELECT p.family, p.num, max(b.plen) AS plen, lead(p.num) OVER (PARTITION BY p.family ORDER BY p.num) AS nxt FROM mx_point p
  LEFT JOIN mx b ON b.family = p.family AND b.s <= p.num AND b.e >= p.num GROUP BY p.family, p.num""")


@query(f"SELECT family, plen, {text_of('num')} AS first, {text_of('(nxt - 1)')} AS last FROM mx_owner WHERE plen IS NOT NULL AND nxt IS NOT NULL")
def effective_ranges_mixed(spark, sf):
    """What each block of either family is the closest block for, address by address."""
    b = blocks(spark, sf).withColumn("pid", F.struct("family", "plen", addr.wide_hex("ip_start").alias("at")))
    e = I.effective_ranges(b)
    return e.select("family", "pid.plen", addr.wide_hex("ip_start").alias("first"), addr.wide_hex("ip_end").alias("last"))


# ---------------------------------------------------------------- hops, DNS, bootstrap

def _hop_texts(k):
    return addr.v4_text(_four(k, k)), addr.wide_text(addr.wide_from_hex(_six(k, k)))


cte("mx_hop", f"""SELECT c_custkey * 2 AS id, 4 AS family, ({_FOUR.format(k='c_custkey', id='c_custkey')})::UHUGEINT AS num FROM customer
  UNION ALL SELECT c_custkey * 2 + 1, 6, {number('h')} FROM (SELECT *, {_SIX.format(k='c_custkey', id='c_custkey')} AS h FROM customer)""")


@query(f"""SELECT 'm' || (id // 2) AS measurement, id%2 + 2 AS ttl, family, {text_of('num')} AS point, coalesce(CASE WHEN open THEN 60000 + b_plen END, 0) AS asn,
  CASE WHEN open THEN (CASE WHEN b_plen IS NULL THEN NULL WHEN family = 4 THEN 'DE' ELSE 'FR' END) END AS cc, CASE WHEN open THEN 'town' || b_plen END AS city
  FROM (SELECT *, NOT (family = 4 AND num < 184549376::UHUGEINT) AND NOT (family = 6 AND num >= {number("'fc" + "0" * 30 + "'")}) AS open FROM ({_best('mx_hop', '0 AS x')}))
  UNION ALL SELECT 'm' || c_custkey, 1, 6, 'fe80' || repeat('0', 27) || '1', 0, NULL, NULL FROM customer""")
def hop_places_mixed(spark, sf):
    """Routers of both families on one route, placed; private and link-local ones have no place."""
    # The hops are read for their addresses and for their places.
    h = durable(M.hops(M.parse_results(_hop_docs(spark, sf))))
    points = fx.table(spark, sf, "nation").select(F.lit("none").alias("place_key"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")).limit(1)
    out = M.enrich_hops(h, M.place_addresses(h.select("ip"), blocks(spark, sf), points)).withColumn("p", addr.point_of("ip", addr.WIDE))
    return out.select("measurement", "ttl", "p.family", addr.wide_hex("p.ip").alias("point"), "asn", "cc", "city")


def _hop_docs(spark, sf):
    k = F.col("c_custkey")
    hop = lambda ip: F.struct(ip.alias("resolvedAddress"))
    four, six = _hop_texts(k)
    doc = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("finished").alias("status"), F.array(hop(F.lit("fe80::1")), hop(four), hop(six)).alias("hops")).alias("result"))).alias("results")))
    return spread(fx.table(spark, sf, "customer").select("c_custkey")).select(F.concat(F.lit("m"), k.cast("string")).alias("measurement"), F.lit("mtr").alias("type"), F.lit("t").alias("target"), doc.alias("json"))


cte("mx_page", f"""SELECT page_id * 2 AS id, 4 AS family, ({_FOUR.format(k='page_id', id='page_id')})::UHUGEINT AS num FROM pages
  UNION ALL SELECT page_id * 2 + 1, 6, {number('h')} FROM (SELECT *, {_SIX.format(k='page_id', id='page_id')} AS h FROM pages)""")


@query(f"""SELECT 'd' || (id // 2) AS domain, CASE WHEN family = 4 THEN 'A' ELSE 'AAAA' END AS qtype, {text_of('num')} AS point, 60000 + b_plen AS origin_asn, b_plen AS plen FROM ({_best('mx_page', '0 AS x')})""")
def dns_prefixes_mixed(spark, sf):
    """A and AAAA records with their closest prefix."""
    k = F.col("page_id")
    rows = None
    for (qtype, code), ip in zip((("A", 1), ("AAAA", 28)), _hop_texts(k)):
        doc = F.concat(F.lit(f'{{"Status":0,"Answer":[{{"name":"n","type":{code},"TTL":300,"data":"'), ip, F.lit('"}]}'))
        r = fx.table(spark, sf, "pages").select(F.concat(F.lit("d"), k.cast("string")).alias("domain"), F.lit(qtype).alias("qtype"), doc.alias("json"))
        rows = r if rows is None else rows.unionByName(r)
    out = M.enrich_dns(M.dns_records(rows), blocks(spark, sf))
    plen = F.split_part("prefix", F.lit("/"), F.lit(2)).cast("bigint")
    return out.select("domain", "qtype", addr.wide_hex("ip").alias("point"), "origin_asn", plen.alias("plen"))


@query(f"""SELECT id, family, {text_of('num')} AS point, CASE WHEN family = 4 THEN (CASE WHEN num // 16777216 < 12 THEN 'https://four' || (num // 16777216) || '/' END)
  WHEN num < {number("'fd" + "0" * 30 + "'")} THEN 'https://six' || substr({text_of('num')}, 8, 1) || '/' END AS base FROM mx_page""")
def bootstrap_by_ip_mixed(spark, sf):
    """Registry of addresses of both families; the second has a /32 for each of its sixteen blocks."""
    k = F.col("page_id")
    four, six = _hop_texts(k)
    ips = fx.table(spark, sf, "pages").select(F.explode(F.array(F.struct((k * 2).alias("id"), four.alias("ip")), F.struct((k * 2 + 1).alias("id"), six.alias("ip")))).alias("x")).select("x.*")
    n = F.col("n_nationkey")
    digit = F.substring(F.lit("0123456789abcdef"), (n % 16 + 1).cast("int"), F.lit(1))
    nation = fx.table(spark, sf, "nation")
    services = nation.where(n < 12).select(F.concat(n.cast("string"), F.lit(".0.0.0/8")).alias("cidr"), F.array(F.concat(F.lit("https://four"), n.cast("string"))).alias("urls")).unionByName(
        nation.where(n < 16).select(F.concat(F.lit("2001:db"), digit, F.lit("::/32")).alias("cidr"), F.array(F.lit("http://x"), F.concat(F.lit("https://six"), digit)).alias("urls")))
    found = M.bootstrap_for_ip(ips.select("ip").distinct(), services)
    out = ips.join(found, "ip").withColumn("p", addr.point_of("ip", addr.WIDE))
    return out.select("id", "p.family", addr.wide_hex("p.ip").alias("point"), "base")


@query("""SELECT page_id, CASE WHEN tld IN ('com', 'org', 'net', 'example') THEN 'https://reg.' || tld || '/' END AS base
  FROM (SELECT page_id, regexp_extract(lower(regexp_extract(url, '^https?://([^/:?]+)', 1)), '([^.]*)\\.?$', 1) AS tld FROM pages)""")
def bootstrap_by_domain(spark, sf):
    """Registry of a name by its last label."""
    host = F.upper(F.regexp_extract("url", r"^https?://([^/:?]+)", 1))
    named = fx.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(host, F.lit("."))).otherwise(host).alias("domain"))
    tld = F.get(F.array(F.lit("COM"), F.lit("org"), F.lit("net"), F.lit("example")), (F.col("r_regionkey") % 4).cast("int"))
    services = fx.table(spark, sf, "region").select(tld.alias("tld"), F.array(F.concat(F.lit("https://reg."), F.lower(tld))).alias("urls")).distinct()
    found = M.bootstrap_for_domain(named.select("domain").distinct(), services)
    return named.join(found, "domain").select("page_id", "base")


# ---------------------------------------------------------------- CIDR lists

cte("mx_range", f"""SELECT o_orderkey AS id, 6 AS family, least(a, b) AS s, greatest(a, b) AS e FROM (SELECT o_orderkey, {number('h')} AS a, {number("(substr(h, 1, 20) || substr(md5('y' || o_orderkey), 1, 12))")} AS b
    FROM (SELECT *, {_SIX.format(k='o_custkey', id='o_orderkey')} AS h FROM orders))
  UNION ALL SELECT -1 - tie, 4, s::UHUGEINT, e::UHUGEINT FROM geo_raw""")


@query(f"""WITH lvl AS (SELECT k, CAST(power(2, k) AS UHUGEINT) AS sz FROM range(50) t(k)),
  cut AS (SELECT id, family, k, sz, (s + sz - 1) // sz AS l, (e + 1) // sz AS r FROM mx_range, lvl),
  blk AS (SELECT id, family, k, l * sz AS adr FROM cut WHERE l < r AND l % 2 = 1 UNION ALL SELECT id, family, k, (r - 1) * sz FROM cut WHERE l < r AND r % 2 = 1)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY adr) AS ord, {text_of('adr')} AS at, CASE WHEN family = 4 THEN 32 ELSE 128 END - k AS plen FROM blk""".replace("WITH lvl AS", "SELECT * FROM (WITH lvl AS") + ")")
def cidr_lists_mixed(spark, sf):
    """Intervals of many blocks in both families, written as CIDRs and read back from their texts."""
    each = _intervals(spark, sf).select("id", F.posexplode(addr.wide_cidrs("family", "ip_start", "ip_end")).alias("pos", "cidr"))
    b = addr.cidr_bounds("cidr")
    return each.select("id", (F.col("pos") + 1).alias("ord"), addr.wide_hex(b["ip_start"]).alias("at"), b["plen"].alias("plen"))


def _intervals(spark, sf):
    k, i = F.col("o_custkey"), F.col("o_orderkey")
    h = _six(k, i)
    other = F.concat(F.substring(h, 1, 20), F.substring(F.md5(F.concat(F.lit("y"), i.cast("string")).cast("binary")), 1, 12))
    six = spread(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")).select(i.alias("id"), F.lit(6).alias("family"), addr.wide_from_hex(F.least(h, other)).alias("ip_start"), addr.wide_from_hex(F.greatest(h, other)).alias("ip_end"))
    four = fx.geo_raw(spark, sf).select((-F.col("tie") - 1).alias("id"), "family", addr.wide_from_v4("ip_start").alias("ip_start"), addr.wide_from_v4("ip_end").alias("ip_end"))
    return six.unionByName(four)


# ---------------------------------------------------------------- prefix table

@query(f"""SELECT 4 AS family, plen, {text_of('ip_start::UHUGEINT')} AS at, origin_asn, n_origins, n_paths, n_distinct_paths FROM pfx
  UNION ALL SELECT 6, plen, s, 65000 + plen, 1, 1, 1 FROM fx_block6""")
def prefix_dimension_mixed(spark, sf):
    """One row per prefix of either family, from dump files of two collectors."""
    folder = dump_folders(spark, sf)
    e = rib_dump.read_rib(spark, {c: f"{folder}/{c}" for c in ("rrc01", "rrc06")})
    p = rib.prefix_dimension(rib.distinct_paths(e))
    return p.select("family", "plen", addr.wide_hex("ip_start").alias("at"), "origin_asn", "n_origins", "n_paths", "n_distinct_paths")


# ---------------------------------------------------------------- a registry directory

def _write_objects(folder):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                system, path = rib_dump.file_system(f"{folder}/{r['kind']}/{r['name']}")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path, compression=None) as f:
                    f.write(r["text"].encode())
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    return run


@query("""SELECT kind, plen::BIGINT AS plen, adr, origin, CASE WHEN s_suppkey%3 = 0 THEN plen ELSE plen + s_suppkey%3 END AS maxlen, s_suppkey%2 = 0 AND o = 0 AS first FROM (
    SELECT s_suppkey, 'route' AS kind, 24 AS plen, lpad(lower(printf('%x', (172*65536 + s_suppkey)::BIGINT * 256)), 32, '0') AS adr FROM supplier WHERE s_suppkey < 60000
    UNION ALL SELECT s_suppkey, 'route6', 48, 'fd42' || lpad(lower(printf('%x', s_suppkey)), 8, '0') || repeat('0', 20) FROM supplier), LATERAL (SELECT unnest([0, 1]) AS o),
  LATERAL (SELECT (4242420000 + s_suppkey + o * 5000)::BIGINT AS origin) WHERE o = 0 OR s_suppkey%2 = 0""")
def registry_directory(spark, sf):
    """Route objects of both families from a directory of one-object files, whose names are the networks; an object may name two origins."""
    k = F.col("s_suppkey")
    s = fx.table(spark, sf, "supplier")
    h = F.lpad(F.lower(F.hex(k)), 8, "0")
    four = F.concat(addr.v4_text((F.lit(172 * 65536) + k) * 256), F.lit("/24"))
    six = F.concat(F.lit("fd42:"), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4), F.lit("::/48"))
    rows = None
    for kind, net, plen, frame in (("route", four, 24, s.where(k < 60000)), ("route6", six, 48, s)):
        text = F.concat(F.lit(f"{kind}:".ljust(20)), net, F.lit("\ndescr:   x\n+\n  more\norigin: AS"), (k + 4242420000).cast("string"),
                        F.when(k % 2 == 0, F.concat(F.lit("\norigin: AS"), (k + 4242425000).cast("string"))).otherwise(F.lit("")),
                        F.when(k % 3 != 0, F.concat(F.lit("\nmax-length: "), (k % 3 + plen).cast("string"))).otherwise(F.lit("")), F.lit("\n"))
        name = F.replace(F.replace(net, F.lit("/"), F.lit("_")), F.lit(":"), F.lit("%3A"))
        r = frame.select(F.lit(kind).alias("kind"), name.alias("name"), text.alias("text"))
        rows = r if rows is None else rows.unionByName(r)
    folder = scratch(spark)
    durable(rows.mapInArrow(_write_objects(folder), "name string"))
    out = None
    for kind in ("route", "route6"):
        objects = rpsl.read_files(spark, f"{folder}/{kind}", kind)
        bad = objects.where(F.replace("name", F.lit("_"), F.lit("/")) != F.get("attrs", F.lit(0))["value"])
        assert bad.isEmpty()
        v = rpsl.registry_vrps(objects).select(F.lit(kind).alias("kind"), "plen", addr.wide_hex("ip_start").alias("adr"), F.col("asn").alias("origin"), "maxlen")
        out = v if out is None else out.unionByName(v)
    number = F.when(F.col("kind") == "route", F.conv(F.substring("adr", 25, 6), 16, 10).cast("bigint") - 172 * 65536).otherwise(F.conv(F.substring("adr", 5, 8), 16, 10).cast("bigint"))
    return out.withColumn("first", (number % 2 == 0) & (F.col("origin") == number + 4242420000))


# ---------------------------------------------------------------- pages by key

@query("""SELECT row_no, pid, prefix, n_paths, row_no <= (total // 37) * 37 AND (row_no - 1) // 37 < (total - 1) // 37 AS more FROM
  (SELECT *, row_number() OVER (ORDER BY n_paths DESC, cc NULLS FIRST, pid) AS row_no, count(*) OVER () AS total FROM tagged)
  WHERE (row_no - 1) // 37 IN (0, 3, (total - 1) // 37)""")
def keyset_pages(spark, sf):
    """The first, the fourth and the last page of all prefixes, each found by its keys."""
    df = base.tagged(spark, sf)
    order = paging.keys(paging.Key("n_paths", True), "cc", "pid")
    starts = paging.page_starts(df, order, 37)
    last = starts.agg(F.max("page")).first()[0]
    out = None
    for n in sorted({0, 3, last}):
        p = paging.page(df, order, starts, n).select("row_no", "pid", "prefix", "n_paths", "more")
        out = p if out is None else out.unionByName(p)
    return out


@query("""SELECT row_no, hi_lo, plen FROM (SELECT row_number() OVER (ORDER BY s DESC, plen) AS row_no, s AS hi_lo, plen FROM fx_block6) WHERE row_no <= 60""")
def keyset_walk(spark, sf):
    """Three pages of twenty blocks of the second family from the end of the address space, each continued from the last row shown."""
    df = fx.blocks6(spark, sf)
    order = paging.keys(paging.Key("ip_start.hi", True), paging.Key("ip_start.lo", True), "plen")
    mark, out = None, None
    for i in range(3):
        rows = paging.after(df, order, mark, 20).orderBy(*[k.order() for k in order]).collect()  # a page
        if not rows:
            break
        mark = paging.cursor(rows[-1], order)
        p = spark.createDataFrame([(i * 20 + j + 1, r["ip_start"], r["plen"]) for j, r in enumerate(rows)], f"row_no bigint, at {addr.WIDE_TYPE}, plen int")
        out = p if out is None else out.unionByName(p)
    return out.select("row_no", addr.wide_hex("at").alias("hi_lo"), "plen")
