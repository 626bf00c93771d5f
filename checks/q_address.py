"""Queries: addresses, containment, interval algebra, geo."""

from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.operators import containment as C, geo as G, intervals as I, ordered

from . import base, fixtures as fx
from .oracle_base import dotted
from .registry import query


@query(f"SELECT k, {dotted('raw')} AS ip, raw AS number, raw - raw%sz AS network, raw - raw%sz + sz - 1 AS broadcast FROM fx_sized")
def v4_addresses(spark, sf):
    b = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), ((F.lit(10) + F.col("p_partkey") % 3) * 16777216 + ((F.col("p_partkey") * 2053) % 65536) * 256).alias("raw"))
    b = b.join(fx.blocks(spark, sf).select("k", "plen"), "k").withColumn("ip", addr.v4_text("raw"))
    r = addr.v4_range(F.concat("ip", F.lit("/"), F.col("plen").cast("string")))
    return b.select("k", "ip", addr.v4_int("ip").alias("number"), r["start"].alias("network"), r["end"].alias("broadcast"))


@query(f"""SELECT c_custkey, t AS ip, CASE WHEN c_custkey%300 > 255 THEN NULL ELSE 10*16777216 + (c_custkey%300)*65536 + 1 END AS number
  FROM (SELECT c_custkey, '10.' || (c_custkey%300) || '.0.1' AS t FROM customer)""")
def v4_strict_octets(spark, sf):
    c = fx.table(spark, sf, "customer").withColumn("ip", F.concat(F.lit("10."), (F.col("c_custkey") % 300).cast("string"), F.lit(".0.1")))
    return c.select("c_custkey", "ip", addr.v4_int("ip").alias("number"))


@query("SELECT s AS start_hex, e AS end_hex, plen FROM fx_block6")
def v6_ranges(spark, sf):
    """Text to range and back for every IPv6 block."""
    r = addr.v6_range("prefix")
    return fx.blocks6(spark, sf).select(addr.wide_hex(r["start"]).alias("start_hex"), addr.wide_hex(r["end"]).alias("end_hex"), r["plen"].alias("plen"))


@query("SELECT family, plen, lpad(printf('%x', ip_start), 32, '0') AS start_hex, lpad(printf('%x', ip_end), 32, '0') AS end_hex, count(*) AS n FROM fx_block GROUP BY ALL "
       "UNION ALL SELECT family, plen, s, e, 1 FROM fx_block6")
def cidr_bounds(spark, sf):
    """Network texts of both families with host bits set and in upper case."""
    four = fx.blocks(spark, sf).select(F.concat(addr.v4_text("ip_end"), F.lit("/"), F.col("plen").cast("string")).alias("t"))
    six = fx.blocks6(spark, sf).select(F.upper(addr.network_text("family", "ip_end", "plen")).alias("t"))
    b = addr.cidr_bounds("t")
    return four.unionByName(six).select(b["family"].alias("family"), b["plen"].alias("plen"), addr.wide_hex(b["ip_start"]).alias("start_hex"),
                                        addr.wide_hex(b["ip_end"]).alias("end_hex")).groupBy("family", "plen", "start_hex", "end_hex").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT s AS start_hex, TRUE AS stable, regexp_full_match(s, '(fc|fd|fe8|fe9|fea|feb).*') AS private FROM fx_block6")
def v6_canonical_text(spark, sf):
    """The canonical text of an expanded, bracketed spelling reads back to the same address."""
    b = fx.blocks6(spark, sf).withColumn("h", addr.wide_hex("ip_start"))
    long = F.concat(F.lit("["), F.upper(F.concat_ws(":", *[F.substring("h", 1 + 4 * i, 4) for i in range(8)])), F.lit("%eth0]"))
    t = F.col("t")
    return b.withColumn("t", addr.normalize_ip(F.regexp_replace(long, "%eth0", ""))).select(addr.wide_hex(addr.v6_point(t)).alias("start_hex"), (addr.normalize_ip(t) == t).alias("stable"), addr.is_private(t).alias("private")).distinct()


@query(f"""SELECT DISTINCT {dotted('a')} AS ip, CASE WHEN b0 IN (0,10,127) OR (b0=172 AND b1 BETWEEN 16 AND 31) OR (b0=192 AND b1=168) OR (b0=169 AND b1=254)
  OR (b0=100 AND b1 BETWEEN 64 AND 127) THEN TRUE ELSE FALSE END AS private FROM (SELECT a, a>>24 AS b0, (a>>16)&255 AS b1 FROM
  (SELECT (o_orderkey*7919 + o_custkey*104729*256) % 4294967296 AS a FROM orders))""")
def private_addresses(spark, sf):
    n = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729 * 256) % 4294967296
    return fx.table(spark, sf, "orders").select(addr.v4_text(n).alias("ip")).distinct().select("ip", addr.is_private("ip").alias("private"))


@query(f"""SELECT tie, ord, cidr FROM (SELECT tie, row_number() OVER (PARTITION BY tie ORDER BY adr) AS ord, {dotted('adr')} || '/' || plen AS cidr FROM step WHERE plen IS NOT NULL)"""
       .replace("FROM step", "FROM (WITH RECURSIVE step AS (SELECT tie, s AS nxt, e, CAST(NULL AS BIGINT) AS adr, CAST(NULL AS BIGINT) AS plen FROM geo_raw UNION ALL "
                "SELECT tie, nxt + sz, e, nxt, 32 - CAST(log2(sz) AS BIGINT) FROM (SELECT tie, nxt, e, least(nxt & -nxt, CAST(1 AS BIGINT) << CAST(floor(log2(e - nxt + 1)) AS INT)) AS sz "
                "FROM step WHERE nxt <= e)) SELECT * FROM step)"))
def cidr_lists(spark, sf):
    g = fx.geo_raw(spark, sf).select("tie", F.posexplode(addr.v4_cidrs("ip_start", "ip_end")).alias("pos", "cidr"))
    return g.select("tie", (F.col("pos") + 1).alias("ord"), "cidr")


@query("SELECT s AS start_hex, e AS end_hex, plen, 1 AS pieces FROM fx_block6")
def v6_cidr_lists(spark, sf):
    """A block's interval comes back as that one block."""
    b = fx.blocks6(spark, sf).withColumn("l", addr.wide_cidrs("family", "ip_start", "ip_end"))
    r = addr.v6_range(F.get("l", F.lit(0)))
    return b.select(addr.wide_hex(r["start"]).alias("start_hex"), addr.wide_hex(r["end"]).alias("end_hex"), r["plen"].alias("plen"), F.size("l").alias("pieces"))


# ---------------------------------------------------------------- containment

@query("SELECT pid, parent_pid, parent_plen FROM near")
def nearest_parents(spark, sf):
    return C.nearest_parents(base.prefixes(spark, sf))


@query("""SELECT a.s AS child_hex, a.plen, b.s AS parent_hex, b.plen AS parent_plen FROM (SELECT a.*, max(b.plen) AS pl FROM fx_block6 a JOIN fx_block6 b ON b.plen < a.plen
  AND b.s <= a.s AND b.e >= a.e GROUP BY ALL) a JOIN fx_block6 b ON b.plen = a.pl AND b.s <= a.s AND b.e >= a.e""")
def nearest_parents_v6(spark, sf):
    b = fx.blocks6(spark, sf).withColumn("pid", F.concat(addr.wide_hex("ip_start"), F.lit("/"), F.col("plen").cast("string")))
    p = C.nearest_parents(b)
    part = lambda c, i: F.split_part(c, F.lit("/"), F.lit(i))
    return p.select(part("pid", 1).alias("child_hex"), part("pid", 2).cast("bigint").alias("plen"), part("parent_pid", 1).alias("parent_hex"), "parent_plen")


@query("""SELECT pid, ord, parent_pid, parent_prefix, parent_plen FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY parent_plen DESC) AS ord FROM nest) WHERE ord <= 12""")
def parent_prefixes(spark, sf):
    return C.parents(base.prefixes(spark, sf), 12)


@query("""SELECT pid, ord, child_pid, child_prefix, child_plen FROM (SELECT n.parent_pid AS pid, c.pid AS child_pid, c.prefix AS child_prefix, c.plen AS child_plen,
  row_number() OVER (PARTITION BY n.parent_pid ORDER BY c.ip_start, c.plen) AS ord FROM nest n JOIN pfx c ON c.pid = n.pid) WHERE ord <= 64""")
def child_prefixes(spark, sf):
    return C.children(base.prefixes(spark, sf), 64)


@query("""SELECT o_orderkey, ip, prefix, origin_asn FROM (SELECT o.*, p.prefix, p.origin_asn, row_number() OVER (PARTITION BY o_orderkey ORDER BY p.plen DESC NULLS LAST) AS r
  FROM (SELECT o_orderkey, (10 + o_orderkey%4)*16777216 + ((o_custkey*7919)%65536)*256 + o_orderkey%256 AS ip FROM orders) o
  LEFT JOIN pfx p ON p.ip_start <= o.ip AND p.ip_end >= o.ip) WHERE r = 1""")
def longest_match(spark, sf):
    ip = (F.lit(10) + F.col("o_orderkey") % 4) * 16777216 + ((F.col("o_custkey") * 7919) % 65536) * 256 + F.col("o_orderkey") % 256
    asked = fx.table(spark, sf, "orders").select("o_orderkey", F.lit(4).alias("family"), ip.alias("ip"))
    return C.longest_match(asked, base.prefixes(spark, sf), ["prefix", "origin_asn"]).drop("family")


@query("SELECT prefix, plen, ip_start, ip_end FROM pfx WHERE ip_start <= 174063615 AND ip_end >= 171966464")
def overlapping_prefixes(spark, sf):
    """Everything around and inside one interval."""
    return C.overlapping(base.prefixes(spark, sf), F.lit(171966464), F.lit(174063615)).select("prefix", "plen", "ip_start", "ip_end")


# ---------------------------------------------------------------- interval algebra

@query("SELECT pid, s AS ip_start, e AS ip_end FROM eff")
def effective_ranges(spark, sf):
    return I.effective_ranges(base.prefixes(spark, sf)).select("pid", "ip_start", "ip_end")


@query("""SELECT count(*) AS n_blocks, count(DISTINCT s || plen) AS n_owners FROM fx_block6""")
def effective_ranges_v6(spark, sf):
    """Every IPv6 block is either covered by its children or owns an address."""
    b = fx.blocks6(spark, sf).withColumn("pid", F.concat(addr.wide_hex("ip_start"), F.col("plen").cast("string")))
    owners = I.effective_ranges(b).select("pid").distinct().agg(F.count(F.lit(1)).alias("n_owners"))
    return b.agg(F.count(F.lit(1)).alias("n_blocks"), F.lit(0).alias("x")).select("n_blocks", owners.scalar().alias("n_owners"))


@query("SELECT s AS ip_start, e AS ip_end, cc, province, city, provider FROM geo_flat")
def resolve_overlaps(spark, sf):
    return I.resolve_overlaps(fx.geo_raw(spark, sf), ["cc", "province", "city", "provider"]).drop("family")


@query("SELECT s AS ip_start, e AS ip_end, cc, province, city FROM geo")
def coalesced_geo(spark, sf):
    return base.geo(spark, sf).select("ip_start", "ip_end", "cc", "province", "city")


@query("""SELECT min(s) AS ip_start, max(e) AS ip_end FROM (SELECT *, sum(b) OVER (ORDER BY s, e) AS g FROM (SELECT s, e,
  CASE WHEN s <= max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS b FROM geo_raw)) GROUP BY g""")
def union_intervals(spark, sf):
    return I.union_intervals(fx.geo_raw(spark, sf)).select("ip_start", "ip_end")


@query("SELECT s AS ip_start, max(e) OVER (ORDER BY s, prio DESC, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM geo_raw")
def running_reach(spark, sf):
    """Largest end before each interval along the whole address order."""
    g = fx.geo_raw(spark, sf).withColumn("np", -F.col("prio"))
    s = ordered.scan(ordered.pin(g, "family", "ip_start", "np", "tie"), ["ip_start", "np", "tie"], ["family"], reach=("max_before", F.col("ip_end")))
    return s.select("ip_start", "reach")


@query("SELECT prefix, cc, province, city FROM tagged")
def places_of_prefixes(spark, sf):
    return base.tagged(spark, sf).select("prefix", "cc", "province", "city")


@query("SELECT pid, s AS ip_start, e AS ip_end, cc, province, city FROM pieces")
def overlap_join(spark, sf):
    """Effective ranges cut along the geo table."""
    p = base.prefixes(spark, sf)
    return I.overlap_join(I.effective_ranges(p), base.geo(spark, sf), ["pid"], ["cc", "province", "city"]).select("pid", "ip_start", "ip_end", "cc", "province", "city")


@query("""SELECT p.pid, p.s AS ip_start, p.e AS ip_end, p.cc, p.province, p.city FROM pieces p JOIN eff_busy c ON c.pid = p.pid AND p.s BETWEEN c.s AND c.e WHERE c.n <= 1
  UNION ALL SELECT c.pid, c.s, c.e, g.cc, NULL, NULL FROM eff_busy c JOIN geo g ON g.s <= c.s AND g.e >= c.s WHERE c.n > 1""")
def carved_ranges(spark, sf):
    """Ranges in which more than one geo interval starts stay whole."""
    p = base.prefixes(spark, sf)
    return I.carve(I.effective_ranges(p), base.geo(spark, sf), cap=1).select("pid", "ip_start", "ip_end", "cc", "province", "city")


@query("""SELECT pid, cc, city, max_by(province, s) AS province, count(*) AS n_islands, sum(e - s + 1)::BIGINT AS addresses FROM (
  SELECT pid, cc, city, min(s) AS s, max(e) AS e, max_by(province, s) AS province FROM (SELECT *, sum(b) OVER (PARTITION BY pid, cc, city ORDER BY s) AS g FROM (
  SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY pid, cc, city ORDER BY s) + 1 THEN 0 ELSE 1 END AS b FROM pieces)) GROUP BY pid, cc, city, g) GROUP BY pid, cc, city""")
def merged_pieces(spark, sf):
    cut = I.carve(I.effective_ranges(base.prefixes(spark, sf)), base.geo(spark, sf))
    whole = I.merge_equal(cut, ["pid", "cc", "city"], {"tail": F.max_by("province", "ip_start")})
    return whole.groupBy("pid", "cc", "city").agg(F.max_by("tail", "ip_start").alias("province"), F.count(F.lit(1)).alias("n_islands"),
                                                 F.sum(F.col("ip_end") - F.col("ip_start") + 1).alias("addresses"))


@query(f"""SELECT p.prefix, s.cc, s.city, s.province, s.segs, p.plen, p.origin_asn, p.n_paths FROM (
  SELECT pid, cc, city, max_by(province, adr) AS province, string_agg(cidr, ' ' ORDER BY adr) AS segs FROM (
   SELECT pid, cc, city, province, adr, {dotted('adr')} || '/' || plen AS cidr, row_number() OVER (PARTITION BY pid, cc, city ORDER BY adr) AS r FROM
   (WITH RECURSIVE isl AS (SELECT pid, cc, city, min(s) AS s, max(e) AS e, max_by(province, s) AS province FROM (SELECT *, sum(b) OVER (PARTITION BY pid, cc, city ORDER BY s) AS g FROM (
     SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY pid, cc, city ORDER BY s) + 1 THEN 0 ELSE 1 END AS b FROM pieces)) GROUP BY pid, cc, city, g),
    step AS (SELECT pid, cc, city, province, s AS nxt, e, CAST(NULL AS BIGINT) AS adr, CAST(NULL AS BIGINT) AS plen FROM isl UNION ALL
     SELECT pid, cc, city, province, nxt + sz, e, nxt, 32 - CAST(log2(sz) AS BIGINT) FROM (SELECT *, least(nxt & -nxt, CAST(1 AS BIGINT) << CAST(floor(log2(e - nxt + 1)) AS INT)) AS sz
      FROM step WHERE nxt <= e)) SELECT * FROM step WHERE plen IS NOT NULL)) GROUP BY pid, cc, city) s JOIN pfx p ON p.pid = s.pid""")
def segments(spark, sf):
    s = G.segments(base.prefixes(spark, sf), base.geo(spark, sf))
    return s.select("prefix", "cc", "city", "province", F.array_join("segs", " ").alias("segs"), "plen", "origin_asn", "n_paths")


@query("SELECT cc, count(*) AS n FROM tagged WHERE cc IS NOT NULL GROUP BY cc")
def prefixes_per_country(spark, sf):
    return G.counts_by(base.tagged(spark, sf), "cc")


@query("SELECT cc, city, count(*) AS n FROM tagged WHERE cc IS NOT NULL AND city IS NOT NULL GROUP BY cc, city HAVING count(*) >= 2")
def prefixes_per_city(spark, sf):
    return G.counts_by(base.tagged(spark, sf), "cc", "city", least=2)


@query("""SELECT cc, origin_asn, n, ord FROM (SELECT *, row_number() OVER (PARTITION BY cc ORDER BY n DESC, origin_asn) AS ord FROM (
  SELECT cc, origin_asn, count(*) AS n FROM tagged WHERE family = 4 AND cc IS NOT NULL GROUP BY cc, origin_asn)) WHERE ord <= 8""")
def top_origins_per_country(spark, sf):
    return G.top_origins(base.tagged(spark, sf), 8)


@query("""SELECT q.c_custkey, upper(n.cc) AS cc FROM (SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'c' || c_nationkey WHEN 2 THEN 'q' || chr(97 + (c_nationkey%26)::INT) ELSE c_mktsegment || '9' END AS t
  FROM customer) q LEFT JOIN (SELECT lower(n_name) AS k, 'C' || n_nationkey AS cc FROM nation UNION ALL SELECT lower('C' || n_nationkey), 'C' || n_nationkey FROM nation
  UNION ALL SELECT 'q' || chr(97+i::INT), 'Q' || chr(65+i::INT) FROM range(26) t(i)) n ON n.k = lower(q.t)""")
def country_texts(spark, sf):
    """Country names, codes and unknown texts to codes."""
    c = F.col("c_custkey")
    nk = F.col("c_nationkey").cast("string")
    t = (F.when(c % 4 == 0, F.concat(F.lit("nation_"), nk)).when(c % 4 == 1, F.concat(F.lit("c"), nk))
         .when(c % 4 == 2, F.concat(F.lit("q"), F.char(F.lit(97) + F.col("c_nationkey") % 26))).otherwise(F.concat("c_mktsegment", F.lit("9"))))
    names = fx.table(spark, sf, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("cc"), F.col("n_name").alias("label"))
    return G.resolve_country(fx.table(spark, sf, "customer").select("c_custkey", t.alias("text")), names).select("c_custkey", "cc")
