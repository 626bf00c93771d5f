"""Queries: entries, paths, prefixes."""

from pyspark.sql import functions as F

from routeloom.functions import addr, paths as P
from routeloom.functions.fixed import TIER1
from routeloom.operators import rib

from . import base, fixtures as fx
from .base import joined
from .oracle_base import T1_LIST, T1_SET
from .registry import query


@query("SELECT collector, array_to_string(arr, ' ') AS path, len(arr) AS path_len, arr[-1] AS origin_asn, count(*) AS n FROM cleaned GROUP BY ALL")
def clean_paths(spark, sf):
    return rib.cleaned(fx.entries(spark, sf)).groupBy("collector", "path", "path_len", "origin_asn").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT path, ' ' || path || ' ' AS path_str, len(arr) AS hops, list_sum(arr)::BIGINT AS total, len(list_filter(arr, lambda x: x IS NULL)) AS bad
  FROM (SELECT path, list_transform(string_split(path || ' x' || path_len, ' '), lambda x: TRY_CAST(x AS BIGINT)) AS arr FROM merged)""")
def path_arrays(spark, sf):
    m = base.merged(spark, sf)
    arr = P.path_array(F.concat(F.col("path"), F.lit(" x"), F.col("path_len").cast("string")))
    return m.withColumn("arr", arr).select(
        "path", P.padded("path").alias("path_str"), F.size("arr").alias("hops"),
        F.aggregate(F.filter("arr", lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.size(F.filter("arr", lambda x: x.isNull())).alias("bad"))


@query("SELECT collector, prefix, path, path_len, origin_asn, n_peers FROM obs")
def observations(spark, sf):
    return rib.observations(fx.entries(spark, sf)).select("collector", "prefix", "path", "path_len", "origin_asn", "n_peers")


@query("SELECT prefix, path, path_len, origin_asn, plen, ip_start, ip_end, n_peers FROM merged")
def merged_paths(spark, sf):
    return rib.merge_collectors(rib.observations(fx.entries(spark, sf))).select(
        "prefix", "path", "path_len", "origin_asn", "plen", "ip_start", "ip_end", "n_peers")


@query("SELECT collector, count(*) AS n_entries, count(DISTINCT prefix) AS n_prefixes FROM fx_entry GROUP BY collector")
def collector_union(spark, sf):
    e = fx.entries(spark, sf)
    parts = {c: e.where(F.col("collector") == c).drop("collector") for c in ("rrc01", "rrc06")}
    return rib.union_collectors(parts).groupBy("collector").agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("prefix").alias("n_prefixes"))


@query("SELECT prefix, family, plen, ip_start, ip_end, origin_asn, n_origins, n_paths, n_distinct_paths FROM pfx")
def prefix_dimension(spark, sf):
    return rib.prefix_dimension(base.merged(spark, sf)).select(
        "prefix", "family", "plen", "ip_start", "ip_end", "origin_asn", "n_origins", "n_paths", "n_distinct_paths")


@query("SELECT pid, prefix FROM pfx")
def prefix_ids(spark, sf):
    return base.prefixes(spark, sf).select("pid", "prefix")


@query("""SELECT row_number() OVER (ORDER BY s, family, plen) AS pid, s AS start_hex, e AS end_hex, plen, family FROM
  (SELECT DISTINCT 4 AS family, plen, lpad(lower(printf('%x', ip_start)), 32, '0') AS s, lpad(lower(printf('%x', ip_end)), 32, '0') AS e FROM fx_block
   UNION ALL SELECT family, plen, s, e FROM fx_block6)""")
def prefix_ids_both_families(spark, sf):
    """Ids over one numeric order of both families."""
    from routeloom.operators import ordered
    four = fx.blocks(spark, sf).select("family", "plen", addr.wide_from_v4("ip_start").alias("ip_start"), addr.wide_from_v4("ip_end").alias("ip_end")).distinct()
    both = four.unionByName(fx.blocks6(spark, sf).select("family", "plen", "ip_start", "ip_end"))
    return ordered.number_rows(both, ["ip_start", "family", "plen"]).select(
        "pid", addr.wide_hex("ip_start").alias("start_hex"), addr.wide_hex("ip_end").alias("end_hex"), "plen", "family")


@query("SELECT pid, path, origin_asn, n_peers FROM pathobs")
def paths_with_ids(spark, sf):
    return base.with_ids(spark, sf)[1].select("pid", "path", "origin_asn", "n_peers")


@query("SELECT pid, path, path_len, n_peers, rn AS rank, rn = 1 AS is_best FROM ranked")
def ranked_paths(spark, sf):
    return base.ranked(spark, sf).select("pid", "path", "path_len", "n_peers", "rank", "is_best")


@query("SELECT pid, path_str, array_to_string(a, ',') AS path_arr, path_len, n_peers, rn = 1 AS is_best FROM arr_paths")
def exported_paths(spark, sf):
    return base.paths(spark, sf).withColumn("path_arr", joined("path_arr"))


@query("SELECT * FROM per_prefix")
def path_blobs(spark, sf):
    return rib.paths_per_prefix(base.ranked(spark, sf)).drop("paths")


@query("""SELECT w.prefix, string_agg(w.origin_asn, ',' ORDER BY ns DESC, w.origin_asn) AS origin_asns, string_agg(ns, ',' ORDER BY ns DESC, w.origin_asn) AS origin_npaths,
  string_agg(c.rpki, ',' ORDER BY ns DESC, w.origin_asn) AS origin_rpki, string_agg(c.irr, ',' ORDER BY ns DESC, w.origin_asn) AS origin_irr
  FROM weights w JOIN pfx p ON p.prefix = w.prefix AND p.n_origins > 1 JOIN codes c ON c.pid = p.pid AND c.origin_asn = w.origin_asn GROUP BY w.prefix""")
def multi_origin(spark, sf):
    p, po = base.with_ids(spark, sf)
    w = po.groupBy("pid", "origin_asn").agg(F.sum("n_peers").alias("ns"))
    m = rib.multi_origin(w, base.codes(spark, sf, po), key="pid")
    return m.join(p.select("pid", "prefix"), "pid").select("prefix", *[joined(c).alias(c) for c in m.columns if c != "pid"])


@query("SELECT family, q, dfz_ref FROM dfz")
def visibility_reference(spark, sf):
    return rib.visibility_reference(base.prefixes(spark, sf))


@query("SELECT 'prefixes' AS what, family, count(*) AS n FROM pfx GROUP BY family UNION ALL SELECT 'paths', family, count(*) FROM pathobs GROUP BY family")
def snapshot_totals(spark, sf):
    return rib.snapshot_totals(*base.with_ids(spark, sf))


@query("""SELECT family, plen, count(*) AS n FROM (SELECT DISTINCT 4 AS family, prefix, plen FROM fx_block UNION ALL SELECT family, s, plen FROM fx_block6)
  WHERE family = 6 GROUP BY family, plen""")
def keep_family_six(spark, sf):
    both = fx.blocks(spark, sf).select("family", "prefix", "plen").distinct().unionByName(fx.blocks6(spark, sf).select("family", "prefix", "plen"))
    return rib.keep_family(both, 6).groupBy("family", "plen").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT DISTINCT path, CASE WHEN t IS NULL THEN (CASE WHEN len(a) > 1 THEN array_to_string(a[2:], ' ') ELSE path END) ELSE array_to_string(a[t:], ' ') END AS from_tier1,
  t AS first_tier1 FROM (SELECT path, a, list_min(list_transform({T1_LIST}, lambda x: list_position(a, x))) AS t
  FROM (SELECT path, list_transform(string_split(path, ' '), lambda x: CAST(x AS BIGINT)) AS a FROM merged))""")
def from_first_tier1(spark, sf):
    m = base.merged(spark, sf).select("path", P.path_array("path").alias("a")).distinct()
    return m.select("path", P.path_key(P.from_first_tier1("a")).alias("from_tier1"), P.first_tier1("a").alias("first_tier1"))


@query(f"""SELECT prefix, path, contains(' ' || path || ' ', ' 1299 ') AS one,
  contains(' ' || path || ' ', ' ' || origin_asn || ' ') AS has_origin, contains(' ' || path || ' ', ' 174 30000 ') AS pair FROM merged""")
def contiguous_sequences(spark, sf):
    m = base.merged(spark, sf).withColumn("a", P.path_array("path"))
    return m.select("prefix", "path", P.contains_sequence("a", [1299]).alias("one"), F.array_contains("a", F.col("origin_asn")).alias("has_origin"),
                    P.contains_sequence("a", [174, 30000]).alias("pair"))


@query("""SELECT path, string_agg(CASE WHEN nm IS NULL THEN hop ELSE hop || '(' || nm || ')' END, ' ' ORDER BY i) AS shown FROM (
  SELECT DISTINCT path, hop, i, s.s_name AS nm FROM (SELECT path, unnest(string_split(path, ' ')) AS hop, generate_subscripts(string_split(path, ' '), 1) AS i FROM
  (SELECT DISTINCT path FROM merged)) LEFT JOIN supplier s ON 65000 + s.s_suppkey = CAST(hop AS BIGINT)) GROUP BY path""")
def readable_paths(spark, sf):
    names = fx.table(spark, sf, "supplier").select((F.col("s_suppkey") + 65000).alias("asn"), F.col("s_name").alias("name"))
    hops = base.merged(spark, sf).select("path").distinct().select("path", F.posexplode(P.path_array("path")).alias("i", "asn"))
    shown = hops.join(names, "asn", "left").select("path", "i", P.named_asn("asn", "name").alias("t"))
    # A path's own hops: the group is one path.
    return shown.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), " ").alias("shown"))


@query(f"SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey IN {T1_SET} THEN TRUE ELSE FALSE END AS tier1 FROM lineitem")
def tier1_flag(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_suppkey", P.is_tier1("l_suppkey").alias("tier1")).distinct()
