"""Queries: validation, adjacency, search."""

from pyspark.sql import functions as F

from routeloom.functions import paths as P, text as X
from routeloom.operators import adjacency as A, geo as G, owners as OW, rib, search as S, validation as V
from routeloom.session import durable
from routeloom.sinks import publish as K

from . import base, fixtures as fx
from .oracle_base import T1_LIST, T1_SET
from .registry import query


# ---------------------------------------------------------------- validation

@query("SELECT pid, ip_start, ip_end, plen, origin FROM route_origin")
def route_origins(spark, sf):
    return V.route_origins(base.with_ids(spark, sf)[1]).drop("family")


@query("SELECT pid, origin, rpki FROM rpki_status")
def rpki_status(spark, sf):
    return V.rpki_status(V.route_origins(base.with_ids(spark, sf)[1]), fx.vrps(spark, sf))


@query("SELECT pid, origin, irr FROM irr_status")
def irr_status(spark, sf):
    return V.irr_status(V.route_origins(base.with_ids(spark, sf)[1]), fx.irr_routes(spark, sf))


@query("""SELECT p.pid, p.prefix, i.origin, string_agg(DISTINCT i.source, ',' ORDER BY i.source) AS sources, bool_or(i.source IN ('RIPE','APNIC','ARIN','AFRINIC','LACNIC','DN42')) AS trusted
  FROM pfx p JOIN irr_route i ON i.ip_start = p.ip_start AND i.ip_end = p.ip_end GROUP BY p.pid, p.prefix, i.origin""")
def irr_details(spark, sf):
    d = V.irr_details(base.prefixes(spark, sf), fx.irr_routes(spark, sf))
    return d.select("pid", "prefix", "origin", F.array_join("sources", ",").alias("sources"), X.any_authoritative("sources").alias("trusted"))


@query("""SELECT CASE rpki WHEN 0 THEN 'NotFound' WHEN 1 THEN 'Valid' WHEN 2 THEN 'Invalid-ASN' ELSE 'Invalid-length' END AS rpki,
  CASE irr WHEN 0 THEN 'none' WHEN 1 THEN 'present' ELSE 'mismatch' END AS irr, count(*) AS n FROM codes GROUP BY ALL""")
def status_labels(spark, sf):
    c = base.codes(spark, sf, base.with_ids(spark, sf)[1])
    return c.groupBy(X.rpki_label("rpki").alias("rpki"), X.irr_label("irr").alias("irr")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT ip_start, ip_end, plen, origin, source FROM irr_route")
def irr_union(spark, sf):
    """Two registries, one of them delivered twice."""
    r = fx.irr_routes(spark, sf)
    ripe, radb = r.where(F.col("source") == "RIPE"), r.where(F.col("source") == "RADB")
    return V.union_objects(ripe, radb, ripe).drop("family")


# ---------------------------------------------------------------- adjacency

@query("SELECT a.asn, a.neighbor, a.d, a.u, a.w, a.wd, a.ev_pid, p.prefix AS ev_prefix FROM adj a LEFT JOIN pfx p ON p.pid = a.ev_pid")
def as_adjacency(spark, sf):
    p, po = base.with_ids(spark, sf)
    adj = A.adjacency(rib.exported_paths(rib.ranked_paths(po)))
    return A.with_evidence_prefix(adj, p)


@query("SELECT asn, neighbor, on_left, weak, count(*) AS n FROM beside GROUP BY ALL")
def neighbour_pairs(spark, sf):
    return A.neighbour_pairs(base.paths(spark, sf)).groupBy("asn", "neighbor", "on_left", "weak").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT asn, neighbor, rel, n, ord FROM (SELECT *, row_number() OVER (PARTITION BY asn, rel ORDER BY n DESC, neighbor) AS ord FROM rel) WHERE ord <= 40")
def as_relations(spark, sf):
    return A.top_relations(base.adj(spark, sf), 40).select("asn", "neighbor", "rel", "n", "ord")


@query("""SELECT asn, neighbor, pid, path_str, CASE WHEN a[k+1] = neighbor THEN 'd' ELSE 'u' END AS side FROM (
  SELECT *, row_number() OVER (PARTITION BY asn, neighbor ORDER BY path_len, path_str, k) AS r FROM (
  SELECT j.asn, j.neighbor, p.pid, p.path_str, p.a, p.path_len, unnest(range(1, len(p.a)+1)) AS k FROM adj j JOIN arr_paths p ON p.pid = j.ev_pid)
  WHERE a[k] = asn AND (a[k+1] = neighbor OR (k > 1 AND a[k-1] = neighbor))) WHERE r = 1""")
def adjacency_evidence(spark, sf):
    p = durable(base.paths(spark, sf).select("pid", "path_str", "path_arr", "path_len"))  # read for the pairs and for their evidence
    return A.evidence(A.adjacency(p), p)


@query("""SELECT pid, origin, peers, paths, row_number() OVER (PARTITION BY pid ORDER BY peers DESC, paths DESC, origin) AS ord FROM (
  SELECT pid, a[-1] AS origin, sum(n_peers)::BIGINT AS peers, count(*) AS paths FROM arr_paths GROUP BY ALL)""")
def origins_from_paths(spark, sf):
    return A.origins_from_paths(base.paths(spark, sf))


@query("""SELECT pid, upstream, n, ord FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n DESC, upstream) AS ord FROM (
  SELECT pid, list_filter(a, lambda x: x <> a[-1])[-1] AS upstream, count(*) AS n FROM arr_paths GROUP BY ALL) WHERE upstream IS NOT NULL) WHERE ord <= 6""")
def upstreams(spark, sf):
    return A.upstreams(base.paths(spark, sf), 6)


@query(f"""SELECT DISTINCT pid, kind, a, b FROM (SELECT pid, 'seen' AS kind, unnest(t) AS a, NULL AS b FROM t1p UNION ALL SELECT pid, 'entry', t[1], NULL FROM t1p UNION ALL
  SELECT pid, 'pair', t[i], t[i+1] FROM (SELECT pid, t, unnest(range(1, len(t))) AS i FROM t1p) WHERE t[i] <> t[i+1])""".replace(
    "FROM t1p", f"FROM (SELECT pid, list_filter(a, lambda x: list_contains({T1_LIST}, x)) AS t FROM arr_paths WHERE list_has_any(a, {T1_LIST}))"))
def tier1_routes(spark, sf):
    return A.tier1_routes(base.paths(spark, sf))


_TRUNC = f"(SELECT pid, n_peers, a[list_min(list_transform({T1_LIST}, lambda t: list_position(a, t))):] AS p FROM arr_paths WHERE list_has_any(a, {T1_LIST}))"


@query(f"SELECT pid, p[i] AS a, p[i+1] AS b, sum(n_peers)::BIGINT AS weight FROM (SELECT pid, n_peers, p, unnest(range(1, len(p))) AS i FROM {_TRUNC}) GROUP BY pid, p[i], p[i+1]")
def route_graph_edges(spark, sf):
    return A.graph_edges(base.paths(spark, sf))


@query(f"SELECT pid, p[i] AS asn, min(len(p) - i) AS depth FROM (SELECT pid, p, unnest(range(1, len(p)+1)) AS i FROM {_TRUNC}) GROUP BY pid, p[i]")
def route_graph_nodes(spark, sf):
    return A.graph_nodes(base.paths(spark, sf))


# ---------------------------------------------------------------- search

_ROW = "SELECT pid, prefix, cc, origin_asn, rpki, irr, n_origins, n_paths, is_primary, paths_blob, best_path FROM search_table"
_COLS = ["pid", "prefix", "cc", "origin_asn", "rpki", "irr", "n_origins", "n_paths"]


@query(_ROW)
def search_table(spark, sf):
    return base.table(spark, sf).select(*_COLS, "is_primary", "paths_blob", "best_path")


@query(r"""SELECT pid, prefix, n_paths, regexp_matches(best_path, ' 1299 (?:[0-9]+ )*30004 ') AS best_hit FROM search_table
  WHERE is_primary AND regexp_matches(paths_blob, ' 1299 (?:[0-9]+ )*30004 ')""")
def path_search(spark, sf):
    p, po = base.with_ids(spark, sf)
    t = S.search_table(p, po, rib.paths_per_prefix(rib.ranked_paths(po)))
    return S.best_first(S.search(t, path="1299 * 30004", include_low=True)).select("pid", "prefix", "n_paths", "best_hit")


def _search(spark, sf, **kw):
    p, po = base.with_ids(spark, sf)
    return S.search(S.search_table(p, po, rib.paths_per_prefix(rib.ranked_paths(po))), **kw)


@query("SELECT pid, prefix, n_paths, contains(best_path, ' 174 30004 ') AS best_hit FROM search_table WHERE is_primary AND contains(paths_blob, ' 174 30004 ')")
def path_search_adjacent(spark, sf):
    return _search(spark, sf, path="174->30004", include_low=True).select("pid", "prefix", "n_paths", "best_hit")


@query(r"""SELECT pid, prefix, regexp_matches(best_path, ' 64502 (?:[0-9]+ ){2}30003 ') AS best_hit FROM search_table WHERE is_primary
  AND regexp_matches(paths_blob, ' 64502 (?:[0-9]+ ){2}30003 ')""")
def path_search_exact_gap(spark, sf):
    return _search(spark, sf, path="* 64502 ?? 30003 ?", include_low=True).select("pid", "prefix", "best_hit")


@query("SELECT pid, prefix, contains(best_path, ' 6939 ') AS best_hit FROM search_table WHERE is_primary AND contains(paths_blob, ' 6939 ') AND NOT contains(paths_blob, ' 174 ') AND NOT contains(paths_blob, ' 701 ')")
def path_search_excluding(spark, sf):
    return _search(spark, sf, path="6939 !174 -701", include_low=True).select("pid", "prefix", "best_hit")


@query("SELECT pid, prefix, origin_asn, is_primary FROM search_table WHERE origin_asn IN (65003, 65004)")
def origin_search(spark, sf):
    return _search(spark, sf, origins=[65003, 65004], include_low=True).select("pid", "prefix", "origin_asn", "is_primary")


@query("""SELECT pid, prefix, n_paths FROM search_table s JOIN dfz d ON d.family = CASE WHEN s.prefix LIKE '%:%' THEN 6 ELSE 4 END
  WHERE is_primary AND n_paths >= ceil(greatest(3, 0.2 * d.dfz_ref))""")
def visible_prefixes(spark, sf):
    p, po = base.with_ids(spark, sf)
    t = S.search_table(p, po, rib.paths_per_prefix(rib.ranked_paths(po)))
    return S.search(t, reference=rib.visibility_reference(p)).select("pid", "prefix", "n_paths")


@query("SELECT pid, prefix, cc, city FROM search_table WHERE cc = 'C7' AND city = 'BUILDING' AND is_primary AND family = 4")
def place_search(spark, sf):
    return S.search(base.table(spark, sf), cc="C7", city="BUILDING", family=4).select("pid", "prefix", "cc", "city")


@query("SELECT path, pid, regexp_matches(' ' || path || ' ', ' 3356 (?:[0-9]+ )*30001 ') AS hit FROM ranked")
def path_highlight(spark, sf):
    return base.ranked(spark, sf).select("pid", "path", P.compile_pattern("3356 * 30001").matches(P.padded("path")).alias("hit"))


@query("""SELECT pid, prefix, n_paths, row_no, more FROM (SELECT pid, prefix, n_paths, row_number() OVER (ORDER BY n_paths DESC, pid) - 80 AS row_no, count(*) OVER () > 120 AS more FROM pfx)
  WHERE row_no BETWEEN 1 AND 40""")
def result_page(spark, sf):
    """Third page of forty."""
    return S.page(base.prefixes(spark, sf), [F.desc("n_paths"), F.asc("pid")], 40, 2).select("pid", "prefix", "n_paths", "row_no", "more")


@query("SELECT prefix, cc FROM tagged")
def sort_by_country(spark, sf):
    return S.sort_by(base.tagged(spark, sf), "cc", descending=False).select("prefix", "cc")


@query("SELECT pid, prefix, plen, cc FROM tagged WHERE ip_start <= 167837695 AND ip_end >= 167772160")
def subnet_search(spark, sf):
    return S.subnet(base.tagged(spark, sf), F.lit(167772160), F.lit(167837695)).select("pid", "prefix", "plen", "cc")


_NAMES = "(SELECT 65000 + s_suppkey AS asn, s_name AS name FROM supplier UNION ALL SELECT 64500 + n_nationkey, n_name FROM nation UNION ALL SELECT 65000 + s_suppkey, 'N' || s_nationkey FROM supplier)"


def _names(spark, sf):
    s = fx.table(spark, sf, "supplier")
    n = fx.table(spark, sf, "nation")
    return (s.select((F.col("s_suppkey") + 65000).alias("asn"), F.col("s_name").alias("name"))
            .unionByName(n.select((F.col("n_nationkey") + 64500).cast("bigint").alias("asn"), F.col("n_name").alias("name")))
            .unionByName(s.select((F.col("s_suppkey") + 65000).alias("asn"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("name"))))


@query(f"""SELECT asn, rank FROM (SELECT *, row_number() OVER (ORDER BY rank, asn) AS r FROM (SELECT asn, min(CASE WHEN lower(name) = 'n1' THEN 0 WHEN starts_with(lower(name), 'n1')
  OR regexp_matches(lower(name), '[^a-zA-Z0-9_]n1') THEN 1 ELSE 2 END) AS rank FROM {_NAMES} WHERE contains(lower(name), 'n1') GROUP BY asn)) WHERE r <= 200""")
def name_search(spark, sf):
    return S.names_matching(_names(spark, sf), " N1 ", 200).select("asn", "rank")


@query("SELECT origin_asn, count(*) AS count4, 0 AS count6 FROM search_table GROUP BY origin_asn")
def origin_counts(spark, sf):
    p, po = base.with_ids(spark, sf)
    return S.asn_counts(S.search_table(p, po, rib.paths_per_prefix(rib.ranked_paths(po))))


@query("SELECT origin_asn, pid, n_paths, ord FROM (SELECT *, row_number() OVER (PARTITION BY origin_asn ORDER BY n_paths DESC, pid) AS ord FROM search_table) WHERE ord <= 400")
def origin_prefixes(spark, sf):
    p, po = base.with_ids(spark, sf)
    t = S.search_table(p, po, rib.paths_per_prefix(rib.ranked_paths(po)))
    return S.asn_prefixes(t, 400).select("origin_asn", "pid", "n_paths", "ord")


@query("SELECT DISTINCT asn FROM (SELECT unnest(a) AS asn FROM arr_paths UNION ALL SELECT origin_asn FROM pfx)")
def seen_networks(spark, sf):
    p, po = base.with_ids(spark, sf)
    return OW.seen_networks(rib.exported_paths(rib.ranked_paths(po)), p)


@query(f"SELECT DISTINCT asn, name FROM {_NAMES} WHERE asn IN (SELECT unnest(a) FROM arr_paths UNION ALL SELECT origin_asn FROM pfx)")
def names_of_seen(spark, sf):
    p, po = base.with_ids(spark, sf)
    return OW.restrict_to_seen(_names(spark, sf), OW.seen_networks(rib.exported_paths(rib.ranked_paths(po)), p)).distinct()


@query("""SELECT prefix || ',' || coalesce(cc, '') || ',"' || replace(trim(best_path), ' ', ',') || '"' AS line FROM search_table WHERE is_primary""")
def csv_export(spark, sf):
    t = base.table(spark, sf).where("is_primary").withColumn("best", F.replace(F.trim("best_path"), F.lit(" "), F.lit(",")))
    return K.csv_lines(S.export_rows(t, ["prefix", "cc", "best"], [F.desc("n_paths"), F.asc("pid")]).drop("capped"))


# ---------------------------------------------------------------- owners

def _objects(spark, sf):
    """Registry objects: fifty networks, contacts and maintainers."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    k = F.col("s_suppkey")
    s = fx.table(spark, sf, "supplier")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    nets = s.select(F.lit("aut-num").alias("type"), text("AS", k + 65000).alias("name"), F.array_compact(F.array(
        pair("aut-num", text("AS", k + 65000)), pair("as-name", F.col("s_name")),
        F.when(k % 5 != 0, pair("admin-c", text("P", k % 7))), F.when(k % 4 == 0, pair("tech-c", text("P", (k + 1) % 7))),
        pair("mnt-by", text("M", k % 3)), pair("auth", F.lit("secret")))).alias("attrs"))
    n = F.col("n_nationkey")
    nation = fx.table(spark, sf, "nation")
    people = nation.select(F.lit("person").alias("type"), text("P", n).alias("name"),
                           F.array(pair("person", F.col("n_name")), pair("auth", F.lit("x")), pair("nic-hdl", text("P", n))).alias("attrs"))
    mnts = nation.select(F.lit("mntner").alias("type"), text("M", n).alias("name"),
                         F.array(pair("mntner", text("M", n)), pair("admin-c", text("P", n))).alias("attrs"))
    return nets.unionByName(people).unionByName(mnts)


_OWN = """(SELECT 65000 + s_suppkey AS asn, s_name AS as_name, CASE WHEN s_suppkey%5 <> 0 THEN 'P' || s_suppkey%7 WHEN s_suppkey%4 = 0 THEN 'P' || (s_suppkey+1)%7
  ELSE 'P' || s_suppkey%3 END AS person FROM supplier)"""


@query(f"SELECT * FROM {_OWN}")
def network_owners(spark, sf):
    return OW.asn_owners(_objects(spark, sf))


@query(f"""SELECT person, n.n_name AS name, string_agg(DISTINCT o.asn, ',' ORDER BY o.asn) AS asns, sum(c)::BIGINT AS n_prefix FROM {_OWN} o
  JOIN (SELECT origin_asn AS asn, count(*) AS c FROM pfx GROUP BY origin_asn) p ON p.asn = o.asn JOIN nation n ON 'P' || n.n_nationkey = person GROUP BY person, n.n_name""")
def person_summary(spark, sf):
    o = _objects(spark, sf)
    counts = base.prefixes(spark, sf).groupBy(F.col("origin_asn").alias("asn")).agg(F.count(F.lit(1)).alias("n_prefix"))
    s = OW.in_summary_order(OW.person_summary(OW.asn_owners(o), OW.persons(o), counts))
    return s.withColumn("asns", base.joined("asns"))


@query(f"SELECT pid, prefix, origin_asn FROM search_table WHERE origin_asn IN (SELECT asn FROM {_OWN} WHERE person = 'P3')")
def person_search(spark, sf):
    p, po = base.with_ids(spark, sf)
    t = S.search_table(p, po, rib.paths_per_prefix(rib.ranked_paths(po)))
    return S.by_person(t, OW.asn_owners(_objects(spark, sf)), "P3").select("pid", "prefix", "origin_asn")


@query("""SELECT 'AS' || (65000+s_suppkey) AS name, key, value FROM (SELECT s_suppkey, unnest(['aut-num','as-name','admin-c','tech-c','mnt-by']) AS key,
  unnest(['AS' || (65000+s_suppkey), s_name, CASE WHEN s_suppkey%5<>0 THEN 'P' || s_suppkey%7 END, CASE WHEN s_suppkey%4=0 THEN 'P' || (s_suppkey+1)%7 END, 'M' || s_suppkey%3]) AS value FROM supplier)
  WHERE value IS NOT NULL""")
def whois_head_rows(spark, sf):
    h = OW.whois_head(_objects(spark, sf))
    return h.where(F.col("type") == "aut-num").select("name", "key", "value")


@query("""SELECT 'AS' || (65000+s_suppkey) AS name, role, handle, CASE WHEN role = 'mnt-by' THEN handle ELSE 'NATION_' || substr(handle, 2) END AS label,
  CASE WHEN role = 'mnt-by' THEN 2 ELSE 2 END AS n_rows FROM (SELECT s_suppkey, unnest(['admin-c','tech-c','mnt-by']) AS role,
  unnest([CASE WHEN s_suppkey%5<>0 THEN 'P' || s_suppkey%7 END, CASE WHEN s_suppkey%4=0 THEN 'P' || (s_suppkey+1)%7 END, 'M' || s_suppkey%3]) AS handle FROM supplier) WHERE handle IS NOT NULL""")
def whois_entities(spark, sf):
    return OW.whois_entities(_objects(spark, sf)).select("name", "role", "handle", "label", F.size("rows").alias("n_rows"))
