"""Queries: binary dumps, streams, incremental state, the whole snapshot."""

import bz2
import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from routeloom.functions import addr
from routeloom.functions.fixed import TIER1
from routeloom.operators import rib
from routeloom.plans import snapshot
from routeloom.session import durable, spread
from routeloom.sources import rib_dump, rpsl, tables
from routeloom.streaming import delta as D, measurements as SM, refresh

from . import base, fixtures as fx
from .oracle_base import cte
from .q_records import scratch
from .q_text import _route_texts, set_texts
from .registry import query


def _hex(n, digits):
    return F.lpad(F.hex(n), digits, "0")


def _record(sub, body):
    return F.concat(F.lit("00000000000D"), F.lit(sub), _hex((F.length(body) / 2).cast("bigint"), 8), body)


def _rib_body(net, plen, peer, asns):
    """Hex of one RIB record's body: a prefix with one entry."""
    path = F.concat(F.lit("02"), _hex(F.size(asns), 2), F.array_join(F.transform(asns, lambda a: F.lpad(F.hex(a), 8, "0")), ""))
    attr = F.concat(F.lit("4001010050" + "02"), _hex(F.length(path) / 2, 4), path)
    used = F.substring(net, F.lit(1), (F.ceil(plen / 8) * 2).cast("int"))
    return F.concat(F.lit("00000000"), _hex(plen, 2), used, F.lit("0001"), _hex(peer, 4), F.lit("00000000"), _hex(F.length(attr) / 2, 4), attr)


PEERS = "00000000" + "0000" + "0007" + "".join(f"02{0:08x}{0xC0000200 + i:08x}{64500 + i:08x}" for i in range(1, 8))


def dump_records(spark, sf):
    """(collector, l_orderkey, record): hex of one record per line item."""
    li = spread(fx.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    e = li.join(fx.blocks(spark, sf), F.col("l_partkey") == F.col("k"))
    sk, ln = F.col("l_suppkey"), F.col("l_linenumber").cast("bigint")
    tier = F.array(*[F.lit(x).cast("bigint") for x in TIER1])
    o = F.col("origin0") + F.when(F.col("l_quantity") > 45, 1).otherwise(0)
    asns = F.array_compact(F.array(F.lit(64500) + ln, F.when(sk % 7 != 0, F.get(tier, (sk % 24).cast("int"))),
                                   F.when(sk % 3 == 0, F.get(tier, ((sk * 5) % 24).cast("int"))), F.lit(30000) + sk % 20, o, o))
    e = e.withColumn("asns", asns)
    body = _rib_body(_hex(F.col("ip_start"), 8), F.col("plen"), ln - 1, F.col("asns"))
    return e.select(F.when(ln % 2 == 1, "rrc01").otherwise("rrc06").alias("collector"), "l_orderkey", _record("0002", body).alias("record"))


def dump_files(spark, sf):
    """A small dump per order: a peer table of seven peers, then one record per line item."""
    # One order's items: a handful of records per file.
    per = dump_records(spark, sf).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("record")), "").alias("records"))
    return per.select(F.concat(F.lit("dump/"), F.col("l_orderkey").cast("string")).alias("path"),
                      F.unhex(F.concat(_record("0001", F.lit(PEERS)), F.col("records"))).alias("content"))


def _write_dumps(folder):
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                packed = bz2.compress(r["content"]) if r["collector"] == "rrc06" else gzip.compress(r["content"])
                ending = "bz2" if r["collector"] == "rrc06" else "gz"
                for collector, held in ((r["collector"], packed), ("cut", packed[:len(packed) // 2])):
                    if collector == "cut" and r["collector"] != "rrc01":
                        continue
                    system, path = rib_dump.file_system(f"{folder}/{collector}/{r['name']}.{ending}")
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(path, compression=None) as f:
                        f.write(held)
                    out.append((collector, path))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["collector", "path"])

    return run


def _copy_dumps(folder, stamp):
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                system, path = rib_dump.file_system(f"{folder}/{stamp}.{r['path'].rsplit('/', 1)[1]}")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path, compression=None) as f:
                    f.write(r["content"])
                out.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["path"])

    return run


def dump_folders(spark, sf):
    """Compressed dumps in the shared folder: two collectors with a file per 20,000 order numbers, IPv6 beside them in the second, and
    files of a third, which are the first collector's cut in half."""
    four = dump_records(spark, sf).select("collector", F.concat(F.lit("v4-"), F.floor(F.col("l_orderkey") / 20000).cast("string")).alias("name"), "record")
    blocks = fx.blocks6(spark, sf).withColumn("s", addr.wide_hex("ip_start"))
    asns = F.array(F.lit(64501).cast("bigint"), (F.col("plen") + 65000).cast("bigint"))
    six = blocks.select(F.lit("rrc06").alias("collector"), F.concat(F.lit("v6-"), F.substring("s", 1, 8)).alias("name"),
                        _record("0004", _rib_body(F.col("s"), F.col("plen"), F.lit(0).cast("bigint"), asns)).alias("record"))
    per = four.unionByName(six).groupBy("collector", "name").agg(F.array_join(F.sort_array(F.collect_list("record")), "").alias("records"))
    content = F.unhex(F.concat(_record("0001", F.lit(PEERS)), F.col("records"))).alias("content")
    folder = scratch(spark)
    durable(per.select("collector", "name", content).mapInArrow(_write_dumps(folder), "collector string, path string"))
    return folder


_V4_HEX = "lpad(lower(printf('%x', ip_start)), 32, '0')"


@query(f"""SELECT collector, 4::BIGINT AS family, plen, {_V4_HEX} AS start_hex, peer_asn, '192.0.2.' || (peer_asn - 64500) AS peer_ip, array_to_string(asns, ' ') AS asns, count(*) AS n FROM fx_entry GROUP BY ALL
  UNION ALL SELECT 'rrc06', 6, plen, s, 64501, '192.0.2.1', '64501 ' || (65000 + plen), 1 FROM fx_block6""")
def read_rib(spark, sf):
    """Dump files of two collectors and both families, streamed by the dump source."""
    folder = dump_folders(spark, sf)
    e = rib_dump.read_rib(spark, {c: f"{folder}/{c}" for c in ("rrc01", "rrc06")}, torn="refuse")
    return e.groupBy("collector", "family", "plen", addr.wide_hex("ip_start").alias("start_hex"), "peer_asn", "peer_ip", base.joined("asns", " ").alias("asns")).agg(F.count(F.lit(1)).alias("n"))


cte("dump_per", """SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'rrc01' ELSE 'rrc06' END AS collector, floor(l_orderkey / 20000) AS f, count(*) + 1 AS n FROM lineitem JOIN fx_block ON k = l_partkey GROUP BY ALL
    UNION ALL SELECT 'rrc06', -ascii(s[8]) - 1000 * ascii(s[1]), count(*) + 1 FROM fx_block6 GROUP BY ALL""")


@query("""SELECT collector, TRUE AS complete, count(*) AS files, CAST(sum(n) AS BIGINT) AS records FROM dump_per GROUP BY collector UNION ALL SELECT 'cut', FALSE, count(*), NULL FROM dump_per WHERE collector = 'rrc01'""")
def dump_states(spark, sf):
    """What the status rows say of whole files and of files cut in half."""
    folder = dump_folders(spark, sf)
    s = rib_dump.dump_status(rib_dump.dump_frames(spark, {c: f"{folder}/{c}" for c in ("rrc01", "rrc06", "cut")}))
    return s.groupBy("collector", "complete").agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("complete"), F.col("records"))).alias("records"))


@query("""SELECT prefix, plen, ip_start, ip_end, peer_asn, '192.0.2.' || (peer_asn - 64500) AS peer_ip, array_to_string(asns, ' ') AS asns, count(*) AS n FROM fx_entry GROUP BY ALL""")
def rib_dump_entries(spark, sf):
    framed = durable(rib_dump.frames(dump_files(spark, sf)))
    e = rib_dump.entries_from_frames(framed)
    v4 = lambda c: addr.v4_from_wide(c).alias(c)
    return e.groupBy("prefix", "plen", v4("ip_start"), v4("ip_end"), "peer_asn", "peer_ip", base.joined("asns", " ").alias("asns")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT prefix, origin_asn, n_origins, n_paths, n_distinct_paths FROM pfx""")
def dump_to_prefixes(spark, sf):
    """From dump bytes to the prefix table."""
    e = rib_dump.entries_from_frames(durable(rib_dump.frames(dump_files(spark, sf), family=4)))
    return rib.prefix_dimension(rib.distinct_paths(e)).select("prefix", "origin_asn", "n_origins", "n_paths", "n_distinct_paths")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN fx_block ON k = l_partkey)")
def dump_prefix_limit(spark, sf):
    """One prefix per dump: the record limit applies to each file."""
    return rib_dump.frames(dump_files(spark, sf), limit=1).where(F.col("family") == 4).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- streams

_SUM = """SELECT user_id%20 AS probe, floor(min(value) FILTER (WHERE event_type <> 'error')*1000+0.5)/1000 AS min, floor(max(value) FILTER (WHERE event_type <> 'error')*1000+0.5)/1000 AS max,
  count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS rcv, count(*) FILTER (WHERE event_type = 'error') AS "drop" FROM events GROUP BY user_id%20"""


def _event_stream(spark, sf):
    """Events in the order of their time, a file for each fifth of the time; each file also repeats the event numbers divisible by 3 of the files before it, late."""
    e = fx.table(spark, sf, "events")
    span = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (span["hi"] - span["lo"]) / 5
    out = scratch(spark)
    for i in range(5):
        begin = F.lit(span["lo"] + step * i)
        own = (F.col("ts") >= begin) & ((F.col("ts") < F.lit(span["lo"] + step * (i + 1))) if i < 4 else F.lit(True))
        late = (F.col("ts") < begin) & (F.col("event_id") % 3 == 0)
        e.where(own | late).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(e.withColumn("ts", F.col("ts").cast("timestamp")).schema).option("maxFilesPerTrigger", 1).parquet(out)


@query(_SUM)
def ping_stream(spark, sf):
    """Every event is a one-sample round; the stream sees each of them twice at once, and a third of them again after they were forgotten."""
    e = _event_stream(spark, sf)
    ok = F.when(F.col("event_type") != "error", F.col("value"))
    r = e.select((F.col("user_id") % 20).alias("probe"), F.col("event_id").alias("round"), "ts", F.lit(1).cast("bigint").alias("total"),
                 F.when(ok.isNotNull(), 1).otherwise(0).cast("bigint").alias("rcv"), F.when(ok.isNull(), 1).otherwise(0).cast("bigint").alias("drop"),
                 ok.alias("min"), ok.alias("max"), ok.alias("avg"), F.explode(F.array(F.lit("finished"), F.lit("finished"))).alias("status"))
    out = scratch(spark)
    q = (SM.running_ping(r).writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/now"))
         .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/now").select("probe", "min", "max", "total", "rcv", "drop")


@query("SELECT user_id AS measurement, event_id%20 AS probe, event_id AS ttl FROM events")
def hop_stream(spark, sf):
    """Hops reported again by later polls come out once, also when they have been forgotten meanwhile."""
    h = _event_stream(spark, sf).select(F.col("user_id").alias("measurement"), (F.col("event_id") % 20).alias("probe"), F.col("event_id").alias("ttl"), "ts")
    out = scratch(spark)
    q = (SM.new_hops(h).drop("ts").writeStream.outputMode("append").format("parquet").option("path", f"{out}/hops").option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/hops")


@query("""SELECT (10*65536 + c_custkey) * 256 AS ip_start, 65000 + c_custkey AS origin, 'RADB' AS source FROM customer LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS t FROM events GROUP BY user_id) ON user_id = c_custkey
  WHERE t IS NULL OR t <> 'error' UNION SELECT (10*65536 + user_id) * 256, 65000 + user_id, 'RADB' FROM (SELECT user_id, max_by(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t <> 'error'""")
def delta_feed(spark, sf):
    """A feed of all events applied to a published state of all customers, then replayed."""
    feed = D.DeltaFeed(spark, scratch(spark))
    net = lambda c: addr.v4_text((F.lit(10 * 65536) + F.col(c)) * 256)
    text = lambda c: F.concat(F.lit("route: "), net(c), F.lit("/24\norigin: AS"), (F.col(c) + 65000).cast("string"), F.lit("\nsource: RADB"))
    feed.publish(rpsl.routes(spread(fx.table(spark, sf, "customer").select("c_custkey")).select(text("c_custkey").alias("object")), "RADB"), -1)
    e = spread(fx.table(spark, sf, "events").select("event_id", "event_type", "user_id"))
    op = F.when(F.col("event_type") == "error", "DEL ").otherwise("ADD ")
    texts = durable(e.select(F.concat(F.lit("%START\n\n"), op, F.col("event_id").cast("string"), F.lit("\n\n"), text("user_id"), F.lit("\n\n%END\n")).alias("text")))
    feed.apply_batch(texts)
    assert not feed.apply_batch(texts)
    return feed.state().select(addr.v4_from_wide("ip_start").alias("ip_start"), "origin", "source")


@query(f"""SELECT 'first' AS at, collector, 4::BIGINT AS family, count(*) AS n FROM fx_entry WHERE collector = 'rrc01' GROUP BY collector UNION ALL SELECT 'first', 'rrc06', 6, count(*) FROM fx_block6
  UNION ALL SELECT 'last', collector, 4, count(*) FROM fx_entry GROUP BY collector""")
def snapshot_refresh(spark, sf):
    """Snapshots swapped by a pointer: of the dumps at first, unchanged by a second look, then of one collector's newer dump, whose newest of all is torn."""
    made, source = dump_folders(spark, sf), scratch(spark)

    def put(collector, stamp, glob, as_collector=None):
        """Copies of dump files, the stamp before their names."""
        paths = spark.read.format("binaryFile").load(f"{made}/{collector}/{glob}").select("path", "content")
        durable(paths.mapInArrow(_copy_dumps(f"{source}/{as_collector or collector}", stamp), "path string"))

    stamp = lambda path: F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))
    store = refresh.SnapshotFolder(spark, scratch(spark))
    put("rrc01", "1", "v4-*")
    put("rrc06", "1", "v6-*")
    build = lambda entries, folder: entries.groupBy("collector", "family").agg(F.count(F.lit(1)).alias("n")).write.parquet(folder)
    first = refresh.refresh(spark, source, store, build, stamp)
    assert first and refresh.refresh(spark, source, store, build, stamp) is None
    put("rrc06", "2", "v4-*")
    put("cut", "3", "v4-*", "rrc06")
    last = refresh.refresh(spark, source, store, build, stamp)
    assert last == store.current()[0] and last != first and refresh.refresh(spark, source, store, build, stamp) is None
    read = lambda at, folder: spark.read.parquet(folder).select(F.lit(at).alias("at"), "collector", "family", "n")
    return read("first", first).unionByName(read("last", last))


@query("""SELECT (10*65536 + c_custkey) * 256 AS ip_start, 65000 + c_custkey AS origin FROM customer WHERE c_custkey % 5 <> 0
  UNION SELECT (10*65536 + c_custkey) * 256, 66000 + c_custkey FROM customer WHERE c_custkey % 7 = 0""")
def delta_merged(spark, sf):
    """Feeds batch by batch over a base that no batch rewrites: deletions, additions, objects of other classes, a torn, a gapped and a replayed feed."""
    c = spread(fx.table(spark, sf, "customer").select("c_custkey"))
    feed = D.DeltaFeed(spark, scratch(spark), fold_at=10.0)
    net = addr.v4_text((F.lit(10 * 65536) + F.col("c_custkey")) * 256)
    obj = lambda o: F.concat(F.lit("route: "), net, F.lit("/24\norigin: AS"), (F.col("c_custkey") + o).cast("string"), F.lit("\nsource: RADB"))
    feed.publish(rpsl.routes(c.select(obj(65000).alias("object")), "RADB"), 0)
    n = c.agg(F.max("c_custkey")).first()[0]
    # Of a customer's three serials the first removes every fifth one's object (others touch a maintainer), the second adds every seventh's other one.
    k, other = F.col("c_custkey"), F.lit("mntner: M\nsource: RADB")
    one = lambda op, at, body: F.concat(F.lit(op + " "), (k * 3 + 3 + at).cast("string"), F.lit("\n\n"), body, F.lit("\n\n"))
    ops = F.concat(F.when(k % 5 == 0, one("DEL", -2, obj(65000))).otherwise(one("ADD", -2, other)), F.when(k % 7 == 0, one("ADD", -1, obj(66000))).otherwise(one("DEL", -1, other)), one("ADD", 0, other))
    texts = durable(c.select("c_custkey", F.concat(F.lit("%START\n\n"), ops, F.lit("%END\n")).alias("text")))
    half = n // 2
    assert not feed.apply_batch(texts.where(k <= half).select(F.replace("text", F.lit("%END"), F.lit("")).alias("text")))  # torn
    assert feed.apply_batch(texts.where(k <= half)) and not feed.apply_batch(texts.where(k <= half))
    try:
        feed.apply_batch(texts.where((k > half) & (k != n - 1)))
        raise AssertionError("a gap was applied")
    except D.FeedGap:
        pass
    assert feed.apply_batch(texts) and feed.serial() == 3 * n + 3 and len(feed.current()["deltas"]) == 2
    return feed.state().select(addr.v4_from_wide("ip_start").alias("ip_start"), "origin")


# ---------------------------------------------------------------- everything

def _published(spark, sf):
    sets = rpsl.as_sets(set_texts(spark, sf), "RADB")
    n = fx.table(spark, sf, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("cc"), F.col("n_name").alias("name_en"), F.reverse("n_name").alias("name_zh"))
    inp = snapshot.Inputs(fx.entries(spark, sf), base.geo(spark, sf), fx.vrps(spark, sf), fx.irr_routes(spark, sf), sets, as_of={"rpki": "2026-12-01 08:00"}, country_names=n)
    out = scratch(spark)
    return out, snapshot.publish(snapshot.build(inp), out, stamp=1, parts=4)


def row_sum(*columns):
    """A sum over rows of the first 32 bits of each row's md5: equal for equal tables, whatever their order."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) if isinstance(c, str) else c for c in columns])
    return F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")).cast("bigint")


def row_sum_sql(*columns):
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)
    return f"CAST(sum(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::BIGINT) AS BIGINT)"


@query(f"""SELECT 'prefixes' AS name, {row_sum_sql('pid', 'prefix', 'plen', 'ip_start', 'ip_end', 'origin_asn', 'n_origins', 'n_paths', 'n_distinct_paths', "coalesce(cc, 'ZZ')", 'city')} AS content FROM tagged
  UNION ALL SELECT 'paths', {row_sum_sql('pid', 'path_str', "array_to_string(a, ' ')", 'path_len', 'n_peers', "CASE WHEN rn = 1 THEN 'true' ELSE 'false' END")} FROM arr_paths
  UNION ALL SELECT 'irr', {row_sum_sql('pid', 'origin')} FROM (SELECT DISTINCT p.pid, i.origin FROM pfx p JOIN irr_route i ON i.ip_start = p.ip_start AND i.ip_end = p.ip_end)
  UNION ALL SELECT 'dfz_ref', {row_sum_sql('family', 'dfz_ref')} FROM dfz
  UNION ALL SELECT 'countries', {row_sum_sql('cc', 'n')} FROM (SELECT cc, count(*) AS n FROM tagged WHERE cc IS NOT NULL GROUP BY cc)
  UNION ALL SELECT 'country_names', {row_sum_sql('cc', 'n_name')} FROM (SELECT DISTINCT cc FROM tagged) JOIN nation ON cc = 'C' || n_nationkey""")
def published_contents(spark, sf):
    """The contents of the published tables, row by row, as a reader of the snapshot finds them."""
    out, doc = _published(spark, sf)
    read = lambda t: snapshot.read_published(spark, out, t)
    named = {"prefixes": ("pid", "prefix", "plen", "ip_start", "ip_end", "origin_asn", "n_origins", "n_paths", "n_distinct_paths", "cc", "city"),
             "paths": ("pid", "path_str", F.array_join("path_arr", " "), "path_len", "n_peers", F.col("is_best").cast("string")),
             "irr": ("pid", "origin"), "dfz_ref": ("family", "dfz_ref"), "countries": ("cc", "n"), "country_names": ("cc", "name_en")}
    rows = None
    for t, columns in named.items():
        r = read(t).agg(row_sum(*columns).alias("content")).select(F.lit(t).alias("name"), "content")
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("""SELECT 'scope' AS topic, 'families' AS name, string_agg(DISTINCT family::VARCHAR, ',' ORDER BY family::VARCHAR) AS value FROM pfx UNION ALL SELECT 'scope', 'collectors', 'rrc01,rrc06'
  UNION ALL SELECT 'dfz_ref', family::VARCHAR, dfz_ref::VARCHAR FROM dfz UNION ALL SELECT 'rpki', 'count', count(*)::VARCHAR FROM fx_block UNION ALL SELECT 'rpki', 'as_of', '2026-12-01 08:00'
  UNION ALL SELECT 'irr', 'count', count(*)::VARCHAR FROM irr_route UNION ALL SELECT 'irr', 'sources', string_agg(DISTINCT source, ',' ORDER BY source) FROM irr_route
  UNION ALL SELECT 'asset', 'n_sets', count(*)::VARCHAR FROM set_dim UNION ALL SELECT 'asset', 'n_edges', count(*)::VARCHAR FROM set_edge UNION ALL SELECT 'asset', 'sources', 'RADB,RIPE'""")
def snapshot_facts(spark, sf):
    """What a published snapshot tells of its making."""
    return snapshot.read_published(spark, _published(spark, sf)[0], "facts")


@query("""SELECT 'prefixes' AS name, count(*) AS n FROM pfx UNION ALL SELECT 'paths', count(*) FROM ranked UNION ALL SELECT 'pathsearch', count(*) FROM search_table
  UNION ALL SELECT 'country_names', count(DISTINCT cc) FROM tagged UNION ALL SELECT 'asn_neigh', count(*) FROM adj UNION ALL SELECT 'geo', count(*) FROM (SELECT DISTINCT pid, cc, city FROM pieces)
  UNION ALL SELECT 'irr', count(*) FROM (SELECT DISTINCT p.pid, i.origin FROM pfx p JOIN irr_route i ON i.ip_start = p.ip_start AND i.ip_end = p.ip_end)
  UNION ALL SELECT 'asset_set', count(*) FROM set_dim UNION ALL SELECT 'asset_member', count(*) FROM set_edge UNION ALL SELECT 'asset_memberof', count(*) FROM set_edge
  UNION ALL SELECT 'dfz_ref', count(*) FROM dfz UNION ALL SELECT 'countries', count(DISTINCT cc) FROM tagged
  UNION ALL SELECT 'cities', count(*) FROM (SELECT cc, city FROM tagged WHERE cc IS NOT NULL AND city IS NOT NULL GROUP BY cc, city HAVING count(*) >= 2)
  UNION ALL SELECT 'facts', 9 + count(*) FROM dfz""")
def published_snapshot(spark, sf):
    """The whole snapshot built, written, checked against its manifest and read back."""
    out, doc = _published(spark, sf)
    sets_ = doc.select(F.explode("datasets").alias("d")).select("d.dataset")
    names = [r["dataset"] for r in sets_.collect()]  # table names
    counts = None
    for n in names:
        c = snapshot.read_published(spark, out, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        counts = c if counts is None else counts.unionByName(c)
    return counts
