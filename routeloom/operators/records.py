"""Registry answers (RDAP JSON, WHOIS text) to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (EVENT_FIELDS, VCARD_FIELDS, WHOIS_BRACKET, WHOIS_HIDDEN_VALUE, WHOIS_LABELS, WHOIS_NS_HEADERS)
from ..functions.text import iso_date, literal_map
from ..session import durable

RDAP_SCHEMA = (
    "struct<handle:string,startAutnum:bigint,endAutnum:bigint,name:string,ldhName:string,unicodeName:string,"
    "startAddress:string,endAddress:string,type:string,parentHandle:string,country:string,status:array<string>,"
    "port43:string,cidr0_cidrs:array<struct<v4prefix:string,v6prefix:string,length:string>>,"
    "events:array<struct<eventAction:string,eventDate:string>>,"
    "nameservers:array<struct<ldhName:string,handle:string>>,secureDNS:struct<delegationSigned:boolean>,"
    "remarks:array<struct<title:string,description:array<string>>>,"
    "entities:array<variant>>")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def parse_rdap(docs: DataFrame, json: str = "json") -> DataFrame:
    """(kind, key, json) to (kind, key, doc); kind is autnum, ip or domain."""
    return docs.withColumn("doc", F.from_json(json, RDAP_SCHEMA)).drop(json)


def _row(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"))


def rdap_head(parsed: DataFrame) -> DataFrame:
    """Ordered head rows (kind, key, ord, field, value) of each document."""
    d = lambda f: F.col(f"doc.{f}")
    key, kind = F.col("key"), F.col("kind")
    span = F.when(d("startAutnum").eqNullSafe(d("endAutnum")), F.concat(F.lit("AS"), d("startAutnum").cast("string"))).otherwise(
        F.concat(F.lit("AS"), d("startAutnum").cast("string"), F.lit(" – AS"), d("endAutnum").cast("string")))
    cidr = F.array_join(F.transform(d("cidr0_cidrs"), lambda c: F.concat(F.coalesce(_filled(c["v4prefix"]), c["v6prefix"]), F.lit("/"), c["length"])), ", ")
    autnum = F.array(_row("handle", F.coalesce(_filled(d("handle")), F.concat(F.lit("AS"), key))), _row("name", _filled(d("name"))),
                     _row("asrange", F.when(d("startAutnum").isNotNull(), span)))
    domain = F.array(_row("ldhname", F.coalesce(_filled(d("ldhName")), key)),
                     _row("name", F.when(~d("unicodeName").eqNullSafe(d("ldhName")), _filled(d("unicodeName")))),
                     _row("handle", _filled(d("handle"))))
    ip = F.array(_row("name", _filled(d("name"))), _row("handle", F.coalesce(_filled(d("handle")), key)),
                 _row("iprange", F.when(_filled(d("startAddress")).isNotNull(), F.concat(d("startAddress"), F.lit(" – "), d("endAddress")))),
                 _row("cidr", _filled(cidr)), _row("iptype", _filled(d("type"))), _row("parent", _filled(d("parentHandle"))))
    head = F.when(kind == "autnum", autnum).when(kind == "domain", domain).otherwise(ip)
    common = F.array(_row("country", _filled(d("country"))), _row("status", _filled(F.array_join(d("status"), ", "))))
    events = F.transform(d("events"), lambda e: F.struct(F.element_at(literal_map(EVENT_FIELDS), e["eventAction"]).alias("field"),
                                                         iso_date(e["eventDate"]).alias("value")))
    ns = F.when(kind == "domain", F.transform(d("nameservers"), lambda n: _row("ns", F.coalesce(_filled(n["ldhName"]), _filled(n["handle"])))))
    sec = F.when((kind == "domain") & d("secureDNS").isNotNull(), F.array(_row(
        "dnssec", F.when(d("secureDNS")["delegationSigned"], "signed").otherwise("unsigned"))))
    empty = F.array().cast("array<struct<field:string,value:string>>")
    rows = F.concat(*[F.coalesce(x, empty) for x in (head, common, events, ns, sec)])
    rows = F.filter(rows, lambda r: r["field"].isNotNull() & r["value"].isNotNull())
    return parsed.select("kind", "key", F.posexplode(rows).alias("ord", "r")).select("kind", "key", "ord", "r.field", "r.value")


def rdap_remarks(parsed: DataFrame) -> DataFrame:
    text = F.trim(F.array_join(F.col("r.description"), "\n"))
    return (parsed.select("kind", "key", F.posexplode("doc.remarks").alias("ord", "r"))
            .select("kind", "key", "ord", F.coalesce("r.title", F.lit("")).alias("title"), text.alias("value")).where(F.col("value") != ""))


def vcard_items(vcard_array: Column) -> Column:
    """The property tuples of a jCard; every element as text, nested values as JSON."""
    return F.from_json(F.get(vcard_array, F.lit(1)), "array<array<string>>")


def _joined(value: Column, sep: str) -> Column:
    parts = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(value.startswith("["), F.array_join(parts, sep)).otherwise(value)


def vcard_rows(vcard_array: Column) -> Column:
    """Distinct (field, value) rows of a jCard: labels for addresses, fax told from phone."""
    fields = literal_map(VCARD_FIELDS)

    def one(it):
        prop, params, value = F.get(it, F.lit(0)), F.get(it, F.lit(1)), F.get(it, F.lit(3))
        label = _filled(F.get_json_object(params, "$.label"))
        address = F.coalesce(F.regexp_replace(label, r"\s*\n+\s*", ", "), _joined(value, ", "))
        fax = (prop == "tel") & F.coalesce(F.get_json_object(params, "$.type"), F.lit("")).rlike("(?i)fax")
        field = F.when(fax, "fax").otherwise(F.coalesce(F.element_at(fields, prop), prop))
        text = F.when(prop == "adr", address).otherwise(_joined(value, " "))
        return F.struct(field.alias("field"), F.trim(F.coalesce(text, F.lit(""))).alias("value"))

    items = F.filter(vcard_items(vcard_array), lambda it: F.get(it, F.lit(0)) != "version")
    rows = F.filter(F.transform(items, one), lambda r: r["value"] != "")
    return F.array_distinct(F.coalesce(rows, F.array().cast("array<struct<field:string,value:string>>")))


def entity_name(entity: Column) -> Column:
    fn = F.get(F.filter(vcard_items(entity["vcardArray"]), lambda it: F.get(it, F.lit(0)) == "fn"), F.lit(0))
    return F.coalesce(_filled(F.get(fn, F.lit(3))), _filled(entity["handle"]), _filled(F.get(entity["roles"], F.lit(0))), F.lit("?"))


def entity(v: Column) -> Column:
    """An entity, parsed with its document, as struct(handle, roles, vcardArray, entities); nested entities stay as they were parsed."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    card = F.array(F.lit("vcard"), get("$.vcardArray[1]", "string"))
    return F.struct(get("$.handle", "string").alias("handle"), get("$.roles", "array<string>").alias("roles"), card.alias("vcardArray"),
                    get("$.entities", "array<variant>").alias("entities"))


def rdap_entities(parsed: DataFrame) -> DataFrame:
    """The entity tree, one row per entity: (kind, key, trail, depth, handle, roles, name, rows).

    ``trail`` holds the positions from the top, so it orders the tree. Documents are parsed once; each level is written and its
    nested entities are the next, until a level is empty, however deep that is.
    """
    level = parsed.select("kind", "key", F.posexplode("doc.entities").alias("p", "v")).withColumn("trail", F.array("p"))
    out, depth = None, 0
    while True:
        level = level.select("kind", "key", "trail", entity(F.col("v")).alias("e"))
        flat = level.select("kind", "key", "trail", F.lit(depth).alias("depth"), F.col("e.handle").alias("handle"),
                            F.coalesce("e.roles", F.array().cast("array<string>")).alias("roles"),
                            entity_name(F.col("e")).alias("name"), vcard_rows(F.col("e.vcardArray")).alias("rows"), F.col("e.entities").alias("below"))
        flat = durable(flat)
        if out is not None and flat.isEmpty():
            return out
        out = flat.drop("below") if out is None else out.unionByName(flat.drop("below"))
        level = flat.select("kind", "key", "trail", F.posexplode("below").alias("p", "v")).withColumn("trail", F.concat("trail", F.array("p")))
        depth += 1


def holder(parsed: DataFrame) -> DataFrame:
    """(kind, key, org, netname, cc, holder): the registrant, else administrative, else first entity.

    Its organisation row wins over its name; ``holder`` falls back to the network name.
    """
    ents = F.transform("doc.entities", entity)
    role = lambda r: F.get(F.filter(ents, lambda e: F.array_contains(e["roles"], r)), F.lit(0))
    one = parsed.select("kind", "key", F.coalesce(role("registrant"), role("administrative"), F.get(ents, F.lit(0))).alias("e"),
                        F.coalesce("doc.name", F.lit("")).alias("netname"), F.coalesce("doc.country", F.lit("")).alias("cc"))
    org_row = F.get(F.filter(vcard_rows(F.col("e.vcardArray")), lambda r: r["field"] == "org"), F.lit(0))["value"]
    name = entity_name(F.col("e"))
    org = F.when(F.col("e").isNotNull(), F.coalesce(_filled(org_row), F.when(name != "?", name))).otherwise(F.lit(None))
    return (one.withColumn("org", F.coalesce(org, F.lit(""))).drop("e")
            .withColumn("holder", F.coalesce(_filled(F.col("org")), F.col("netname"))))


# ---------------------------------------------------------------- WHOIS text

_BLANK = r"\s\u3000\u00a0\ufeff"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{_BLANK}]+|[{_BLANK}]+$", "")


def clean_label(c: Column) -> Column:
    return F.lower(_trim(F.regexp_replace(F.regexp_replace(c, f"^[{_BLANK}*>]+", ""), f"[{_BLANK}.]+$", "")))


def parse_whois(docs: DataFrame, key: str = "domain", text: str = "text", server: str | None = None) -> DataFrame:
    """WHOIS texts to (key, [server], ord, field, value), one set of rows per input row.

    Four line forms: ``Label: value``, ``[Label] value``, repeated ``key: value``, and a label line with
    indented values below. The only state is the label still open, which a run of indented lines inherits
    from the line above it; a fold over the lines of the row carries it, so nothing is shuffled and several
    texts of one domain stay apart.
    """
    own = [key, *([server] if server else [])]
    known = literal_map({label: field for field, labels in WHOIS_LABELS.items() for label in labels})
    after = lambda line: _trim(F.substring(line, F.instr(line, ":") + 1, F.length(line)))

    def kind(line: Column) -> Column:
        return (F.when((line == "") | line.rlike("^[%#]"), "reset").when(line.rlike(WHOIS_BRACKET), "bracket")
                .when(F.instr(line, ":") > 0, F.when(after(line) != "", "pair").otherwise("open")).otherwise("bare"))

    def labelled(x: Column) -> Column:
        line, k = x["line"], x["kind"]
        label = (F.when(k == "bracket", clean_label(F.regexp_extract(line, WHOIS_BRACKET, 1)))
                 .when(k.isin("pair", "open"), clean_label(F.substring(line, F.lit(1), F.instr(line, ":") - 1))).when(k == "bare", clean_label(line)))
        value = F.when(k == "bracket", F.regexp_extract(line, WHOIS_BRACKET, 2)).when(k == "pair", after(line)).otherwise(line)
        return F.struct(k.alias("kind"), label.alias("label"), value.alias("value"), ((k == "bare") & x["raw"].rlike("^[ \t\u3000]")).alias("follows"))

    def named(x: Column) -> Column:
        label = x["label"]
        field = F.coalesce(F.try_element_at(known, F.coalesce(label, F.lit(""))), F.when(label.startswith("registrar abuse contact email"), "email")
                           .when(label.startswith("registrant ") & label.endswith(" organization"), "org").when(label.rlike(r"^ns_name_\d+$"), "ns"))
        return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["follows"].alias("follows"), field.alias("field"),
                        F.coalesce(label.isin(WHOIS_NS_HEADERS), F.lit(False)).alias("header"))

    dates = ["registration", "lastchanged", "expiration"]

    def written(x: Column) -> Column:
        # Both readings of a value, once per line: the fold below mentions the value often and only chooses between them.
        dated = F.when(x["follows"] | x["field"].isin(dates), _trim(iso_date(x["value"])))
        return F.struct(*[x[c].alias(c) for c in ("kind", "follows", "field", "header")], _trim(x["value"]).alias("value"), dated.alias("dated"))

    def step(acc: Column, x: Column) -> Column:
        field, header, follows, open_ = x["field"], x["header"], x["follows"], acc["open"]
        opens = (F.when(x["kind"] == "pair", F.when(field == "ns", "ns")).when(x["kind"] == "open", F.coalesce(field, F.when(header, "ns")))
                 .when(x["kind"] == "bare", F.when(header, "ns")))
        j = acc["j"] + 1
        inherited = F.when(open_ == "ns", "ns").when(open_.isNotNull() & (j == 1), open_).when(acc["ns"], "ns")
        later = header & (open_.isNull() | ((open_ != "ns") & (j > 1)))
        got = F.when(follows, inherited).when(x["kind"].isin("pair", "bracket"), field)
        value = F.when(got.isin(dates), x["dated"]).otherwise(x["value"])
        keep = got.isNotNull() & (got != "ldhname") & (value != "") & ~value.rlike(WHOIS_HIDDEN_VALUE)
        seen = F.exists(acc["found"], lambda y: (y["field"] == got) & (y["value"] == value))
        return F.struct(
            F.when(follows, open_).otherwise(opens).alias("open"), F.when(follows, j).otherwise(0).alias("j"),
            F.when(follows, acc["ns"] | later).otherwise(False).alias("ns"), (acc["no"] + 1).alias("no"),
            F.when(F.coalesce(keep & ~seen, F.lit(False)), F.concat(acc["found"], F.array(F.struct((acc["no"] + 1).alias("ord"), got.alias("field"), value.alias("value"))))).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(None).cast("string").alias("open"), F.lit(0).alias("j"), F.lit(False).alias("ns"), F.lit(0).alias("no"),
                     F.array(F.struct(F.lit(0).alias("ord"), F.lit("ldhname").alias("field"), F.col(key).cast("string").alias("value"))).alias("found"))
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda raw: F.struct(raw.alias("raw"), _trim(raw).alias("line")))
    d = docs.select(*own, F.transform(lines, lambda x: F.struct(x["raw"].alias("raw"), x["line"].alias("line"), kind(x["line"]).alias("kind"))).alias("_l"))
    d = d.withColumn("_l", F.transform("_l", labelled))
    d = d.withColumn("_l", F.transform("_l", named))
    d = d.withColumn("_l", F.transform("_l", written))
    return d.select(*own, F.inline(F.aggregate("_l", start, step)["found"]))
