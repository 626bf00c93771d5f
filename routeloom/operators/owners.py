"""Registry objects: owners of networks, their summaries, and whois models.

Object tables have ``type``, ``name`` and ``attrs ARRAY<STRUCT<key, value>>`` in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import HIDDEN_ATTRIBUTES


def values_of(key: str, attrs="attrs") -> Column:
    """All values of a key, in order."""
    return F.transform(F.filter(F.col(attrs), lambda a: a["key"] == key), lambda a: a["value"])


def first_of(key: str, attrs="attrs") -> Column:
    return F.get(values_of(key, attrs), F.lit(0))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def responsible(attrs="attrs") -> Column:
    """First admin-c, else first tech-c."""
    return F.coalesce(_filled(first_of("admin-c", attrs)), first_of("tech-c", attrs))


def of_type(objects: DataFrame, kind: str) -> DataFrame:
    return objects.where(F.col("type") == kind)


def persons(objects: DataFrame) -> DataFrame:
    return of_type(objects, "person").select(F.col("name").alias("person"),
                                             F.coalesce(_filled(first_of("person")), F.col("name")).alias("person_name"))


def asn_owners(objects: DataFrame) -> DataFrame:
    """(asn, as_name, person): the contact if it is a known person, else the maintainer's contact."""
    known = persons(objects).select("person", F.lit(True).alias("ok"))
    nets = (of_type(objects, "aut-num").where(F.col("name").rlike(r"^AS\d+$"))
            .select(F.substring("name", F.lit(3), F.length("name")).try_cast("bigint").alias("asn"), first_of("as-name").alias("as_name"),
                    responsible().alias("c1"), first_of("mnt-by").alias("mnt")))
    mnt = of_type(objects, "mntner").select(F.col("name").alias("mnt"), responsible().alias("c2"))
    j = (nets.join(known.select(F.col("person").alias("c1"), F.col("ok").alias("ok1")), "c1", "left")
         .join(mnt, "mnt", "left").join(known.select(F.col("person").alias("c2"), F.col("ok").alias("ok2")), "c2", "left"))
    return j.select("asn", "as_name", F.coalesce(F.when(F.col("ok1"), F.col("c1")), F.when(F.col("ok2"), F.col("c2"))).alias("person"))


def person_summary(owners: DataFrame, people: DataFrame, prefix_counts: DataFrame) -> DataFrame:
    """Networks and prefixes per person, restricted to networks that were seen.

    ``prefix_counts`` has (asn, n_prefix) for every seen network, 0 for transit only.
    """
    rows = owners.where(F.col("person").isNotNull()).join(prefix_counts, "asn")
    g = rows.groupBy("person").agg(F.sort_array(F.collect_set("asn")).alias("asns"), F.sum("n_prefix").alias("n_prefix"))
    return g.join(people, "person", "left").select(
        "person", F.coalesce("person_name", "person").alias("name"), "asns", "n_prefix")


def in_summary_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("n_prefix"), F.lower("name"), "person")


def seen_networks(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct ASNs on kept paths or as representative origin."""
    on_paths = paths.select(F.explode("path_arr").alias("asn"))
    return on_paths.unionByName(prefixes.select(F.col("origin_asn").alias("asn"))).where(F.col("asn").isNotNull()).distinct()


def restrict_to_seen(dim: DataFrame, seen: DataFrame) -> DataFrame:
    return dim.join(seen.select("asn"), "asn", "left_semi")


def whois_head(objects: DataFrame) -> DataFrame:
    """Attribute rows of every object in order, credentials left out."""
    rows = objects.select("type", "name", F.posexplode("attrs").alias("pos", "a"))
    return rows.where(~F.col("a.key").isin(HIDDEN_ATTRIBUTES)).select("type", "name", "pos", "a.key", "a.value")


def whois_entities(objects: DataFrame, kind: str = "aut-num") -> DataFrame:
    """Contacts and maintainers of each object, each (role, handle) once, known ones only.

    ``ord`` follows admin-c, tech-c, then mnt-by, in attribute order; the contact's own attribute rows
    come along without credentials.
    """
    roles = {"admin-c": (0, "person"), "tech-c": (1, "person"), "mnt-by": (2, "mntner")}
    rows = of_type(objects, kind).select("name", F.posexplode("attrs").alias("pos", "a")).where(F.col("a.key").isin(list(roles)))
    r = F.col("a.key")
    rank = F.when(r == "admin-c", 0).when(r == "tech-c", 1).otherwise(2)
    target = F.when(r == "mnt-by", "mntner").otherwise("person")
    once = (rows.select("name", r.alias("role"), F.col("a.value").alias("handle"), target.alias("t"), rank.alias("rank"), "pos")
            .groupBy("name", "role", "handle", "t", "rank").agg(F.min("pos").alias("pos")))
    shown = F.filter("attrs", lambda a: ~a["key"].isin(HIDDEN_ATTRIBUTES))
    label = F.when(F.col("type") == "person", F.coalesce(_filled(first_of("person")), F.col("name"))).otherwise(F.col("name"))
    card = (objects.where(F.col("type").isin("person", "mntner"))
            .select(F.col("type").alias("t"), F.col("name").alias("handle"), label.alias("label"), shown.alias("rows")))
    return once.join(card, ["t", "handle"]).select("name", "role", "handle", "label", "rows", "rank", "pos")
