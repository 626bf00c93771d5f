"""Shared intermediate frames for the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeloom.operators import adjacency, geo as G, rib, search, validation

from routeloom.session import durable

from . import fixtures as fx


def merged(spark, sf):
    return rib.distinct_paths(fx.entries(spark, sf))


def prefixes(spark, sf):
    return durable(rib.with_pids(rib.prefix_dimension(merged(spark, sf))))


def with_ids(spark, sf):
    # The merged table feeds both the prefix table and the paths; it is computed from the entries once.
    m = durable(merged(spark, sf))
    p = durable(rib.with_pids(rib.prefix_dimension(m)))
    return p, rib.attach_pids(m, p)


def ranked(spark, sf):
    return rib.ranked_paths(with_ids(spark, sf)[1])


def paths(spark, sf):
    """Published paths with their text."""
    return rib.exported_paths(ranked(spark, sf))


def geo(spark, sf):
    return G.build_geo(fx.geo_raw(spark, sf))


def tagged(spark, sf):
    return G.tag_places(prefixes(spark, sf), geo(spark, sf))


def codes(spark, sf, pathobs):
    return validation.statuses(validation.route_origins(pathobs), fx.vrps(spark, sf), fx.irr_routes(spark, sf))


def table(spark, sf):
    p, po = with_ids(spark, sf)
    per = rib.paths_per_prefix(rib.ranked_paths(po))
    return search.search_table(G.tag_places(p, geo(spark, sf)), po, per, codes(spark, sf, po))


def adj(spark, sf):
    return adjacency.adjacency(paths(spark, sf))


def joined(c, sep=","):
    """Array column as text."""
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"), sep)
