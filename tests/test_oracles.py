"""A cross-section of the registered queries against their DuckDB statements on the smallest tables.

``python -m checks.verify <sf_dir>`` runs all of them.
"""

import pytest

from checks import catalog, verify

SF = "/root/testdata/sf0.001"
NAMES = ["merged_paths", "prefix_ids_both_families", "multi_origin", "path_search", "path_search_excluding", "longest_match", "nearest_parents_v6", "cidr_lists",
         "rpki_status", "irr_details", "places_of_prefixes", "segments", "as_relations", "adjacency_evidence", "as_set_tree", "whois_fields", "rdap_head", "hop_places",
         "delta_applied", "rib_dump_entries", "ping_stream"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    con = verify.duck(SF)
    status, _, _, note = verify.compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert status == "ok", note


def test_entry_has_rows():
    import __spark_entry__ as E
    assert "path_search" in E.queries() and set(E.oracle_sql()) <= set(E.queries())
