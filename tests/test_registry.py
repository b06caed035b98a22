"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import oracle
from imagora.plans import registry

SF = "/root/testdata/sf0.001"
# one or two of every module here; IMAGORA_ALL_QUERIES=1 runs every one
SHORT = ("parse_generated embed_text bm25_topk_padded fused_topk_text gate_s2_text dense_topk "
         "centroid_fields fused_fallback two_stage_topk ndcg_at_k metric_grid_splits route_l2a "
         "gate_calibrate loading_arms k_curve bootstrap_arms bootstrap_hier scan_run cache_audit "
         "routed_cost table_digest validate_run scan_payload scan_named_runs value_rules "
         "router_block_check route_levels signal_misses two_stage_topk_text bm25_blocks "
         "dense_topk_bounded prefix_proofs text_totals json_digests file_problems routed_run gate_apply reuse_audit").split()
NAMES = list(registry.QUERIES) if os.environ.get("IMAGORA_ALL_QUERIES") else SHORT

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"bootstrap_multinomial"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    r = oracle.compare(spark, con, SF, name, registry.QUERIES[name], registry.ORACLE.get(name))
    assert r["ok"], r
    assert not r.get("types"), r


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["domain", "metric", "n", "value"] and df.count() > 0
