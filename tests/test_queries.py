"""A spread of registered queries beside their SQL, and plan checks."""

import pytest

import __spark_entry__ as E
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["best_offer_per_variant", "price_catalog_rollup", "two_step_lookup", "markup_override", "path_prefix_filter", "header_dedupe", "line_filter", "tier_pairs",
         "post_render", "publication_plan", "order_break", "page_prices", "suppress_window", "suppress_same_as_last", "stream_suppress", "theta_match_nullsafe", "deep_markup", "deep_subtree", "wildcard_sheet", "edit_chains", "menu_changes", "model_pages", "speaks_against"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, msg = compare(spark, connect(SF), name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert ok, msg


def test_registry():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q)


@pytest.mark.parametrize("name", ["best_offer_per_variant", "offer_dedupe", "unmatched_variants", "margin_bands"])
def test_plan(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "ReadSchema" in plan
