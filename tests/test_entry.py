"""Every query beside its SQL at the smallest scale, and the shape of the plans."""

from __future__ import annotations

import io
import contextlib

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
OWN_TESTS = ("op", "pipeline")  # the optional subpackage has tests of its own
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith(OWN_TESTS)}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}
LONG = {"impute_forest", "linkage_merges", "cut_tree", "community_split"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 80


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


PLANNED = [
    "metabolism_site_abundance", "metabolism_class_abundance", "trophic_class", "redox_traits", "taxon_mask",
    "fixation_trait_totals", "presence_agreement", "trait_prevalence", "heatmap_cells", "average_rank", "make_unique",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF).explain("formatted")
    plan = out.getvalue()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES["marker_filter"](spark, SF).explain("formatted")
        QUERIES["entity_total"](spark, SF).explain("formatted")
    plan = out.getvalue()
    assert "EqualTo(p_brand,Brand#1)" in plan
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
