"""Plan properties of every registered query (sf0.001 plans, nothing executed)."""

import pytest

from prefspark.plans.inspect import physical_plan, python_operators, read_schemas, unbounded_single_partition
from prefspark.registry import QUERIES

from shared_paths import SF001

HOOKS = {"map_responses", "map_verdicts"}
# One row per evaluated model: the final ordering window is over that small table.
SMALL_TABLE_WINDOWS = {"compare_models"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_plan(spark, name):
    df = QUERIES[name](spark, SF001)
    py = python_operators(df)
    if name in HOOKS:
        assert py, "hook queries run through mapInPandas"
    else:
        assert not py, f"Python operator in a non-hook plan: {py}"
    if name not in SMALL_TABLE_WINDOWS:
        assert not unbounded_single_partition(df), "row-sized input funnelled into one task"


def test_scans_are_pruned(spark):
    df = QUERIES["score_math"](spark, SF001)
    schemas = read_schemas(df)
    assert schemas and all("o_orderdate" not in s and "o_orderpriority" not in s for s in schemas)


def test_influence_pairs_reads_documents_and_scores_once(spark):
    """The wide side joins the ranked ids; gradients are not scanned again for it."""
    plan = physical_plan(QUERIES["influence_pairs"](spark, SF001))
    assert "embeddings.parquet" not in plan and plan.count("documents.parquet") <= 2
