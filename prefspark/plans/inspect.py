"""Plan checks: what a reviewer looks for in ``explain()``, as functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Operators whose output is bounded by design (aggregates, top-k, local data).
_BOUNDED = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject",
            "LocalTableScan", "GlobalLimit", "CollectLimit")
_PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
           "MapInArrow", "PythonUDF")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_inputs(df: DataFrame) -> list[str]:
    """Operator directly under each ``Exchange SinglePartition`` (one task reads all of it)."""
    lines = physical_plan(df).splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            m = re.search(r"[+:\- ]*(?:\*\(\d+\) )?([A-Za-z]+)", lines[i + 1])
            out.append(m.group(1) if m else lines[i + 1].strip())
    return out


def unbounded_single_partition(df: DataFrame) -> list[str]:
    """SinglePartition exchanges whose input is not an aggregate, top-k or local data."""
    return [op for op in single_partition_inputs(df) if op not in _BOUNDED]


def python_operators(df: DataFrame) -> list[str]:
    plan = physical_plan(df)
    return [p for p in _PYTHON if p in plan]


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^ ]*>)", physical_plan(df))
