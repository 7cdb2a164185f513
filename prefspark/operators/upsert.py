"""Keyed table upsert (S6): the new rows replace or add, other keys are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_by_key(old: DataFrame | None, new: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """old rows whose key is not in ``new``, plus the row of each key of ``new``.

    Of several new rows with one key the last by ``order`` wins (a column of
    ``new``; without it, and among equals, the last by the row's JSON text). A
    missing old table counts as empty. Write the result to a new path; never
    overwrite the table being read.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct("*")))
    last = new.select(*[F.col(k) for k in keys], F.struct("*").alias("_row"), rank.alias("_rank"))
    new = last.groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row")).select("_row.*")
    if old is None:
        return new
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
