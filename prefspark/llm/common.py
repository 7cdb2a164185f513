"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000
GROUP = 512  # items of an array that are handled together where each item needs what comes before it
SLICE_BYTES = 4_000_000  # of text that a task turns into Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words (maximal runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffle join).

    ``df`` is counted up to the limit, so pass a written table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1): the first 52 bits of an MD5 of the parts joined by ``|`` (null: ``\\N``)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes in a string column together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, done = 0, 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, upto - at)
        at, done = upto, int(ends[upto - 1])


def release_memory() -> None:
    """At the end of a task: what Arrow and the C library keep for reuse goes back, as workers live on in stages that do not need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once even where ``use`` needs it inside a function of array items."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_groups(items: Column, size: int = GROUP) -> Column:
    """An array, not empty, as an array of arrays of ``size`` items (the last: fewer)."""
    def cut(a):
        last = F.floor((F.size(a) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(a, g * size + 1, F.lit(size)))

    return bound(items, cut)


def _growing(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state before each item, for a short array: the list is copied at every item."""
    none = F.expr("cast(array() as array<int>)")

    def add(acc, x):
        return F.struct(step(acc["at"], x).cast("int").alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list"))

    return F.aggregate(items, F.struct(start.cast("int").alias("at"), none.alias("list")), add, lambda acc: acc["list"])


def states_before(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each item the int that ``join`` has made, from 0, of the values of all items before it.

    ``join`` is a sum or a maximum.  Groups are joined first, so that no list
    longer than a group or the number of groups is ever copied: an array of n
    items takes n * GROUP steps at most, not n * n.
    """
    def joined(groups):
        of_group = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, x: join(a, value(x)).cast("int")))
        before = _growing(of_group, F.lit(0), join)
        return F.flatten(F.zip_with(groups, before, lambda g, b: _growing(g, b, lambda a, x: join(a, value(x)))))

    none = F.expr("cast(array() as array<int>)")
    return bound(items, lambda a: F.when(F.size(a) > 0, bound(in_groups(a), joined)).otherwise(none))
