"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

In a uniform permutation of all rows, cut into bins of given sizes, the numbers
of rows that go from input partition p to bin b follow a multivariate
hypergeometric law.  So

1. the rows of every input partition are counted;
2. the matrix (partition x bin) is drawn exactly: a binary tree over the
   partitions splits the bins' free places between its two halves.  Each draw
   is seeded by its tree node, so a task finds its own row of the matrix by the
   few draws on its path, and a task that is run again draws the same;
3. each task shuffles the bin labels of its row over its rows (local permutation);
4. the rows are exchanged by bin;
5. each bin orders its rows at random (second local permutation), which gives
   the slot: the bin's first slot plus the place in the bin.

A shard is a run of bins, and a bin has ``BIN_ROWS`` rows at most, so no task
holds a whole shard.  Shard sizes are at most one row apart.

Defined cases: nulls, empty and repeated rows are rows like any other; with
fewer rows than shards some shards are empty; an empty table gives an empty
table.  Input columns named shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import without
from prefspark.session import materialize

BIN_ROWS = 50_000
MAX_BINS = 1 << 16


def even_sizes(total: int, parts: int) -> np.ndarray:
    """``total`` split into ``parts`` sizes that are at most one apart."""
    return np.full(parts, total // parts, dtype=np.int64) + (np.arange(parts) < total % parts)


def bin_sizes(rows: int, shards: int, bin_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot) of every bin; the bins of a shard are consecutive and even."""
    size, shard, first = [], [], []
    for k, n in enumerate(even_sizes(rows, shards)):
        parts = even_sizes(int(n), max(1, -(-int(n) // bin_rows)))
        size += parts.tolist()
        shard += [k] * len(parts)
        first += (np.cumsum(parts) - parts).tolist()
    return np.array(size, dtype=np.int64), np.array(shard, dtype=np.int32), np.array(first, dtype=np.int64)


def draw(rng: np.random.Generator, free: np.ndarray, taken: int) -> np.ndarray:
    """Multivariate hypergeometric: of ``free`` places per bin, how many are among ``taken`` random ones."""
    out = np.zeros_like(free)
    left = int(free.sum())
    for b in np.flatnonzero(free):
        if not taken:
            break
        n, left = int(free[b]), left - int(free[b])
        out[b] = k = hypergeometric(rng, n, left, taken)
        taken -= k
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """Exact draw; beyond the sizes that numpy takes, block after block of places."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, taken)) if taken else 0
    # a uniform choice of ``taken`` places, one block of places after the other
    out, block = 0, 400_000_000
    while taken and good:
        g = min(good, max(1, round(block * good / (good + bad))))
        b = min(bad, block - g)
        rest = good + bad - g - b
        k = taken if not rest else _split(rng, g + b, rest, taken)
        out += int(rng.hypergeometric(g, b, k)) if k else 0
        good, bad, taken = good - g, bad - b, taken - k
    return out


def _split(rng: np.random.Generator, here: int, rest: int, taken: int) -> int:
    """How many of ``taken`` fall on ``here`` places, by inversion around the mode (any size)."""
    from math import exp, lgamma
    low, high = max(0, taken - rest), min(here, taken)
    mode = min(high, max(low, (taken + 1) * (here + 1) // (here + rest + 2)))

    def logc(n, k):
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    p = exp(logc(here, mode) + logc(rest, taken - mode) - logc(here + rest, taken))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (here - up) * (taken - up) / ((up + 1) * (rest - taken + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (rest - taken + down) / ((here - down + 1) * (taken - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def matrix_row(starts: np.ndarray, part: int, free: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix; ``starts``: first row of each partition, then the total."""
    low, high = 0, len(starts) - 1
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = draw(rng, free, int(starts[mid] - starts[low]))
        low, high, free = (low, mid, left) if part < mid else (mid, high, free - left)
    return free


def uniform_shuffle(df: DataFrame, shards: int, seed: int = 17, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``df`` with shard (0 to shards-1) and slot (0 to the shard's size - 1), uniformly permuted.

    The rows are written once to the shared folder: counting and labelling
    must see the same rows in the same partitions, also after a lost executor.
    What reaches the driver is one number per input partition.
    """
    spark = df.sparkSession
    # a row is known by its writing task and its place there, however the files are split when read
    df = materialize(without(df, "shard", "slot").withColumn("__row", F.monotonically_increasing_id()), "shuffle-input")
    counted = df.groupBy(F.shiftright("__row", 33).alias("p")).count().collect()
    counts = np.zeros(max([r["p"] for r in counted], default=0) + 1, dtype=np.int64)
    for r in counted:
        counts[r["p"]] = r["count"]
    starts = np.concatenate([[0], np.cumsum(counts)])
    size, shard, first = bin_sizes(int(starts[-1]), shards, max(bin_rows, -(-int(starts[-1]) // MAX_BINS)))
    at = df.columns.index("__row")

    def labels_of(part):
        row = matrix_row(starts, part, size, seed)
        labels = np.repeat(np.arange(len(row), dtype=np.int32), row)
        np.random.Generator(np.random.PCG64([seed, part])).shuffle(labels)
        return labels

    def label(batches):
        part, labels = -1, None
        for batch in batches:
            rows = batch.column(at).to_numpy()
            own = np.empty(len(rows), dtype=np.int32)
            for p in np.unique(rows >> 33):
                if p != part:
                    part, labels = p, labels_of(int(p))
                here = rows >> 33 == p
                own[here] = labels[rows[here] & ((1 << 33) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "__bin"])

    schema = T.StructType([*df.schema.fields, T.StructField("__bin", T.IntegerType())])
    labelled = df.mapInArrow(label, schema).repartition("__bin")
    second = Window.partitionBy("__bin").orderBy(F.xxhash64(F.lit(seed), "__row"), "__row")
    bins = spark.createDataFrame([(int(i), int(s), int(f)) for i, (s, f) in enumerate(zip(shard, first))],
                                 "__bin int, shard int, __first long")
    out = labelled.withColumn("__n", F.row_number().over(second) - 1)
    out = out.join(F.broadcast(bins), "__bin").withColumn("slot", F.col("__first") + F.col("__n"))
    return out.drop("__bin", "__row", "__n", "__first")
