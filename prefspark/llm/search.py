"""Exact top-k search by inner product, with a pivot table.

The distances of every row to a fixed number of pivots are computed once and
kept with the row.  For a query q the triangle inequality then bounds the
distance to a row x from below by max over pivots |d(q,p) - d(x,p)|, and with
it the inner product (|q|^2 + |x|^2 - d^2) / 2 from above.  Candidates are
evaluated in the order of that bound until the next bound is under the k-th
best score so far; the scores of the pivots, which are rows themselves, give
the first value of that k-th score.  Bounds are computed in floating point and
widened by a slack, scores are exact integers, so the result is exact.

Rows and queries are cut into blocks of bounded size and every block of
queries meets every block of rows; each meeting gives k rows a query, of which
a window takes the k best.

Defined cases: a component x counts as floor(256 * x); vectors that are null,
or hold a null or non-finite component, take no part; shorter vectors count as
padded with zeros; empty vectors have score 0 with every row.  A row is not
its own candidate, but a row that repeats it is.  Ties go to the smaller id,
null last; fewer candidates than k are all returned.  Scores beyond 64 bits
are cut to the ends of that range.  Bounds of very large vectors are computed
on vectors divided by a power of two, so that no square overflows.  Other
columns take no part.  Pivots are chosen among ``PIVOT_SAMPLE`` rows (smallest
hashes), each farthest from those before.
"""

from __future__ import annotations

from math import frexp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.session import materialize

PIVOTS, PIVOT_SAMPLE = 32, 1_000
ROW_BLOCK, QUERY_BLOCK = 8_192, 1_024
SCALE = 256
LARGEST = 400  # power of two that components stay below where squares are taken
BROADCAST_BYTES = 64 << 20  # of query blocks
LOWEST, HIGHEST = -2 ** 63, 2 ** 63 - 1
BLOCK = "block int, n int, uids binary, ids binary, matrix binary, dist binary"
HIT = "quid long, query_id long, uid long, vec_id long, score long"
EXACT = 2.0 ** 52
NULL_ID = 2 ** 63 - 1  # stands for a null id inside blocks, so that it sorts last


def quantised(vectors, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x) / SCALE, which never overflows, padded with zeros to ``dim``."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    small = np.abs(out) < EXACT  # the others are whole numbers already
    out[small] = np.floor(SCALE * out[small]) / SCALE
    return out


def whole(y: float) -> int:
    """SCALE * y of a quantised component."""
    return int(y * SCALE) if abs(y) < EXACT else int(y) * SCALE


def shrink(largest: float) -> float:
    """The power of two that brings components of up to ``largest`` below 2 ** LARGEST; 1 for all usual vectors."""
    return 2.0 ** min(0, LARGEST - frexp(largest)[1])


def scaled(score: int, unit: float) -> float:
    """A score on the scale of the bounds; one that was cut at the low end excludes nothing."""
    return -np.inf if score == LOWEST else float(score) / SCALE ** 2 * unit * unit


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((rows - p) ** 2).sum(axis=1) for p in pivots], axis=1)) if len(pivots) \
        else np.zeros((len(rows), 0))


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Indices of up to ``count`` rows, each farthest from those before."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while they are exact there, else in Python's whole numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        exact = np.abs(rows).max(initial=0) * np.abs(query).sum() * SCALE ** 2 < EXACT
    if exact:
        return (rows @ query * SCALE ** 2).astype(np.int64)
    q = [whole(b) for b in query]
    big = [sum(whole(a) * b for a, b in zip(r, q)) for r in rows]
    return np.array([min(max(s, LOWEST), HIGHEST) for s in big], dtype=np.int64)


def top(order_ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best scores, ties to the smaller id (null ids come as the largest)."""
    return np.lexsort((order_ids, -scores.astype(object) if scores.size and scores.min() == LOWEST else -scores))[:k]


def search_block(q: np.ndarray, q_uid: int, q_dist: np.ndarray, x: np.ndarray, x_uid: np.ndarray, x_id: np.ndarray,
                 x_dist: np.ndarray, x_sq: np.ndarray, k: int, floor_score: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """(indices, scores) of the k best rows of a block for one query that can reach ``floor_score``.

    Distances and ``x_sq`` are those of vectors multiplied by ``unit``.
    """
    q_sq = float((q * unit) @ (q * unit))
    bound = np.zeros(len(x))
    for p in range(x_dist.shape[1]):
        np.maximum(bound, np.abs(x_dist[:, p] - q_dist[p]), out=bound)
    least = np.maximum(bound - 1e-7 * (np.sqrt(q_sq) + np.sqrt(x_sq) + x_dist.max(axis=1, initial=0)), 0)
    upper = (q_sq + x_sq - least * least) / 2 + 1e-9 * (q_sq + x_sq) + 1e-6
    open_ = np.flatnonzero((upper >= scaled(floor_score, unit)) & (x_uid != q_uid))
    order = open_[np.argsort(-upper[open_], kind="stable")]
    best, scores, done, step = order[:0], np.zeros(0, dtype=np.int64), 0, 64
    while done < len(order):
        if len(scores) == k and upper[order[done]] < scaled(int(scores[-1]), unit):
            break  # exact stop: no later bound is higher
        part = order[done:done + step]
        best, scores = np.concatenate([best, part]), np.concatenate([scores, exact_scores(x[part], q)])
        keep = top(x_id[best], scores, k)
        best, scores, done, step = best[keep], scores[keep], done + len(part), step * 2
    return best, scores


def _blocks(df: DataFrame, size: int, rows: int, dim: int, pivots: np.ndarray, unit: float) -> DataFrame:
    """One row per block of about ``size`` vectors: ids, quantised vectors and their pivot distances."""
    count = max(1, -(-rows // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = quantised(pdf["vec"].tolist(), dim)
        ids = pdf["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "n": [len(pdf)],
                             "uids": [pdf["uid"].to_numpy(np.int64).tobytes()], "ids": [ids.tobytes()],
                             "matrix": [m.tobytes()], "dist": [distances(m * unit, pivots * unit).tobytes()]})

    keyed = df.withColumn("vec_id", F.coalesce("vec_id", F.lit(NULL_ID))).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int"))
    return keyed.groupBy("block").applyInPandas(pack, BLOCK)


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for every row where ``is_query`` (on vec_id) holds."""
    spark = vectors.sparkSession
    finite = F.col("vec").isNotNull() & F.forall(
        "vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = materialize(rows.where(finite).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(is_query(F.col("vec_id")))
    longest, largest = F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda c: F.abs(c))))
    n, dim, largest = rows.agg(F.count("*"), F.coalesce(longest, F.lit(0)), F.coalesce(largest, F.lit(0.0))).first()
    unit = shrink(largest)
    nq = asked.count()
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(PIVOT_SAMPLE).collect()  # bounded by PIVOT_SAMPLE
    sampled = quantised([r["vec"] for r in sample], dim)
    chosen = choose_pivots(sampled * unit, pivots)
    pivot_rows = sampled[chosen]
    pivot_uids = np.array([sample[i]["uid"] for i in chosen], dtype=np.int64)

    data = _blocks(rows, ROW_BLOCK, n, dim, pivot_rows, unit)
    ask = materialize(_blocks(asked, QUERY_BLOCK, nq, dim, pivot_rows, unit), "query-blocks")
    ask = ask.select(*[F.col(c).alias(f"q_{c}") for c in ask.columns])
    if nq * 8 * (dim + max(1, len(pivot_rows)) + 2) <= BROADCAST_BYTES:
        ask = F.broadcast(ask)
    pairs = data.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-nq // QUERY_BLOCK)) - 1)))).join(
        ask, "q_block")

    def meet(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                def table(side, width, r=r):
                    return np.frombuffer(getattr(r, side)).reshape(-1, width)

                x, x_dist = table("matrix", dim) if dim else np.zeros((r.n, 0)), table("dist", max(1, len(pivot_rows)))
                q, q_dist = table("q_matrix", dim) if dim else np.zeros((r.q_n, 0)), table("q_dist", max(1, len(pivot_rows)))
                ids = [np.frombuffer(b, dtype=np.int64) for b in (r.uids, r.ids, r.q_uids, r.q_ids)]
                x_uid, x_id, q_uid, q_id = ids
                x_sq, out = ((x * unit) ** 2).sum(axis=1), []
                for i in range(len(q)):
                    others = exact_scores(pivot_rows[pivot_uids != q_uid[i]], q[i])
                    least = int(np.sort(others)[-k]) if len(others) >= k else LOWEST
                    at, score = search_block(q[i], q_uid[i], q_dist[i], x, x_uid, x_id, x_dist, x_sq, k, least, unit)
                    out.append(pd.DataFrame({"quid": q_uid[i], "query_id": q_id[i], "uid": x_uid[at],
                                             "vec_id": x_id[at], "score": score}))
                yield pd.concat(out) if out else pd.DataFrame(columns=["quid", "query_id", "uid", "vec_id", "score"])

    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    hits = pairs.mapInPandas(meet, HIT).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"),
                       F.nullif("vec_id", F.lit(NULL_ID)).alias("vec_id"), "score")
