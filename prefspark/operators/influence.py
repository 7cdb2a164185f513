"""Influence scoring from per-row gradients.

score(g) = (g.v) / (lambda + |g|^2), the first-order Woodbury form of
g . H^-1 v with H ~ lambda*I + g g^T; algebraically equal to
g . (v - c g) / lambda with c = (g.v) / (lambda + |g|^2).

One scan of the training gradients gives, per row, g.v and |g|^2; this narrow
table is written, and both lambda (the mean of |g|^2) and the scores come from
it. v, the validation mean, is one broadcast row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark import constants as K
from prefspark.functions.text import preview
from prefspark.functions.vectors import dot, sq_norm
from prefspark.session import materialize


def _vector_mean(df: DataFrame, grad_col: str, by: str | None = None) -> DataFrame:
    """Element-wise mean of non-null arrays (optionally per ``by``) as ``v ARRAY<DOUBLE>``.

    ``Summarizer`` adds each row into one dimension-sized buffer per task
    (JVM-side) and merges the buffers: no row x dimension explosion, and the
    shuffle is one buffer per task (and group).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    g = df.filter(F.col(grad_col).isNotNull()).withColumn("_vec", array_to_vector(grad_col))
    agg = Summarizer.metrics("mean", "count").summary(F.col("_vec")).alias("_sm")
    out = (g.groupBy(by) if by else g).agg(agg)
    cols = [by] if by else []
    return out.select(*cols, vector_to_array(F.col("_sm.mean")).alias("v"),
                      F.col("_sm.count").alias("_n"))


def mean_vector(val: DataFrame, grad_col: str = "grad") -> DataFrame:
    """I1, long form: (pos, value) element-wise mean over rows that have a gradient."""
    return mean_vector_row(val, grad_col).select(F.posexplode("v").alias("pos", "value")) \
        .select(F.col("pos").cast("long").alias("pos"), "value")


def mean_vector_row(val: DataFrame, grad_col: str = "grad") -> DataFrame:
    """I1 as one row ``v ARRAY<DOUBLE>`` (dimension-sized, not data-sized); no gradient at all is an error when run."""
    mean = _vector_mean(val.withColumn("_all", F.lit(1)), grad_col, by="_all")  # no row at all without gradients
    one = val.sparkSession.range(1).join(mean, F.lit(True), "left")
    return one.select(_or_error("v", F.col("v").isNotNull(), "mean_vector: no gradients in validation set").alias("v"))


def _or_error(value, ok, message: str):
    """``value`` where ``ok`` holds, an error at run time elsewhere."""
    return F.when(ok, F.col(value)).otherwise(F.raise_error(F.lit(message)))


def damping(train: DataFrame, grad_col: str = "grad", divisor: float = K.DAMPING_DIVISOR) -> DataFrame:
    """One row ``lam`` = mean squared norm over rows with a gradient / divisor."""
    g = train.filter(F.col(grad_col).isNotNull())
    agg = g.agg(F.avg(sq_norm(grad_col)).alias("m"), F.count(F.lit(1)).alias("n"))
    return agg.select(
        F.when(F.col("n") == 0, F.raise_error(F.lit("damping: no gradients in training set")))
        .otherwise(F.col("m") / F.lit(float(divisor))).alias("lam"))


def influence_scores(train: DataFrame, val: DataFrame, id_col: str = "id", grad_col: str = "grad",
                     divisor: float = K.DAMPING_DIVISOR, max_broadcast_bytes: int = 512 * 2**20) -> DataFrame:
    """(id, score). Rows without a gradient score 0.0; lambda = 0 gives null.

    The mean vector is written once and travels as one broadcast row; above
    ``max_broadcast_bytes`` this raises: store such gradients in slices and use
    ``influence_scores_blocked``.
    """
    v = materialize(mean_vector_row(val, grad_col), "mean-vector")
    # v is one written row of dimension size: broadcast once per executor, if it is as small as that takes.
    width = v.select(F.size("v")).first()[0]
    if width * 8 > max_broadcast_bytes:
        raise ValueError("influence_scores: gradients are too wide to broadcast their mean; "
                         "store slices and use influence_scores_blocked")
    x = train.select(id_col, grad_col).crossJoin(F.broadcast(v))
    products = x.select(F.col(id_col), dot(F.col(grad_col), F.col("v")).alias("gv"), sq_norm(F.col(grad_col)).alias("gg"))
    return _scores_of(products, id_col, divisor, "damping: no gradients in training set")


def _scores_of(products: DataFrame, id_col: str, divisor: float, none: str) -> DataFrame:
    """(id, score) from (id, gv, gg), which is written once: the gradients are not read again for lambda."""
    narrow = materialize(products, "gradient-products")
    mean = narrow.agg((F.avg("gg") / F.lit(float(divisor))).alias("lam"), F.count("gg").alias("n"))
    lam = mean.select(_or_error("lam", F.col("n") > 0, none).alias("lam")).scalar()  # scalar subquery, evaluated once
    score = F.try_divide(F.col("gv"), lam + F.col("gg"))
    return narrow.select(F.col(id_col), F.when(F.col("gg").isNull(), F.lit(0.0)).otherwise(score).alias("score"))


def influence_scores_blocked(blocks: DataFrame, id_col: str = "id", split_col: str = "split",
                             block_col: str = "block_id", vals_col: str = "vals",
                             divisor: float = K.DAMPING_DIVISOR,
                             max_broadcast_bytes: int = 512 * 2**20, salts: int = 64) -> DataFrame:
    """I4: the I3 result for gradients stored as (id, split, block_id, vals) slices.

    g.v and |g|^2 add up over blocks, so no row ever holds the whole gradient.
    The validation mean is computed per block (one vector buffer per task and
    block), written once and broadcast to the training blocks when it fits
    ``max_broadcast_bytes`` (its size is the model dimension, not the data);
    above that the mean is copied ``salts`` times and the training blocks join
    on (block_id, salt), so a block's rows spread over that many tasks. No
    gradient at all in either split is an error. A training id whose only block
    row has null vals scores 0.0.
    """
    val = blocks.filter((F.col(split_col) == "val") & F.col(vals_col).isNotNull())
    train = blocks.filter(F.col(split_col) == "train")
    vmean = _vector_mean(val, vals_col, by=block_col).select(block_col, F.col("v").alias("vb"))
    # The mean has the model's dimension, whatever the number of rows: write it
    # once, measure it, and broadcast it below the limit so the gradient table
    # is never shuffled by block; above it the planner's join takes over.
    vmean = materialize(vmean, "mean-blocks")
    dim = vmean.agg(F.sum(F.size("vb"))).first()[0] or 0
    if not dim:
        raise ValueError("influence_scores_blocked: no gradients in validation set")
    keys = [block_col]
    if dim * 8 <= max_broadcast_bytes:
        vmean = F.broadcast(vmean)
    else:
        keys = [block_col, "_salt"]
        vmean = vmean.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        train = train.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    per_block = (train.join(vmean, keys, "left")
                 .select(id_col,
                         dot(vals_col, "vb").alias("gv"),
                         sq_norm(vals_col).alias("gg")))
    per_id = per_block.groupBy(id_col).agg(F.sum("gv").alias("gv"), F.sum("gg").alias("gg"))
    return _scores_of(per_id, id_col, divisor, "influence_scores_blocked: no gradients in training set")


def _k_extreme(scored: DataFrame, k: int, largest: bool, score_col: str, id_col: str,
               text_col: str | None) -> DataFrame:
    s = F.col(score_col)
    valid = scored.filter(s.isNotNull() & ~F.isnan(s))
    order = [s.desc() if largest else s.asc(), F.col(id_col).asc()]
    cols = [F.col(id_col), s.alias(score_col)]
    if text_col:
        cols.append(preview(text_col).alias("preview"))
    # orderBy + limit plans TakeOrderedAndProject: a k-row heap per partition.
    top = valid.orderBy(*order).limit(k)
    w = Window.orderBy(*order)  # over k rows only
    return top.select(*cols, (F.row_number().over(w)).cast("long").alias("position"))


def top_k_helpful(scored: DataFrame, k: int = K.TOP_K, score_col: str = "score_datainf",
                  id_col: str = "id", text_col: str | None = "instruction") -> DataFrame:
    """The k largest scores; the earlier id wins a tie."""
    return _k_extreme(scored, k, True, score_col, id_col, text_col)


def bottom_k_helpful(scored: DataFrame, k: int = K.TOP_K, score_col: str = "score_datainf",
                     id_col: str = "id", text_col: str | None = "instruction") -> DataFrame:
    """The k smallest scores; the earlier id wins a tie."""
    return _k_extreme(scored, k, False, score_col, id_col, text_col)
