"""Pairwise judging: positions, verdicts, length features and win rates."""

from __future__ import annotations

import math
from typing import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark import constants as K
from prefspark.functions.extract import parse_verdict
from prefspark.functions.text import render_judge_prompt
from prefspark.session import materialize

JUDGMENT_COLS = ["idx", "instruction", "model_output", "reference_output", "winner",
                 "model_win", "model_len", "ref_len", "length_diff"]


def assign_positions(df: DataFrame, idx_col: str = "idx", model_col: str = "model_output",
                     ref_col: str = "reference_output") -> DataFrame:
    """Even idx shows the model first, odd idx shows the reference first."""
    m1 = (F.col(idx_col) % 2) == 0
    return df.withColumn("model_is_1", m1) \
        .withColumn("output_1", F.when(m1, F.col(model_col)).otherwise(F.col(ref_col))) \
        .withColumn("output_2", F.when(m1, F.col(ref_col)).otherwise(F.col(model_col)))


def judge_prompts(df: DataFrame) -> DataFrame:
    """P13 + P8: the text sent to the judge for each row."""
    p = assign_positions(df)
    return p.withColumn("judge_prompt",
                        render_judge_prompt("instruction", "output_1", "output_2"))


def resolve_win(df: DataFrame, winner_col: str = "winner") -> DataFrame:
    """The model wins when the judge picked the slot the model was shown in."""
    w = F.col(winner_col)
    return df.withColumn("model_win", F.when(F.col("model_is_1"), w == 1).otherwise(w == 2))


def length_features(df: DataFrame, model_col: str = "model_output",
                    ref_col: str = "reference_output") -> DataFrame:
    """Lengths in code points, their difference, its square and log1p of both."""
    ml = F.length(F.col(model_col)).cast("long")
    rl = F.length(F.col(ref_col)).cast("long")
    return (df.withColumn("model_len", ml).withColumn("ref_len", rl)
            .withColumn("length_diff", F.col("model_len") - F.col("ref_len"))
            .withColumn("length_diff_sq", F.col("length_diff").cast("double") * F.col("length_diff").cast("double"))
            .withColumn("log_model_len", F.log1p(F.col("model_len").cast("double")))
            .withColumn("log_ref_len", F.log1p(F.col("ref_len").cast("double"))))


def judge_rows(df: DataFrame, verdict_col: str = "verdict_raw") -> DataFrame:
    """Every prompt row with its parsed verdict (null when unparsable or missing).

    Input: idx, instruction, model_output, reference_output (null reads as
    ""), and the judge's raw answer.
    """
    x = df.withColumn("reference_output", F.coalesce(F.col("reference_output"), F.lit(""))) \
          .withColumn("model_output", F.coalesce(F.col("model_output"), F.lit("")))
    x = assign_positions(x)
    x = x.withColumn("winner", parse_verdict(verdict_col))
    x = resolve_win(x)
    return length_features(x)


def judgments(df: DataFrame, verdict_col: str = "verdict_raw") -> DataFrame:
    """Rows with a usable verdict, in the judgment-record shape."""
    return judge_rows(df, verdict_col).filter(F.col("winner").isNotNull()).select(*JUDGMENT_COLS)


def judging_report(df: DataFrame, verdict_col: str = "verdict_raw") -> DataFrame:
    """Judged, unparsable and no-verdict counts."""
    w = parse_verdict(verdict_col)
    raw = F.col(verdict_col)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(w.isNotNull()).alias("judged"),
        F.count_if(raw.isNotNull() & w.isNull()).alias("unparsable"),
        F.count_if(raw.isNull()).alias("no_verdict"))


def raw_winrate(judged: DataFrame) -> DataFrame:
    """n_examples, n_wins and (wins / judged) * 100 over judged rows."""
    a = judged.agg(F.count(F.lit(1)).alias("n_examples"),
                   F.count_if(F.col("model_win")).alias("n_wins"))
    return a.select("n_examples", "n_wins",
                    (F.try_divide(F.col("n_wins").cast("double"), F.col("n_examples").cast("double"))
                     * F.lit(100.0)).alias("raw_winrate"))


def fit_penalised_logit(data: DataFrame, feats: list[str], reg_c: float = 1.0,
                        max_iter: int = 1000, tol: float = 1e-15) -> tuple[list[float], float]:
    """L2-penalised logistic fit (penalty |w|^2 / (2C) on raw coefficients, intercept free) of ``label``.

    Spark ML's logistic regression averages the loss, so its penalty is
    1 / (C n); it scales the features internally. Raises when the iterations
    run out.
    """
    n = data.count()
    x = VectorAssembler(inputCols=feats, outputCol="features").transform(data)
    fit = LogisticRegression(regParam=1.0 / (reg_c * n), elasticNetParam=0.0, standardization=False, tol=tol,
                             maxIter=max_iter, family="binomial").fit(x)
    if fit.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the logistic fit did not converge in {max_iter} iterations")
    return [float(c) for c in fit.coefficients], float(fit.intercept)


def lc_winrate(judged: DataFrame, reg_c: float = 1.0, max_iter: int = 1000) -> DataFrame:
    """Length-controlled win rate from an L2 logistic fit (C = ``reg_c``).

    Fits win ~ length_diff + length_diff^2 + log1p(model_len) +
    log1p(ref_len) with the library-default penalty (L2 on the raw
    coefficients, inverse strength C = 1, intercept unpenalised) and returns
    the mean predicted probability with both difference terms at 0 and both
    logs at their means; all those rows are identical, so it is one sigmoid.
    One-class data raises, as a logistic fit must.
    """
    feats = length_features(judged) if "log_model_len" not in judged.columns else judged
    # written once: a lost executor cannot bring the fit other rows than the counts
    data = materialize(feats.select(
        F.col("model_win").cast("double").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in K.LENGTH_FEATURES]), "length-features")
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("wins"),
                     F.avg("log_model_len").alias("mlm"),
                     F.avg("log_ref_len").alias("mlr")).first()
    n, wins = int(stats["n"]), int(stats["wins"] or 0)
    if n == 0 or wins in (0, n):
        raise ValueError(f"lc_winrate needs both wins and losses (n={n}, wins={wins})")
    coefs, b0 = fit_penalised_logit(data, K.LENGTH_FEATURES, reg_c, max_iter)
    z = b0 + coefs[2] * float(stats["mlm"]) + coefs[3] * float(stats["mlr"])
    lc = 100.0 / (1.0 + math.exp(-z)) if z >= 0 else 100.0 * math.exp(z) / (1.0 + math.exp(z))
    names = K.LENGTH_FEATURES + ["intercept"]
    return judged.sparkSession.createDataFrame(
        [((wins / n) * 100.0, lc, n, wins, dict(zip(names, coefs + [b0])))],
        "raw_winrate double, lc_winrate double, n_examples long, n_wins long, "
        "glm_coefs map<string,double>")


def resume_judging(prompts: DataFrame, cache: DataFrame,
                   judge: Callable[[DataFrame], DataFrame] | None = None,
                   key: str = "idx") -> DataFrame:
    """Reuse cached judgments by key; only the rest are judged.

    ``judge`` maps pending prompt rows to judgment rows (by default the
    ``verdict_raw`` column already on the prompts is parsed). Failed rows are
    not cached, so they are pending again next time. Result: cache rows for
    current prompts plus new judgments, in the judgment-record shape.
    """
    judge = judge or judgments
    pending = prompts.join(cache.select(key), key, "left_anti")
    fresh = judge(pending).select(*JUDGMENT_COLS)
    kept = cache.join(prompts.select(key), key, "left_semi").select(*JUDGMENT_COLS)
    return kept.unionByName(fresh)
