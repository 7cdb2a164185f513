"""Evaluation metrics as aggregations."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark import constants as K
from prefspark.functions.extract import extract_gold, extract_number
from prefspark.functions.text import cut_at_stop, short_subject


def score_math(df: DataFrame, mode: str = "exact", null_is_wrong: bool = False,
               gen_col: str = "generated", answer_col: str = "answer") -> DataFrame:
    """Stop cut, extraction, string exact match (null = null is correct by default)."""
    clean = cut_at_stop(gen_col)
    x = df.withColumn("generated_text", clean) \
          .withColumn("prediction", extract_number("generated_text", mode)) \
          .withColumn("gold", extract_gold(answer_col, mode))
    eq = F.col("prediction").eqNullSafe(F.col("gold"))
    if null_is_wrong:
        eq = F.coalesce(F.col("prediction") == F.col("gold"), F.lit(False))
    return x.withColumn("correct", eq)


def math_accuracy(scored: DataFrame) -> DataFrame:
    """Correct, total and correct / total (null when there are no rows)."""
    a = scored.agg(F.count_if(F.col("correct")).alias("correct"),
                   F.count(F.lit(1)).alias("total"))
    return a.select("correct", "total",
                    F.try_divide(F.col("correct").cast("double"),
                                 F.col("total").cast("double")).alias("accuracy"))


def math_summary(scored: DataFrame) -> DataFrame:
    """From saved rows, only ``correct is True`` counts; no rows gives no result row."""
    a = scored.agg(F.count_if(F.col("correct").eqNullSafe(F.lit(True))).alias("correct"),
                   F.count(F.lit(1)).alias("total"))
    return a.filter(F.col("total") > 0).select(
        "correct", (F.col("total") - F.col("correct")).alias("incorrect"), "total",
        ((F.col("correct").cast("double") / F.col("total").cast("double")) * F.lit(100.0))
        .alias("accuracy_pct"))


def _subjects_df(spark, subjects: Iterable[str] | DataFrame) -> DataFrame:
    """Canonical subject list as (pos, task); a bounded list, broadcast where joined."""
    if isinstance(subjects, DataFrame):
        return subjects
    rows = [(i, s) for i, s in enumerate(subjects)]
    return spark.createDataFrame(rows, "pos long, task string")


def subject_macro_average(acc: DataFrame, subjects=K.MMLU_SUBJECTS) -> DataFrame:
    """Per label, unweighted mean of acc*100 over canonical subjects with a value.

    A label with no usable score gets a null average.
    """
    subj = _subjects_df(acc.sparkSession, subjects)
    usable = acc.join(F.broadcast(subj.select("task")), "task").filter(F.col("acc").isNotNull())
    per = usable.groupBy("label").agg(F.avg(F.col("acc") * F.lit(100.0)).alias("avg_acc"),
                                      F.count(F.lit(1)).alias("n_scored"))
    labels = acc.select("label").distinct()
    return labels.join(per, "label", "left").select(
        "label", "avg_acc", F.coalesce("n_scored", F.lit(0)).cast("long").alias("n_scored"))


def subject_missing(acc: DataFrame, subjects=K.MMLU_SUBJECTS) -> DataFrame:
    """Per label, the canonical subjects with no value (absent or null)."""
    subj = _subjects_df(acc.sparkSession, subjects)
    # The canonical list is bounded (a benchmark's subject names), so it is a literal array.
    names = ([r["task"] for r in subjects.orderBy("pos").collect()]
             if isinstance(subjects, DataFrame) else list(subjects))
    present = (acc.filter(F.col("acc").isNotNull())
               .join(F.broadcast(subj.select("task")), "task", "left_semi")
               .groupBy("label").agg(F.collect_set("task").alias("have")))
    labels = acc.select("label").distinct().join(present, "label", "left")
    canon = F.array(*[F.lit(s) for s in names])
    missing = F.array_except(canon, F.coalesce(F.col("have"), F.array().cast("array<string>")))
    return labels.select("label", F.explode(missing).alias("task")).select(
        "label", "task", short_subject("task").alias("subject"))


def subject_report(acc: DataFrame, subjects=K.MMLU_SUBJECTS) -> DataFrame:
    """Per label, each scored canonical subject with its position and acc*100 (joined by name)."""
    subj = _subjects_df(acc.sparkSession, subjects)
    j = acc.filter(F.col("acc").isNotNull()).join(F.broadcast(subj), "task")
    return j.select("label", "pos", short_subject("task").alias("subject"),
                    (F.col("acc") * F.lit(100.0)).alias("acc_pct"))


def compare_models(macro: DataFrame) -> DataFrame:
    """E5: labels best first (null averages last, ties by label) with a 1-based position.

    One row per evaluated model, so a plain window over it is fine.
    """
    w = Window.orderBy(F.col("avg_acc").desc_nulls_last(), F.col("label").asc())
    return macro.select("label", "avg_acc", F.row_number().over(w).cast("long").alias("position"))


def _undefined(ll: Column) -> Column:
    """A score that says nothing about the order or the share of a choice: null, NaN or +inf."""
    return ll.isNull() | F.isnan(ll) | (ll == F.lit(float("inf")))


def choice_accuracy(mc: DataFrame) -> DataFrame:
    """Per subject, share of questions whose highest-scored choice is the gold one.

    Ties on the score go to the smaller choice id. Both aggregates are
    partial (map-side), so a question with very many choices does not skew.
    A question with an undefined score (null, NaN, +inf) has no highest one:
    it is left out and counted in ``n_undefined``.
    """
    q = mc.groupBy("subject", "qid").agg(
        F.max_by("choice", F.struct(F.col("ll"), -F.col("choice"))).alias("pred"),
        F.first("gold").alias("gold"), F.max(_undefined(F.col("ll"))).alias("undefined"))
    hit = (F.col("pred") == F.col("gold")) & ~F.col("undefined")
    return q.groupBy("subject").agg(
        F.count_if(~F.col("undefined")).alias("n_questions"),
        F.try_divide(F.count_if(hit).cast("double"), F.count_if(~F.col("undefined")).cast("double")).alias("accuracy"),
        F.count_if("undefined").alias("n_undefined"))


_BAND = 500.0  # exp(x) for x in [0, 500) stays far inside the double range


def true_mass(mc: DataFrame) -> DataFrame:
    """Per subject, mean over questions of the normalised probability on true choices.

    Two levels of map-side aggregation, no row-level join: rows are summed
    per (question, band of ll) as exp(ll - band), which lies in [1, e^500);
    the few band rows of each question are then re-based to its top band.
    A question with a third of all rows is combined like any other. A question
    whose scores are all -inf has no distribution and is left out of the mean;
    one with an undefined score (null, NaN, +inf) is left out of mean and
    number and counted in ``n_undefined``: the sums carry the number of
    undefined scores, which adds up like they do.
    """
    undefined = _undefined(F.col("ll"))
    band = F.when(~undefined, F.floor(F.col("ll") / F.lit(_BAND)) * F.lit(_BAND))
    e = F.when(~undefined, F.exp(F.col("ll") - F.col("_b")))
    banded = (mc.withColumn("_b", band)
              .groupBy("subject", "qid", "_b")
              .agg(F.sum(F.when(F.col("is_true"), e).otherwise(F.lit(0.0))).alias("_t"),
                   F.sum(e).alias("_z"), F.count_if(undefined).alias("_u")))
    top = banded.groupBy("subject", "qid").agg(F.max("_b").alias("_m"))
    scale = F.exp(F.col("_b") - F.col("_m"))
    q = (banded.join(top, ["subject", "qid"])
         .groupBy("subject", "qid")
         .agg(F.sum(F.col("_t") * scale).alias("_t"), F.sum(F.col("_z") * scale).alias("_z"), F.sum("_u").alias("_u")))
    defined = F.col("_u") == 0
    return q.groupBy("subject").agg(
        F.count_if(defined).alias("n_questions"),
        F.avg(F.when(defined, F.try_divide("_t", "_z"))).alias("mc2"),
        F.count_if(~defined).alias("n_undefined"))


def instruction_metrics(inst: DataFrame) -> DataFrame:
    """Prompt- and instruction-level accuracy, strict and loose, x100; empty -> 0.0."""
    p = inst.groupBy("prompt_id").agg(
        F.bool_and("strict").alias("ps"), F.bool_and("loose").alias("pl"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("strict").alias("is_"), F.count_if("loose").alias("il"))
    a = p.agg(F.count(F.lit(1)).alias("np"), F.count_if("ps").alias("nps"),
              F.count_if("pl").alias("npl"), F.sum("n").alias("ni"),
              F.sum("is_").alias("nis"), F.sum("il").alias("nil"))

    def pct(num, den):
        return F.coalesce(F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))
                          * F.lit(100.0), F.lit(0.0))
    return a.select(pct("nps", "np").alias("prompt_level_strict_acc"),
                    pct("npl", "np").alias("prompt_level_loose_acc"),
                    pct("nis", "ni").alias("inst_level_strict_acc"),
                    pct("nil", "ni").alias("inst_level_loose_acc"))
