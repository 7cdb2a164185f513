"""Flow C: generated answers -> exact-match scores; subject results -> model comparison."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from prefspark import constants as K
from prefspark.functions.text import render_fewshot_prompt
from prefspark.operators import hooks, metrics
from prefspark.sources import io

RESULT_COLS = ["idx", "question", "gold", "prediction", "correct", "generated_text"]


def generate_answers(questions: DataFrame, make_fn: Callable[[], Callable[[list], list]],
                     batch_size: int = 8) -> DataFrame:
    """U1 over the few-shot prompt of each (idx, question, answer) row -> adds ``generated``."""
    prompted = questions.withColumn("prompt", render_fewshot_prompt("question"))
    out = hooks.map_responses(prompted, make_fn=make_fn, text_col="prompt",
                              out_col="generated", batch_size=batch_size)
    return out.drop("prompt")


def score_and_write(answers: DataFrame, path: str, mode: str = "exact") -> DataFrame:
    """E1 per row, written once with E2 metrics derived from the written rows."""
    scored = metrics.score_math(answers, mode).select(*RESULT_COLS)
    io.write_metrics(metrics.math_accuracy, scored, path)
    return answers.sparkSession.read.parquet(f"{path.rstrip('/')}/metrics")


def compare_subject_runs(spark: SparkSession, path: str, subjects=K.MMLU_SUBJECTS,
                         layout: str = "documents") -> DataFrame:
    """S7 -> E4 -> E5: every run under ``path`` with its macro average, best first."""
    acc = io.read_subject_results(spark, path, layout=layout)
    return metrics.compare_models(metrics.subject_macro_average(acc, subjects)).orderBy("position")
