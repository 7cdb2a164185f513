"""End-to-end flows B and C with deterministic stand-ins for the model and the judge."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prefspark import fixtures as FX
from prefspark.operators import judge
from prefspark.plans import evaluation, winrate

from shared_paths import SF001


def test_winrate_flow_resumes_and_reports(spark):
    j = FX.fx_judge(spark, SF001)
    prompts = j.select("idx", "instruction", F.col("reference_output").alias("output"))
    outputs = j.select("idx", "model_output")
    calls = spark.sparkContext.accumulator(0)

    def judge_fn(prompt):
        calls.add(1)
        return "1" if len(prompt) % 3 else "2"
    first = winrate.judged_rows(prompts, outputs, judge_fn, backoff=lambda a: 0.0)
    n = first.count()
    assert n == j.count() and calls.value == n
    again = winrate.judged_rows(prompts, outputs, judge_fn, cache=first, backoff=lambda a: 0.0)
    assert again.count() == n and calls.value == n  # nothing re-judged
    report = winrate.winrate_report(again).first()
    assert report["n_examples"] == n and 0 <= report["lc_winrate"] <= 100
    assert set(first.columns) == set(judge.JUDGMENT_COLS)


def test_math_flow(spark, tmp_dir):
    q = FX.fx_math(spark, SF001).select("idx", "question", "answer")

    def make_fn():
        return lambda prompts: ["The answer is 3." for _ in prompts]
    answers = evaluation.generate_answers(q, make_fn, batch_size=8)
    m = evaluation.score_and_write(answers, f"{tmp_dir}/m").first()
    gold3 = q.filter(F.col("answer").endswith("#### 3")).count()
    assert (m["correct"], m["total"]) == (gold3, q.count())


def test_subject_flow(spark, tmp_dir):
    for label, acc in [("b", 0.5), ("a", 0.75)]:
        os.makedirs(f"{tmp_dir}/{label}")
        with open(f"{tmp_dir}/{label}/mmlu_results.json", "w") as f:
            json.dump({"results": {"mmlu_anatomy": {"acc,none": acc}}}, f)
    rows = evaluation.compare_subject_runs(spark, tmp_dir).collect()
    assert [(r["label"], r["position"]) for r in rows] == [("a", 1), ("b", 2)]


def test_judging_goes_on_after_a_crash(spark, tmp_dir):
    prompts = spark.createDataFrame([(i, f"q{i}", "ref") for i in range(40)], "idx long, instruction string, output string")
    outputs = spark.createDataFrame([(i, f"answer {i}") for i in range(40)], "idx long, model_output string")

    def judge_at(log, crash):
        def fn(prompt):
            with open(f"{tmp_dir}/{log}", "a") as f:
                f.write(f"{prompt.count('q')}\n")
            if crash and "q23" in prompt:
                raise SystemExit("ends the task: not one of the failures that a judge call retries")
            return "1"
        return fn

    args = {"backoff": lambda a: 0.0, "cache_path": f"{tmp_dir}/cache", "slice_rows": 8}
    with pytest.raises(Exception):
        winrate.judged_rows(prompts, outputs, judge_at("first", True), **args)
    kept = 0
    if os.path.exists(f"{tmp_dir}/cache"):
        kept = spark.read.schema("idx long").option("recursiveFileLookup", True).parquet(f"{tmp_dir}/cache").count()
    done = winrate.judged_rows(prompts, outputs, judge_at("second", False), **args)
    assert sorted(r["idx"] for r in done.collect()) == list(range(40))
    with open(f"{tmp_dir}/second") as f:
        assert len(f.readlines()) == 40 - kept
    again = winrate.judged_rows(prompts, outputs, judge_at("third", True), **args)
    assert again.count() == 40 and not os.path.exists(f"{tmp_dir}/third")


def test_pending_rows_are_laid_out_once(spark, tmp_dir):
    """Slices are disjoint folders of bounded size: every pending row is read by one slice."""
    pending = spark.range(0, 1000, numPartitions=3).select(F.col("id").alias("idx"), F.lit("q").alias("instruction"))
    paths = winrate.work_queue(pending, f"{tmp_dir}/queue", 100)
    parts = [spark.read.schema(pending.schema).parquet(p) for p in paths]
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 1000 and max(sizes) <= 100 and len(paths) == 12
    files = [f for p in parts for f in p.inputFiles()]
    assert len(files) == len(set(files)) == 12
    assert winrate.work_queue(pending.where("idx < 0"), f"{tmp_dir}/none", 100) == []


def test_slices_read_pending_rows_once(tmp_dir):
    """Spark's event log of a session of its own: rows read by all slices are the pending rows, whatever their number."""
    code = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_dir}/ck")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{tmp_dir}")
         .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false").getOrCreate())
from prefspark.plans import winrate
p = spark.range(600).selectExpr("id idx", "'q' instruction", "'r' output")
m = spark.range(600).selectExpr("id idx", "'a' model_output")
winrate.judged_rows(p, m, lambda _: "1", cache_path="{tmp_dir}/cache", slice_rows=20, at_once=4)
spark.stop()
"""
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=root, env=os.environ | {"PYTHONPATH": root})
    log = next(f for f in os.listdir(tmp_dir) if f.startswith("local-"))
    events = [json.loads(line) for line in open(f"{tmp_dir}/{log}")]
    ends = [e for e in events if e["Event"] == "SparkListenerTaskEnd"]
    read = sum(e["Task Metrics"]["Input Metrics"]["Records Read"] for e in ends if e["Task Metrics"]["Input Metrics"]["Bytes Read"])
    assert read <= 2 * 600
    # some slices ran side by side
    spans = sorted((e["Task Info"]["Launch Time"], e["Task Info"]["Finish Time"]) for e in ends)
    assert any(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_a_failed_slice_stops_the_rest():
    ran = []

    def job(k):
        if k == 2:
            raise ValueError("slice 2")
        ran.append(k)

    with pytest.raises(ValueError, match="slice 2"):
        winrate.run_at_once([lambda k=k: job(k) for k in range(50)], 1)
    assert ran[:2] == [0, 1] and len(ran) < 50


def test_a_cluster_without_a_shared_folder_is_refused():
    from prefspark.session import _is_local
    assert _is_local("local") and _is_local("local[8]") and not _is_local("local-cluster[3,2,1024]") and not _is_local("yarn")
