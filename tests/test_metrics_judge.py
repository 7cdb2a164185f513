"""Metrics and judging (E1-E12), hooks (U1, U2) and I/O round trips."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark import fixtures as FX
from prefspark.operators import hooks, judge, metrics
from prefspark.sources import io

from shared_paths import SF01


def _newton_logit(X, y, C=1.0, iters=100):
    n, d = X.shape
    Xb = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(d + 1)
    P = np.eye(d + 1) / C
    P[-1, -1] = 0.0  # intercept not penalised
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = Xb.T @ (p - y) + P @ w
        H = Xb.T @ (Xb * (p * (1 - p))[:, None]) + P
        step = np.linalg.solve(H, g)
        w -= step
        if np.max(np.abs(step)) < 1e-14:
            break
    return w


def test_lc_winrate_matches_newton(spark):
    judged = judge.judgments(FX.fx_judge(spark, SF01))
    row = judge.lc_winrate(judged).first()
    pdf = judge.length_features(judged).toPandas()
    X = pdf[["length_diff", "length_diff_sq", "log_model_len", "log_ref_len"]].to_numpy(float)
    y = pdf["model_win"].to_numpy(float)
    w = _newton_logit(X, y)
    z = w[-1] + w[2] * X[:, 2].mean() + w[3] * X[:, 3].mean()
    assert row["n_examples"] == len(y) and row["n_wins"] == int(y.sum())
    assert abs(row["lc_winrate"] - 100 / (1 + np.exp(-z))) < 1e-6
    assert abs(row["raw_winrate"] - 100 * y.mean()) < 1e-9


def test_lc_winrate_one_class_raises(spark):
    judged = judge.judgments(FX.fx_judge(spark, SF01)).withColumn("model_win", F.lit(True))
    with pytest.raises(ValueError, match="both wins and losses"):
        judge.lc_winrate(judged)


def test_resume_twice_equals_once(spark):
    prompts = FX.fx_judge(spark, SF01)
    cache = FX.fx_judge_cache(spark, SF01).select(*judge.JUDGMENT_COLS)
    once = judge.resume_judging(prompts, cache)
    twice = judge.resume_judging(prompts, once)
    full = judge.judgments(prompts)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, full.collect()))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, full.collect()))


def test_math_null_equals_null_is_correct(spark):
    df = spark.createDataFrame([(1, "no number", "no gold"), (2, "The answer is 18.0", "#### 18")],
                               "idx long, generated string, answer string")
    got = {r["idx"]: r["correct"] for r in metrics.score_math(df).collect()}
    assert got == {1: True, 2: False}
    strict = {r["idx"]: r["correct"] for r in metrics.score_math(df, null_is_wrong=True).collect()}
    assert strict == {1: False, 2: False}


def test_math_summary_empty_gives_no_row(spark):
    empty = spark.createDataFrame([], "correct boolean")
    assert metrics.math_summary(empty).count() == 0
    assert metrics.math_accuracy(empty).first()["accuracy"] is None


def test_instruction_metrics_empty_is_zero(spark):
    empty = spark.createDataFrame([], "prompt_id long, inst_id long, strict boolean, loose boolean")
    assert tuple(metrics.instruction_metrics(empty).first()) == (0.0, 0.0, 0.0, 0.0)


def test_subject_macro_label_without_scores_is_null(spark):
    acc = spark.createDataFrame([("a", "mmlu_x", 0.5), ("a", "mmlu_y", None), ("b", "mmlu_y", None),
                                 ("a", "other", 1.0)], "label string, task string, acc double")
    got = {r["label"]: r["avg_acc"] for r in metrics.subject_macro_average(
        acc, ["mmlu_x", "mmlu_y"]).collect()}
    assert got == {"a": 50.0, "b": None}
    miss = sorted(tuple(r) for r in metrics.subject_missing(acc, ["mmlu_x", "mmlu_y"]).collect())
    assert miss == [("a", "mmlu_y", "y"), ("b", "mmlu_x", "x"), ("b", "mmlu_y", "y")]


def test_read_subject_results_reference_layout(spark, tmp_dir):
    for label, res in [("run_a", {"mmlu_x": {"acc,none": 0.25}, "mmlu_y": {"other": 1}}),
                       ("run_b", {"mmlu_x": {"acc,none": 0.75}})]:
        os.makedirs(f"{tmp_dir}/{label}")
        with open(f"{tmp_dir}/{label}/mmlu_results.json", "w") as f:
            json.dump({"results": res, "config": {"x": 1}}, f, indent=2)
    got = sorted(tuple(r) for r in io.read_subject_results(spark, tmp_dir).collect())
    assert got == [("run_a", "mmlu_x", 0.25), ("run_a", "mmlu_y", None), ("run_b", "mmlu_x", 0.75)]
    one = io.read_subject_results(spark, f"{tmp_dir}/run_b").collect()
    assert [tuple(r) for r in one] == [("run_b", "mmlu_x", 0.75)]


def test_read_math_results_single_document(spark, tmp_dir):
    doc = {"accuracy": 0.5, "correct": 1, "total": 2, "results": [
        {"question": "q1", "gold": "1", "prediction": "1", "correct": True, "generated_text": "1"},
        {"question": "q2", "gold": None, "prediction": "2", "correct": False, "generated_text": "2"}]}
    p = f"{tmp_dir}/r.json"
    with open(p, "w") as f:
        json.dump(doc, f, indent=2)
    rows = io.read_math_results(spark, p).collect()
    assert [r["correct"] for r in rows] == [True, False]


def test_scores_json_round_trip_keeps_unicode(spark, tmp_dir):
    df = spark.createDataFrame([(1, "é😀", None, "c", "c", float("nan"))], io.SCORED_SCHEMA)
    io.write_scores(df, f"{tmp_dir}/s")
    text = "".join(open(os.path.join(f"{tmp_dir}/s", f), encoding="utf-8").read()
                   for f in os.listdir(f"{tmp_dir}/s") if f.endswith(".json"))
    assert "é😀" in text
    back = io.read_scores(spark, f"{tmp_dir}/s").first()
    assert back["input"] == "" and back["score_datainf"] is None


def test_map_responses_batches(spark):
    df = spark.range(0, 10, 1, 2).select(F.col("id"), F.col("id").cast("string").alias("t"))
    sizes = []

    def fn(batch):
        sizes.append(len(batch))
        return [f"  {x}! " for x in batch]
    out = hooks.map_responses(df, fn, text_col="t", out_col="r", batch_size=3).collect()
    assert sorted(r["r"] for r in out) == sorted(f"{i}!" for i in range(10))

    def bad(batch):
        return batch[:-1]
    with pytest.raises(Exception, match="outputs"):
        hooks.map_responses(df, bad, text_col="t", out_col="r", batch_size=3).collect()


def test_map_verdicts_retries_then_null(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "flaky"), (3, "down")], "idx long, judge_prompt string")

    def fn(p):
        if p == "down":
            raise RuntimeError("x")
        if p == "flaky":
            fn.calls = getattr(fn, "calls", 0) + 1
            if fn.calls < 3:
                raise RuntimeError("y")
        return " 2 "
    got = {r["idx"]: r["verdict_raw"] for r in hooks.map_verdicts(df, fn, backoff=lambda a: 0.0).collect()}
    assert got == {1: "2", 2: "2", 3: None}


def test_registry_upsert(spark, tmp_dir):
    from prefspark.operators.upsert import upsert_by_key
    assert io.read_registry(spark, f"{tmp_dir}/missing").count() == 0
    with open(f"{tmp_dir}/bad.json", "w") as f:
        f.write('{"key": "x", "file_name": "x.json"}\n{not json\n{"key": "y", "file_name": "y.json"}\n')
    for layout in ("object", "lines"):
        with pytest.raises(ValueError):
            io.read_registry(spark, f"{tmp_dir}/bad.json", layout)
        assert io.read_registry(spark, f"{tmp_dir}/bad.json", layout, on_invalid="empty").count() == 0
    entry = {"file_name": "a.json", "ranking": True, "columns": dict(io.DPO_COLUMNS)}
    with open(f"{tmp_dir}/registry.json", "w") as f:
        json.dump({"a": entry, "b": {"file_name": "b.json"}}, f, indent=2)
    got = {r["key"]: r for r in io.read_registry(spark, f"{tmp_dir}/registry.json").collect()}
    assert got["a"]["columns"] == io.DPO_COLUMNS and got["a"]["ranking"] and got["b"]["file_name"] == "b.json"
    io.write_registry(io.read_registry(spark, f"{tmp_dir}/registry.json"), f"{tmp_dir}/lines")
    again = io.read_registry(spark, f"{tmp_dir}/lines", "lines")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))
    two = io.registry_entries(spark, {"z": "1"}).unionByName(io.registry_entries(spark, {"z": "2"}))
    assert [r["file_name"] for r in upsert_by_key(None, two, "key").collect()] == ["2"]
    old = io.registry_entries(spark, {"a": "a.json", "b": "b.json"})
    new = io.registry_entries(spark, {"b": "b2.json", "c": "c.json"})
    got = {r["key"]: r["file_name"] for r in upsert_by_key(old, new, "key").collect()}
    assert got == {"a": "a.json", "b": "b2.json", "c": "c.json"}


def test_map_verdicts_concurrent_keeps_order(spark):
    df = spark.range(50).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("judge_prompt"))
    got = {r["idx"]: r["verdict_raw"] for r in hooks.map_verdicts(
        df, lambda p: "1" if int(p) % 2 else "2", concurrency=4).collect()}
    assert got == {i: ("1" if i % 2 else "2") for i in range(50)}


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_read_preferences_round_trip(spark, tmp_dir, fmt):
    pref = FX.fx_pref(spark, SF01)
    pref.write.format(fmt).save(f"{tmp_dir}/p")
    back = io.read_preferences(spark, f"{tmp_dir}/p", fmt)
    assert sorted(map(str, back.collect())) == sorted(map(str, pref.collect()))


def test_nested_and_long_layouts_agree(spark):
    from prefspark.operators import records
    nested, long_ = FX.fx_pref(spark, SF01), FX.fx_pref_long(spark, SF01)
    for fn in (records.to_dpo_records, records.conversion_report):
        assert sorted(map(tuple, fn(nested).collect())) == sorted(map(tuple, fn(long_).collect()))
    s = spark.createDataFrame([(0, 1.5), (3, -2.0)], "id long, score double")
    a = records.attach_scores(nested, s).collect()
    b = records.attach_scores(long_, s).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_id_less_score_file(spark, tmp_dir):
    p = f"{tmp_dir}/scores.jsonl"
    with open(p, "w") as f:
        for i, s in enumerate([0.5, None, 2.0]):
            f.write(json.dumps({"instruction": f"q{i}", "input": "", "chosen": f"c{i}",
                                "rejected": f"c{i}", "score_datainf": s}) + "\n")
    df = io.read_scores(spark, p, assign_ids=True)
    assert {r["instruction"]: r["id"] for r in df.collect()} == {"q0": 0, "q1": 1, "q2": 2}
    from prefspark.operators.rank import rank_by_score
    ranked = {r["instruction"]: r["rank"] for r in rank_by_score(df).collect()}
    assert ranked == {"q2": 0, "q0": 1, "q1": 2}


def test_true_mass_extreme_log_likelihoods(spark):
    rows = [("s", 1, 1, -5000.0, True), ("s", 1, 2, -5001.0, False), ("s", 1, 3, -9000.0, True),
            ("s", 2, 4, 0.0, False), ("s", 2, 5, 0.0, True)]
    mc = spark.createDataFrame(rows, "subject string, qid long, choice long, ll double, is_true boolean")
    got = metrics.true_mass(mc).first()
    e = np.exp(-1.0)
    assert got["n_questions"] == 2
    assert abs(got["mc2"] - ((1 / (1 + e)) + 0.5) / 2) < 1e-12
