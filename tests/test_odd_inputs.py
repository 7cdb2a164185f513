"""Inputs that are not clean: broken files, repeated ids, undefined scores, runs that break off."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.operators import influence, metrics, pairs
from prefspark.plans import evaluation
from prefspark.sources import io


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _failure(df):
    with pytest.raises(Exception) as e:
        df.collect()
    return str(e.value)


# --- S7 / E4 / E5 ------------------------------------------------------------

def test_labels_are_spelt_as_on_disk(spark, tmp_dir):
    for label in ("good one", "50%", "a+b", "é=1"):
        _write(f"{tmp_dir}/{label}/mmlu_results.json", json.dumps({"results": {"t": {"acc,none": 0.5, "alias": "x"}}}))
    got = {r["label"]: r["acc"] for r in io.read_subject_results(spark, tmp_dir).collect()}
    assert got == {"good one": 0.5, "50%": 0.5, "a+b": 0.5, "é=1": 0.5}


def test_empty_documents_keep_their_label(spark, tmp_dir):
    _write(f"{tmp_dir}/full/mmlu_results.json", json.dumps({"results": {"mmlu_anatomy": {"acc,none": 0.25}, "n": {"acc,none": "N/A"}}}))
    _write(f"{tmp_dir}/empty/mmlu_results.json", '{"results": {}}')
    _write(f"{tmp_dir}/none/mmlu_results.json", '{"config": 1}')
    acc = io.read_subject_results(spark, tmp_dir)
    assert {r["label"]: r["avg_acc"] for r in metrics.subject_macro_average(acc).collect()} == {"full": 25.0, "empty": None, "none": None}
    rows = evaluation.compare_subject_runs(spark, tmp_dir).collect()
    assert [(r["label"], r["position"]) for r in rows] == [("full", 1), ("empty", 2), ("none", 3)]
    missing = metrics.subject_missing(acc, ["mmlu_anatomy"]).collect()
    assert sorted(r["label"] for r in missing) == ["empty", "none"]


def test_empty_files_raise_with_their_path(spark, tmp_dir):
    _write(f"{tmp_dir}/fine/mmlu_results.json", '{"results": {"t": {"acc,none": 1}}}')
    _write(f"{tmp_dir}/the empty one/mmlu_results.json", "")
    with pytest.raises(ValueError, match="the empty one/mmlu_results.json"):
        io.read_subject_results(spark, tmp_dir)


@pytest.mark.parametrize("text", ["{\"results\": {", " ", "[1]", "not json", '{"results": 5}'])
def test_broken_documents_raise_with_their_path(spark, tmp_dir, text):
    _write(f"{tmp_dir}/fine/mmlu_results.json", '{"results": {"t": {"acc,none": 1}}}')
    _write(f"{tmp_dir}/the broken one/mmlu_results.json", text)
    acc = io.read_subject_results(spark, tmp_dir)
    assert "the broken one/mmlu_results.json" in _failure(acc)
    assert "the broken one" in _failure(acc.select("task"))  # whatever is read of it


# --- S1 / S3 / S9 ------------------------------------------------------------

GOOD = '{"id": 1, "instruction": "i", "input": "", "chosen": "c", "rejected": "r", "score_datainf": 0.5}'


@pytest.mark.parametrize("bad", ["{broken", '{"id": "x"}', "[1, 2]", "null", '"text"', GOOD[:-5]])
def test_broken_lines_raise(spark, tmp_dir, bad):
    p = _write(f"{tmp_dir}/s.jsonl", f"{GOOD}\n\n{bad}\n")
    message = _failure(io.read_scores(spark, p))
    assert "s.jsonl" in message and bad[:10] in message
    assert "s.jsonl" in _failure(io.read_scores(spark, p).select("chosen").groupBy().count())


def test_broken_lines_can_be_put_aside(spark, tmp_dir):
    p = _write(f"{tmp_dir}/s/a.jsonl", f"{GOOD}\n{{broken\n[]\n{{\"id\": 2}}\n")
    q = f"{tmp_dir}/aside"
    rows = io.read_scores(spark, f"{tmp_dir}/s", on_invalid="quarantine", quarantine=q).orderBy("id").collect()
    assert [(r["id"], r["chosen"], r["score_datainf"]) for r in rows] == [(1, "c", 0.5), (2, "", None)]
    aside = io.read_quarantine(spark, q).collect()
    assert [r["records"] for r in aside] == [2] and aside[0]["file"].endswith(os.path.basename(p))
    assert {r["record"] for r in spark.read.parquet(q).collect()} == {"{broken", "[]"}
    with pytest.raises(ValueError):
        io.read_scores(spark, p, on_invalid="quarantine")


def test_broken_prompts_and_preferences_raise(spark, tmp_dir):
    p = _write(f"{tmp_dir}/p.jsonl", '{"idx": 1, "instruction": "a"}\n{"idx": \n')
    assert "p.jsonl" in _failure(io.read_prompts(spark, p))
    p = _write(f"{tmp_dir}/q.jsonl", '{"id": 1, "prompt": "a", "chosen": [{"role": "user", "content": "x"}]}\n{"id": 2, "chosen": 5}\n')
    assert "q.jsonl" in _failure(io.read_preferences(spark, p, fmt="json"))


# --- S2 ----------------------------------------------------------------------

def test_large_limits_need_no_single_task(spark):
    df = spark.range(0, 50_000, numPartitions=5).select((F.col("id") * 7919 % 50_000).alias("id"), F.lit("x").alias("t"))
    out = io.limit_first(df, 20_001, heap_rows=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert sorted(r["id"] for r in out.collect()) == list(range(20_001)) and out.columns == ["id", "t"]
    assert io.limit_first(df, 10 ** 9, heap_rows=100).count() == 50_000
    names = spark.createDataFrame([(c,) for c in "dbca"] + [(None,)], "id string")
    assert {r["id"] for r in io.limit_first(names, 3, heap_rows=1).collect()} == {None, "a", "b"}


# --- S4 / S5 / S10 -----------------------------------------------------------

def _lines(path):
    return [json.loads(x) for f in os.listdir(path) if f.endswith(".json") for x in open(f"{path}/{f}", encoding="utf-8")]


def test_records_keep_null_keys(spark, tmp_dir):
    io.write_scores(spark.createDataFrame([(1, None)], "id long, score_datainf double"), f"{tmp_dir}/s")
    io.write_pairs(spark.createDataFrame([(1, None)], "rank long, input string"), f"{tmp_dir}/p")
    assert _lines(f"{tmp_dir}/s") == [{"id": 1, "score_datainf": None}] and _lines(f"{tmp_dir}/p") == [{"rank": 1, "input": None}]


def test_a_run_that_broke_off_is_run_again(spark, tmp_dir):
    rows = spark.createDataFrame([(1, "q", "1", "1", True, "t"), (2, "q", "1", "2", False, "t")], io.MATH_ROW_SCHEMA)
    path = f"{tmp_dir}/m"

    def breaks(_):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        io.write_metrics(breaks, rows, path)
    assert not io.is_complete(spark, path)
    with pytest.raises(ValueError, match="not ended"):
        io.read_math_results(spark, path)
    io.write_metrics(metrics.math_accuracy, rows, path)
    assert io.is_complete(spark, path) and io.read_math_results(spark, path).count() == 2
    assert spark.read.parquet(f"{path}/metrics").count() == 1
    with pytest.raises(Exception, match="(?i)already exists"):  # a complete one is not touched
        io.write_metrics(metrics.math_accuracy, rows, path)
    io.write_metrics(metrics.math_accuracy, rows.limit(1), path, mode="overwrite")
    assert io.is_complete(spark, path) and io.read_math_results(spark, path).count() == 1


# --- E6 / E7 -----------------------------------------------------------------

def test_undefined_scores_leave_their_question_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("s", 1, 1, -1.0, True, 1), ("s", 1, 2, -2.0, False, 1), ("s", 2, 1, nan, True, 1), ("s", 2, 2, -2.0, False, 1),
            ("s", 3, 1, None, True, 1), ("s", 3, 2, 0.0, False, 1), ("s", 4, 1, inf, True, 1), ("s", 4, 2, 0.0, False, 1),
            ("t", 5, 1, nan, True, 1), ("u", 6, 1, -inf, True, 1), ("u", 6, 2, -1.0, False, 1)]
    mc = spark.createDataFrame(rows, "subject string, qid long, choice long, ll double, is_true boolean, gold long")
    mass = {r["subject"]: r for r in metrics.true_mass(mc).collect()}
    assert (mass["s"]["n_questions"], mass["s"]["n_undefined"]) == (1, 3)
    assert abs(mass["s"]["mc2"] - 1 / (1 + np.exp(-1.0))) < 1e-12
    assert (mass["t"]["n_questions"], mass["t"]["n_undefined"], mass["t"]["mc2"]) == (0, 1, None)
    assert mass["u"]["mc2"] == 0.0
    right = {r["subject"]: tuple(r)[1:] for r in metrics.choice_accuracy(mc).collect()}
    assert right == {"s": (1, 1.0, 3), "t": (0, None, 1), "u": (1, 0.0, 0)}


# --- D2-D5 -------------------------------------------------------------------

SCORED = "id long, instruction string, input string, chosen string, score_datainf double"
REPEATED = [(1, "a", "", "A", 3.0), (1, "b", "", "B", 2.0), (2, "c", "", "C", 2.0), (None, "d", "", "D", None)]


@pytest.mark.parametrize("make", [pairs.symmetric_pairs, pairs.next_neighbor_pairs, pairs.pairs, pairs.self_pairs_random])
def test_repeated_and_null_ids(spark, make):
    """An error that names the id, or n pairs by position; before, repeated ids were joined with each other."""
    with pytest.raises(ValueError, match="id must be unique and not null: 1 occurs 2 times"):
        make(spark.createDataFrame(REPEATED[:3], SCORED)).collect()
    with pytest.raises(ValueError, match="None occurs 1 times"):
        make(spark.createDataFrame(REPEATED[2:], SCORED)).collect()
    rows = make(spark.createDataFrame(REPEATED, SCORED).coalesce(1), by_position=True).collect()
    each = [r for r in rows if "strategy" not in r or r["strategy"] == "symmetric"]
    assert sorted(r["chosen"] for r in each) == list("ABCD") and sorted(r["rejected"] for r in each) == list("ABCD")


def test_position_decides_ties_as_a_stable_sort_does(spark):
    rows = pairs.symmetric_pairs(spark.createDataFrame(REPEATED, SCORED).coalesce(1), by_position=True).orderBy("rank").collect()
    assert [(r["chosen"], r["rejected"]) for r in rows] == [("A", "D"), ("B", "C"), ("C", "B"), ("D", "A")]


# --- I2-I4 -------------------------------------------------------------------

@pytest.mark.parametrize("blocked", [False, True])
def test_gradients_are_read_once(spark, blocked):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rng = np.random.default_rng(0)
    g = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    if blocked:
        rows = [(i, "val" if i < 10 else "train", k, v[2 * k:2 * k + 2]) for i, v in g for k in range(2)]
        df = spark.createDataFrame(rows, "id long, split string, block_id long, vals array<double>")
        train = df.where("split = 'train'").mapInArrow(seen, df.schema)
        out = influence.influence_scores_blocked(train.unionByName(df.where("split = 'val'")))
        expected = 100  # training slices
    else:
        df = spark.createDataFrame(g, "id long, grad array<double>")
        out = influence.influence_scores(df.where("id >= 10").mapInArrow(seen, df.schema), df.where("id < 10"))
        expected = 50
    got = {r["id"]: r["score"] for r in out.collect()}
    out.groupBy().sum("score").collect()  # a second use does not read them again
    if not blocked:
        assert read.value == expected
    assert read.value <= 2 * expected  # blocked: the union is also searched for the validation part
    v = np.mean([x for _, x in g[:10]], axis=0)
    lam = np.mean([np.dot(x, x) for _, x in g[10:]]) / 1000
    assert len(got) == 50 and all(abs(got[i] - np.dot(x, v) / (lam + np.dot(x, x))) < 1e-9 for i, x in g[10:])
