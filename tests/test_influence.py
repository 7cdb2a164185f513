"""Influence scoring (I1-I4): closed form, blocked form and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from prefspark import fixtures as FX
from prefspark.operators.influence import (damping, influence_scores, influence_scores_blocked,
                                           mean_vector_row)

from shared_paths import SF001


def test_matches_two_step_numpy(spark):
    g = FX.fx_grad(spark, SF001)
    train = g.filter(F.col("split") == "train")
    val = g.filter(F.col("split") == "val")
    got = {r["id"]: r["score"] for r in influence_scores(train, val).collect()}
    tr = [(r["id"], r["grad"]) for r in train.collect()]
    v = np.mean([np.array(r["grad"]) for r in val.collect() if r["grad"] is not None], axis=0)
    lam = np.mean([np.dot(x, x) for _, x in tr if x is not None]) / 1000
    for i, x in tr:
        if x is None:
            assert got[i] == 0.0
            continue
        x = np.array(x)
        c = np.dot(x, v) / (lam + np.dot(x, x))
        ref = np.dot(x, (v - c * x) / lam)
        assert abs(got[i] - ref) <= 1e-12 * max(1.0, abs(ref))


def test_blocked_equals_whole(spark):
    g = FX.fx_grad(spark, SF001)
    whole = {r["id"]: r["score"] for r in influence_scores(
        g.filter(F.col("split") == "train"), g.filter(F.col("split") == "val")).collect()}
    blk = {r["id"]: r["score"] for r in influence_scores_blocked(FX.fx_gradblk(spark, SF001)).collect()}
    assert whole.keys() == blk.keys()
    assert all(abs(whole[k] - blk[k]) < 1e-12 for k in whole)


def test_zero_gradients_give_null_not_error(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, grad array<double>")
    out = influence_scores(df, df).collect()
    assert [r["score"] for r in out] == [None, None]


def test_no_validation_gradient_raises(spark):
    val = spark.createDataFrame([(1, None)], "id long, grad array<double>")
    import pytest
    with pytest.raises(Exception, match="no gradients"):
        mean_vector_row(val).collect()
    with pytest.raises(Exception, match="no gradients"):
        damping(val).collect()


def _slices(rows):
    return [(i, split, b, v) for i, split, g in rows for b, v in (enumerate([g[:2], g[2:]]) if g else [(None, None)])]


BLOCKS = "id long, split string, block_id int, vals array<double>"
GRADS = [(1, "train", [1.0, 2.0, 3.0, 4.0]), (2, "train", None), (3, "train", [0.5, 0.0, -1.0, 2.0]),
         (4, "val", [1.0, 1.0, 0.0, 2.0]), (5, "val", [3.0, 1.0, 2.0, 0.0])]


def test_blocked_scores_agree_above_the_broadcast_limit(spark):
    from prefspark.operators.influence import influence_scores_blocked
    g = spark.createDataFrame(GRADS, "id long, split string, grad array<double>")
    want = {r["id"]: r["score"] for r in influence_scores(g.where("split = 'train'"), g.where("split = 'val'")).collect()}
    blocks = spark.createDataFrame(_slices(GRADS), BLOCKS)
    for limit in (512 * 2**20, 0):
        got = {r["id"]: r["score"] for r in influence_scores_blocked(blocks, max_broadcast_bytes=limit, salts=3).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocked_scores_need_gradients_on_both_sides(spark):
    import pytest
    from prefspark.operators.influence import influence_scores_blocked
    for lacking in ("train", "val"):
        rows = [(i, s, None if s == lacking else g) for i, s, g in GRADS]
        with pytest.raises(Exception, match="no gradients"):
            influence_scores_blocked(spark.createDataFrame(_slices(rows), BLOCKS)).collect()


def test_undefined_scores_stay_null_and_missing_ones_are_zero(spark):
    from prefspark.operators.records import attach_scores
    pref = spark.createDataFrame([(i, "chosen", 0, "user", "q") for i in (1, 2, 3)],
                                 "id long, side string, turn long, role string, text string")
    scores = spark.createDataFrame([(1, 2.0), (2, None)], "id long, score double")
    assert {r["id"]: r["score_datainf"] for r in attach_scores(pref, scores).collect()} == {1: 2.0, 2: None, 3: 0.0}
