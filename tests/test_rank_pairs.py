"""Rank and pair properties and edges."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prefspark.operators.pairs import next_neighbor_pairs, self_pairs_random, symmetric_pairs
from prefspark.operators.rank import global_rank, rank_by_score


def _scored(spark, scores):
    rows = [(i, f"i{i}", "", f"t{i}", f"t{i}", s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "id long, instruction string, input string, chosen string, "
                                       "rejected string, score_datainf double")


def _ref_rank(df):
    return {r["id"]: r["r"] for r in df.withColumn(
        "s", F.when(F.isnan("score_datainf"), None).otherwise(F.col("score_datainf")))
        .select("id", (F.row_number().over(Window.orderBy(F.desc_nulls_last("s"), "id")) - 1)
                .alias("r")).collect()}


@pytest.mark.parametrize("buckets", [2, 5, 16])
def test_rank_equals_single_window_with_hot_values_and_nulls(spark, buckets):
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0))             # a third of rows share one score
        .when(F.col("id") % 10 == 1, F.lit(None))            # nulls
        .when(F.col("id") % 41 == 0, F.lit(float("nan")))    # NaN sorts with nulls
        .otherwise((F.col("id") * 7919 % 1000).cast("double")).alias("score_datainf"))
    got = {r["id"]: r["rank"] for r in rank_by_score(df, buckets=buckets).collect()}
    assert got == _ref_rank(df)


def test_rank_handles_null_majority(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 4 != 0, F.lit(None))
                                  .otherwise(F.col("id") % 3).cast("double").alias("score_datainf"))
    got = {r["id"]: r["rank"] for r in rank_by_score(df, buckets=8).collect()}
    assert got == _ref_rank(df)


def test_rank_multi_key(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"))
    got = {r["id"]: r["rank"] for r in global_rank(df, ["a", "b"], buckets=4).collect()}
    ref = {r["id"]: r["r"] for r in df.select(
        "id", (F.row_number().over(Window.orderBy("a", "b", "id")) - 1).alias("r")).collect()}
    assert got == ref


def test_rank_plan_has_no_single_partition_exchange_on_rows(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("score_datainf"))
    plan = rank_by_score(df, buckets=4)._jdf.queryExecution().executedPlan().toString()
    # The only SinglePartition exchange allowed is the one over per-segment counts.
    assert plan.count("SinglePartition") <= 1
    assert "hashpartitioning(_rk_segno" in plan


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6])
def test_symmetric_pairs_mirror(spark, n):
    out = symmetric_pairs(_scored(spark, [float(n - i) for i in range(n)])).collect()
    assert len(out) == n
    for r in out:
        i = r["rank"]
        assert r["chosen"] == f"t{i}" and r["rejected"] == f"t{n - 1 - i}"


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_next_neighbor_one_cycle(spark, n):
    out = next_neighbor_pairs(_scored(spark, [float(n - i) for i in range(n)])).collect()
    assert len(out) == n
    nxt = {r["chosen"]: r["rejected"] for r in out}
    if n:
        seen, cur = set(), "t0"
        for _ in range(n):
            seen.add(cur)
            cur = nxt[cur]
        assert cur == "t0" and len(seen) == n


def _docs(spark, texts):
    return spark.createDataFrame([(i, f"q{i}", "", t) for i, t in enumerate(texts)],
                                 "id long, instruction string, input string, chosen string")


def test_self_pairs_permutation_without_own_text(spark):
    texts = [f"t{i % 7}" if i % 3 == 0 else f"u{i}" for i in range(200)]
    out = self_pairs_random(_docs(spark, texts)).collect()
    assert len(out) == 200
    assert sorted(r["rejected"] for r in out) == sorted(texts)
    assert all(r["rejected"] != r["chosen"] for r in out)


def test_self_pairs_five_of_ten_equal_works(spark):
    texts = ["same"] * 5 + [f"x{i}" for i in range(5)]
    out = self_pairs_random(_docs(spark, texts)).collect()
    assert all(r["rejected"] != r["chosen"] for r in out)


@pytest.mark.parametrize("texts", [["same"] * 4, ["same"] * 6 + [f"x{i}" for i in range(4)]])
def test_self_pairs_impossible_raises(spark, texts):
    with pytest.raises(Exception, match="more than half"):
        self_pairs_random(_docs(spark, texts)).collect()


def test_symmetric_upper_half(spark):
    out = symmetric_pairs(_scored(spark, [5.0, 4.0, 3.0, 2.0, 1.0]), keep="upper_half").collect()
    assert sorted((r["chosen"], r["rejected"]) for r in out) == [("t0", "t4"), ("t1", "t3")]


def test_materialized_flow_equals_lazy_pairs(spark):
    from prefspark import fixtures as FX
    from prefspark.operators import influence, pairs
    from prefspark.plans.influence_pairs import influence_pairs_query
    from shared_paths import SF001
    flow = {tuple(r) for r in influence_pairs_query(spark, SF001).collect()}
    g = FX.fx_grad(spark, SF001)
    train = g.filter(F.col("split") == "train")
    s = influence.influence_scores(train, g.filter(F.col("split") == "val"))
    docs = FX.fx_doc(spark, SF001)
    scored = docs.join(s, "id", "left").withColumn("score_datainf", F.coalesce("score", F.lit(0.0)))
    lazy = {tuple(r) for r in pairs.pairs(scored, "both").collect()}
    assert flow == lazy and len(flow) > 0


def test_md5_order_with_a_third_identical_texts(spark):
    from prefspark.operators.pairs import self_pair_order_keys
    texts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("t"), (F.col("id") % 400).cast("string"))).alias("chosen"))
    h, keys = self_pair_order_keys("chosen", 42)
    got = {r["id"]: r["rank"] for r in global_rank(texts, keys, buckets=8).collect()}
    ref = {r["id"]: r["r"] for r in texts.select(
        "id", (F.row_number().over(Window.orderBy(h, "id")) - 1).alias("r")).collect()}
    assert got == ref
    out = self_pairs_random(texts.select("id", F.lit("q").alias("instruction"), F.lit("").alias("input"),
                                         "chosen")).collect()
    assert len(out) == 3000 and all(r["rejected"] != r["chosen"] for r in out)


def test_rank_with_infinities_hot_and_cold(spark):
    inf = float("inf")
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit(inf))
                                  .when(F.col("id") % 7 == 0, F.lit(-inf))
                                  .when(F.col("id") % 11 == 0, F.lit(None))
                                  .otherwise((F.col("id") % 50).cast("double")).alias("score_datainf"))
    got = {r["id"]: r["rank"] for r in rank_by_score(df, buckets=8).collect()}
    assert got == _ref_rank(df)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10])
@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_block_pairing_equals_record_pairing(spark, n, block):
    from prefspark.operators.pairs import _mirror_giver, _next_giver, _pair_blocks, _pair_up
    ranked = spark.createDataFrame(
        [(i, n, f"i{i}", "", f"t{i}") for i in range(n)],
        "rank long, _n long, instruction string, input string, chosen string")
    got = _pair_blocks(ranked, ["symmetric", "next_neighbor"], block=block)
    ref = _pair_up(ranked, [("symmetric", _mirror_giver()), ("next_neighbor", _next_giver())])
    cols = ["strategy", "rank", "instruction", "input", "chosen", "rejected"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, ref.select(cols).collect()))


@pytest.mark.parametrize("n,shift", [(1, 0), (2, 1), (7, 3), (10, 1), (10, 4), (10, 9), (200, 5), (200, 150)])
@pytest.mark.parametrize("block", [1, 3, 64])
def test_shift_pairing_equals_record_pairing(spark, n, shift, block):
    from prefspark.operators.pairs import _pair_shift, _pair_up
    ranked = spark.createDataFrame(
        [(i, n, i * 10, f"i{i}", "", f"t{i}") for i in range(n)],
        "rank long, _n long, id long, instruction string, input string, chosen string")
    got = _pair_shift(ranked, F.lit(shift), block=block, keep_id="id")
    ref = _pair_up(ranked, [(None, F.pmod(F.col("rank") - shift, F.col("_n")))], keep_id="id",
                   clean=False)
    cols = ["rank", "_id", "instruction", "input", "chosen", "rejected"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, ref.select(cols).collect()))


def test_many_partitions_few_rows(spark):
    """Default cluster settings (200 partitions -> 1600 buckets) on a few hundred rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = _scored(spark, [float(i % 13) for i in range(300)])
        got = {r["id"]: r["rank"] for r in rank_by_score(df).collect()}
        assert got == _ref_rank(df)
        out = symmetric_pairs(df).collect()
        assert sorted(r["rank"] for r in out) == list(range(300))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
