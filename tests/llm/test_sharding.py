from collections import Counter

import numpy as np

from prefspark.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, SLOT string"


def shuffled(spark, n, shards, parts=3, **options):
    df = spark.createDataFrame([(i % 50 if i % 7 else None, None if i % 5 == 0 else f"t{i}", "x", "y") for i in range(n)],
                               SCHEMA).repartition(parts)
    return S.uniform_shuffle(df, shards, **options)


def test_exact_sizes_gapless_slots_and_all_rows(spark):
    for n, shards, bin_rows in ((0, 4, 10), (3, 5, 10), (1003, 7, 20)):
        out = shuffled(spark, n, shards, bin_rows=bin_rows)
        assert sorted(out.columns) == ["doc_id", "shard", "slot", "text"]
        rows = out.collect()
        sizes = Counter(r["shard"] for r in rows)
        assert len(rows) == n and (not n or max(sizes.values()) - min(sizes[k] for k in range(shards)) <= 1)
        for k in sizes:
            assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))
        want = Counter((i % 50 if i % 7 else None, None if i % 5 == 0 else f"t{i}") for i in range(n))
        assert Counter((r["doc_id"], r["text"]) for r in rows) == want


def test_matrix_margins_and_rerun():
    starts, free = np.array([0, 10, 10, 35, 90]), S.even_sizes(90, 4)
    rows = [S.matrix_row(starts, p, free, 3) for p in range(4)]
    assert [r.sum() for r in rows] == [10, 0, 25, 55] and (sum(rows) == free).all()
    assert all((a == S.matrix_row(starts, p, free, 3)).all() for p, a in enumerate(rows))


def test_counts_follow_the_hypergeometric_law():
    starts, free = np.array([0, 6, 20]), np.array([5, 15])
    seen = Counter(int(S.matrix_row(starts, 0, free, seed)[0]) for seed in range(4000))
    from math import comb
    for k in range(6):
        want = comb(5, k) * comb(15, 6 - k) / comb(20, 6)
        assert abs(seen[k] / 4000 - want) < 0.03


def test_large_draws_have_the_right_mean_and_spread():
    good, bad, taken = 3_000_000_000, 5_000_000_000, 2_000_000
    got = [S.hypergeometric(np.random.default_rng(i), good, bad, taken) for i in range(60)]
    p = good / (good + bad)
    sd = (taken * p * (1 - p)) ** 0.5
    assert abs(np.mean(got) - taken * p) < 4 * sd / 60 ** 0.5 and 0.6 * sd < np.std(got) < 1.5 * sd


def test_every_shard_is_equally_likely(spark):
    counts = Counter()
    for seed in range(6):
        for r in shuffled(spark, 400, 4, seed=seed).collect():
            if r["text"] == "t1":
                counts[r["shard"]] += 1
    assert sum(counts.values()) == 6 and len(counts) > 1
