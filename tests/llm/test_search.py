import math
import random
from fractions import Fraction

import pytest

from prefspark.llm import search

SCHEMA = "vec_id long, embedding array<float>, score string, uid string"


def brute(rows, k, asked):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (qi, q) in enumerate(ok):
        if qi is None or qi % asked:
            continue
        hits = [(-sum(x * y for x, y in zip(q, v)), i is None, i or 0, i) for b, (i, v) in enumerate(ok) if a != b]
        out += [(qi, r, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, k=5, asked=5):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in search.top_k(df, lambda c: c % asked == 0, k).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(search, "ROW_BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    rng = random.Random(seed)
    # few distinct values: many ties; some clusters far from the origin
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 3.0 if i % 9 == 0 else 1.0]) for _ in range(6)]) for i in range(150)]
    rows += [(5, None), (10, [1.0, None]), (15, [float("nan")] * 6), (20, [float("inf")] * 6), (None, [1.0] * 6),
             (25, [2.0, 1.0]), (30, []), rows[0], rows[0], (35, [0.0] * 6)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_few_rows_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None)]
    assert run(spark, rows) == [(0, 1, 1, 128 * 256 + 128 * 512)]
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_very_large_components_stay_exact(spark):
    rows = [(0, [3e8, 1.0]), (1, [2e5, 1.0]), (2, [2e5, 2.0]), (3, [1e30, 1.0])]
    got = run(spark, rows)
    f = math.floor
    assert (0, 2, 2, f(256 * 3e8) * f(256 * 2e5) + 256 * 512) in got
    assert (0, 1, 3, 2 ** 63 - 1) in got


def test_largest_doubles_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 1.0]) * 1e160, float(i)]) for i in range(10)]
    rows += [(10 + i, [rng.choice([-1.7e308, 1e300, 0.5, -0.25]), rng.uniform(-3, 3), 1e150 * i]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in search.top_k(df, lambda c: c % 5 == 0).collect())
    # scores are cut to 64 bits before they are ranked
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 5 == 0:
            cut = [(max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(q, v)))), j) for j, v in whole if j != i]
            want += [(i, r, j, s) for r, (s, j) in enumerate(sorted(cut, key=lambda h: (-h[0], h[1]))[:5], 1)]
    assert got == sorted(want)
