import random
from collections import Counter

import pytest

from prefspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, TARGET string"


def targets(sizes):
    """The contract's rule, one capped source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def corpus(seed, n=1500):
    rng = random.Random(seed)
    names = [None, "a", "B", "é", "z", "empty", "hot"]
    rows = []
    for i in range(n):
        s = rng.choices(names, weights=[1, 2, 2, 1, 3, 1, 9])[0]
        rows.append((i, "" if s == "empty" else " ".join(["w"] * rng.randint(0, 40)) + f" d{i}", s, "x", "y"))
    return rows + [(1, None, "a", "x", "y"), (2, "\t \n", "z", "x", "y"), (None, "one two", "B", "x", "y")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takes(spark, seed):
    rows = corpus(seed)
    out = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1
        taken[r["source"]] += r["taken"]
    for s, n in sizes.items():  # within five standard deviations
        assert abs(taken[s] - want[s]) <= 5 * 0.5 * sum(len((t or "").split()) ** 2 for _, t, x, _, _ in rows if x == s) ** 0.5 + 1e-6


def test_reruns_and_layouts_agree(spark):
    rows = corpus(4, 300)
    plans = [mixing.mix_plan(spark.createDataFrame(rows, SCHEMA).repartition(k)).select("doc_id", "text", "copies").collect()
             for k in (1, 7)]
    assert Counter(map(tuple, plans[0])) == Counter(map(tuple, plans[1]))


def test_mix_emits_whole_rows_and_keeps_columns(spark):
    rows = corpus(5, 200) + [(7, "same row", "a", "x", "y")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df)
    assert out.columns == df.columns
    plan = Counter()
    for r in mixing.mix_plan(df).select("doc_id", "text", "copies").collect():
        plan[(r[0], r[1])] += r[2]
    assert Counter((r[0], r[1]) for r in out.collect()) == Counter({k: n for k, n in plan.items() if n})


def test_no_words_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "a", "", ""), (2, " ", None, "", "")], SCHEMA)
    assert [(r["target"], r["taken"]) for r in mixing.mix_plan(df).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_plan(df.limit(0)).count() == 0
