import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import graph, jaccard

SCHEMA = "doc_id long, text string, component_id string, node string"


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            comp[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard.jaccard_classes(df).collect()), key=str)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    for name, value in (("FREQUENT", 2), ("VERY_FREQUENT", 5), ("BLOCK", 4)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard.node_signatures, "__defaults__", (85, (2, 5)))
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(400)]
    passage = rng.choices(word, k=25)
    texts = [None, "", "  \n", "One", "one", "one two three", "ONE two three", "é É", "a b c d", "a b c d e"]
    for size in (8, 9, 12, 30, 33, 36, 70, 130, 300):
        base = rng.choices(word, k=size)
        for _ in range(14):  # around the threshold, in both directions
            texts.append(" ".join(edited(rng, base, rng.randint(0, max(1, size // 25)))))
            texts.append(" ".join(base[:rng.randint(max(1, size * 8 // 10), size)]))
        texts.append(" ".join(base + passage))
    for _ in range(15):
        texts.append(" ".join(passage + rng.choices(word, k=rng.randint(1, 60))))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[40]), (40, texts[40]), (None, texts[41]), (None, "only nulls here in this one"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(6, 200))
        x = rng.choice(10 ** 9, n, replace=False)
        y = np.concatenate([x[rng.random(n) > rng.random() * 0.1], rng.choice(10 ** 9, int(rng.integers(0, n // 10 + 1))) + 10 ** 9])
        i = len(np.intersect1d(x, y))
        if 100 * i < 85 * (n + len(y) - i) or len(y) < 6:
            continue
        counts = {t: int(c) for t, c in zip(np.union1d(x, y), rng.choice([2, 20, 40, 999, 1001, 50000], n + len(y)))}
        sig = []
        for s in (x, y):
            shared = np.array([t for t in s if t in x and t in y and (t in set(x)) and (t in set(y))], dtype=np.int64)
            shared = np.intersect1d(x, y) if s is x or s is y else shared
            sig.append(jaccard.node_signatures(len(s), shared, np.array([counts[t] for t in shared])))
        assert len(np.intersect1d(*sig)), (n, len(y), i)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    random.Random(0).shuffle(edges)
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table_and_threshold(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        jaccard.jaccard_classes(spark.createDataFrame([], SCHEMA), percent=50)


def test_keep_one_keeps_one_of_each(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a, "x", "y"), (2, a + " end", "x", "y"), (2, a + " end", "x", "y"), (None, a, "x", "y"), (5, b, None, "y"),
            (6, None, "x", "y"), (6, None, "x", "y"), (7, "", "x", "y")]
    out = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "component_id", "node"]
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 5, 6, 6, 7]
