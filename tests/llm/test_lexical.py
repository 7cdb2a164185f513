import math
import random
import re

import numpy as np
import pytest

from prefspark.llm import lexical

DOCS = "doc_id long, text string, item_id string, score string, n string"
ITEMS = "item_id long, text string, doc_id string, uid string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k):
    have = [(i, t) for i, t in ((i, TERM.findall(lowered(x))) for i, x in docs) if t]
    n_docs, all_terms = len(have), sum(len(t) for _, t in have)
    out = []
    for item, text in items:
        hits = []
        for doc, terms in have:
            m, score = 100 - 25 + (25 * len(terms) * n_docs) // all_terms, 0
            for q in TERM.findall(lowered(text)):
                df, tf = sum(q in t for _, t in have), terms.count(q)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                hits.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=4, **options):
    d = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, "a", "b") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in lexical.ranked_search(d, q, k, **options).collect()), key=str)


@pytest.mark.parametrize("entries", [65_536, 7])
def test_equals_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(lexical, "DOC_TILE", 5)
    monkeypatch.setattr(lexical, "QUERY_TILE", 2)
    monkeypatch.setattr(lexical, "TERM_TILE", 3)
    rng = random.Random(3)
    words = ["a", "B", "Été", "été", "x9", "the", "THE", "日本", "k_k", "q-r", "K"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "... !"), docs[0], docs[0], (None, docs[3][1]), (53, "the " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(6)]
    items += [(90, None), (91, ""), (92, "unknown"), items[0], (None, "the the the")]
    assert run(spark, docs, items, block_entries=entries) == brute(docs, items, 4)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None), (2, " ")], [(1, "a")]) == []


def test_ranges_stay_exact():
    """Sums in floating point stay below 2 ** 53 and the parts sum to the whole, a hugely repeated term included."""
    rng = np.random.default_rng(0)
    matrix = rng.integers(0, 30_000, (5, 40)).astype(np.int64)
    matrix[2, 7], matrix[4, 8] = 10 ** 11, 9 * 10 ** 9
    parts = lexical.exact_ranges(matrix, 16)
    total = np.zeros_like(matrix)
    for low, high, part in parts:
        assert part.sum(axis=1).max() * lexical.MAX_IMPACT < lexical.EXACT
        total[:, low:high] += part.astype(np.int64)
    assert (total == matrix).all() and len(parts) > 3


def test_ties_are_kept_by_id():
    ids, scores = np.array([9, 3, 7, 1, 5]), np.array([4, 4, 4, 0, 4])
    assert ids[lexical.best_of(ids, scores, 2)].tolist() == [3, 5]
