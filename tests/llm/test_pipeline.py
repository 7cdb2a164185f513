"""Every stage on what the one before kept, against brute force."""

import random
from collections import Counter

import public_tokenizers
from brute_pii import base
from test_jaccard import brute as classes
from test_jaccard import shingles
from tokenizers import Tokenizer

import corpus_pipeline
from prefspark.llm import mixing, packing, quality
from prefspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = [f"word{i}" for i in range(600)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(word, k=rng.randint(30, 300)))
        rows.append((i, text + (f" me{i}@mail.org +1 (269) 555-32{i % 90 + 10} end" if i % 5 == 0 else "")))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 3)]
    rows += [(300 + i, rows[i][1] + " tail") for i in range(0, 60, 4)]
    rows += [(400, "spam " * 200), (401, None), (402, ""), (403, "short text"), (5, rows[5][1]), (404, "x" * 9000 + " " + rows[7][1])]
    return [(i, t, "en", None if i % 17 == 0 else f"src{i % 4}", len(t or "")) for i, t in rows]


def test_stages(spark):
    rows, docs = corpus(), None
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "unused")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept[name] = [tuple(r) for r in docs.collect()]

    good = kept["quality_rules"]

    def fails(t):
        n, _, _, _, repeated, _ = quality.stats_of(t)
        return n < 50 or 100 * repeated > 50 * n
    assert Counter(good) == Counter(r for r in rows if not fails(r[1]))

    one = kept["near_duplicates"]
    groups = {}
    for r, (i, _, c) in zip(sorted(good, key=lambda r: str((r[0], r[1]))), sorted(classes([r[:2] for r in good]), key=str)):
        groups.setdefault(c, []).append(i)
    assert Counter(r[0] for r in one) == Counter(groups.keys()) and Counter(one) - Counter(good) == Counter()

    clean = kept["personal_data"]
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in one) and not any(base(r[1]) for r in clean)
    text = {r[0]: r[1] for r in clean}
    for r in one:
        want, at = "", 0
        for kind, s, e in sorted(base(r[1]), key=lambda x: x[1]):
            want, at = want + r[1][at:s] + f"[{kind.upper()}]", e
        assert text[r[0]] == want + r[1][at:]

    times = Counter(r[0] for r in kept["mixing_sources"])
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.createDataFrame(clean, SCHEMA)).collect()}
    assert times == Counter({k: n for k, n in taken.items() if n}) and max(times.values()) <= 2

    packed = corpus_pipeline.STAGES[4][1](spark, docs, "unused").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in kept["mixing_sources"]:
        for k, (s, n) in enumerate(packing.cut_points(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1)):
            want[(r[0], k, s, n)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == want


def test_near_copies_between_080_and_085_go(spark):
    rng = random.Random(5)

    def fresh(n):
        return [f"n{rng.randrange(10 ** 9)}" for _ in range(n)]

    rows, gone = [], set()
    # added words: 100 five-word shingles of 100 + m are common, so 25 is the border; a replaced
    # passage of m words leaves 96 - m of 104 + m
    for m in (18, 20, 22, 24, 25, 26, 28):
        base = fresh(104)
        rows += [(10 * m, " ".join(base)), (10 * m + 1, " ".join(base + fresh(m)))]
        gone |= {10 * m + 1} if m <= 25 else set()
    for k, m in enumerate((6, 7, 8)):
        base = fresh(104)
        rows += [(500 + 10 * k, " ".join(base)), (501 + 10 * k, " ".join(base[:50] + fresh(m) + base[50 + m:]))]
        gone |= {501 + 10 * k} if 100 * (96 - m) >= 80 * (104 + m) else set()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    sets = {i: (shingles(t, 5), shingles(t)) for i, t in rows}
    near = [[len(a & b) / len(a | b) for a, b in zip(sets[i - 1], sets[i])] for i in gone]
    assert len(gone) >= 5 and all(five >= 0.8 and four < 0.85 for five, four in near), near
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "unused").collect()} == {i for i, _ in rows} - gone


def test_run_and_registration(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "personal_data", "mixing_sources", "best_fit_packing"]
    out = QUERIES["pipeline"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0
