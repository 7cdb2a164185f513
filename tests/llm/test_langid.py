import math
import random

from pyspark.sql import functions as F

from prefspark.llm import langid
from prefspark.llm.queries import op7_langid

SF01 = "/root/testdata/sf0.01"


def longest_parse(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_automaton_parses_into_longest_matches():
    rng = random.Random(4)
    for _ in range(60):
        sample = "".join(rng.choices("abc ", k=rng.randint(0, 80)))
        a = langid.SuffixAutomaton(sample)
        for _ in range(20):
            text = "".join(rng.choices("abcd ", k=rng.randint(0, 25)))
            assert a.phrases(text) == longest_parse(text, sample)


def test_segments_and_slices_equal_one_parse_of_the_text(monkeypatch):
    rng = random.Random(1)
    samples = tuple((k, langid.plain("".join(rng.choices(c, k=200)))) for k, c in [("x", "ab "), ("y", "abc "), ("z", "cdé")])
    model = langid.Model(samples)
    texts = ["".join(rng.choices("abcdéü1 ", k=rng.choice([0, 1, 3, 40, 150]))) for _ in range(60)]
    texts += [samples[0][1] * 2, samples[1][1][:120], "", "\U0001F600"]
    for segment in (1, 2, 7, 64, 2048):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        assert model.phrases(texts).tolist() == [[longest_parse(t, sample) for _, sample in samples] for t in texts]


def test_decision_and_score_by_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "SLICE_CHARS", 50)
    samples = (("de", langid.plain("der hund und die katze")), ("en", langid.plain("the dog and the cat")))
    texts = ["The  DOG\tand", "katze und", "12", None, "", "zzz", "die the"]
    got = langid.Model(samples).predict(texts)
    for text, (lang, score) in zip(texts, got):
        if not text or text == "12":
            assert (lang, score) == ("und", 0.0)
            continue
        bits = [longest_parse(langid.plain(text), s) * math.log2(len(s) + 2) for _, s in samples]
        assert lang == samples[bits.index(min(bits))][0] and abs(score - (1 - min(bits) / max(bits))) < 1e-12


def test_odd_inputs(spark):
    df = spark.createDataFrame(
        [(1, "the cat and the hat", "en", "a"), (2, "der hund und die katze", "de", "a"), (3, None, "en", "a"), (4, "", None, "a"),
         (5, "12 + 34 !", "de", "a"), (6, "und die katze", None, "a"), (None, "the hat", "en", "a"), (7, "katze" * 5000, "zz", "a")],
        "doc_id long, text string, lang string, score string")
    samples = langid.learning_sample(df, F.col("doc_id") < 5)
    assert [k for k, _ in samples] == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, samples).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "de" and got[None][0] == "en" and got[7][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = df.limit(0)
    assert langid.identify(empty, samples).count() == 0 and langid.learning_sample(empty, F.lit(True)) == ()
    assert {r["lang_pred"] for r in langid.identify(df, ()).collect()} == {"und"}


def test_held_out_accuracy(spark):
    out = op7_langid(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet"), "doc_id")
    rows = out.where("held_out").select("lang", "lang_pred", "text").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows if r["lang_pred"] != "und")
    assert len(rows) > 200 and right > 0.97 * sum(r["lang_pred"] != "und" for r in rows)
