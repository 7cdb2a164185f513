from prefspark.llm import chat

SCHEMA = "pair_id long, side string, turn long, role string, text string, prompt string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {r["pair_id"]: r for r in chat.format_preferences(df).collect()}


def t(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_prefix_completions_and_masks(spark):
    rows = []
    for side, last in (("chosen", "good"), ("rejected", "bad 😀")):
        rows += [(1, side, 0, "system", "s"), (1, side, 1, "user", "q"), (1, side, 2, "assistant", last),
                 (1, side, 3, "user", "more"), (1, side, 4, "assistant", "x" * 5000)]
    rows += [(2, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", None), (3, "chosen", 0, "user", None),
             (4, "chosen", 0, "user", "b"), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a"),
             (4, "rejected", 2, None, "z"), (None, "chosen", 0, "user", "a"), (5, "other", 0, "user", "a"),
             (6, "chosen", None, "user", "a"), (7, "chosen", 0, "user", "a"), (7, "chosen", 0, "user", "a"), (7, "rejected", 1, "user", "a")]
    got = run(spark, rows)
    assert sorted(got) == [1, 2, 3, 4, 7]
    one = got[1]
    assert one["prompt"] == t("system", "s") + t("user", "q") and one["n_prompt_turns"] == 2
    for side, last in (("chosen", "good"), ("rejected", "bad 😀")):
        assert one[side] == t("assistant", last) + t("user", "more") + t("assistant", "x" * 5000)
        spans = [one[side][int(a):int(b)] for a, b in (s.split(":") for s in one[f"{side}_mask"].split(","))]
        assert spans == [last + "<|im_end|>", "x" * 5000 + "<|im_end|>"]
    assert (got[2]["prompt"], got[2]["chosen"], got[2]["rejected"], got[2]["rejected_mask"]) == ("", t("user", "a"), None, None)
    assert (got[3]["prompt"], got[3]["chosen"], got[3]["rejected"], got[3]["chosen_mask"]) == (t("user", ""), "", "", "")
    assert got[4]["prompt"] == t("user", "a") and got[4]["chosen"] == "" and got[4]["rejected"] == t("", "z")
    assert (got[7]["chosen"], got[7]["rejected"]) == (t("user", "a"), t("user", "a"))  # other turn numbers


def test_empty(spark):
    assert run(spark, []) == {}
