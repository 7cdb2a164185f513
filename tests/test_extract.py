"""Golden cases for the text functions."""

import pytest
from pyspark.sql import functions as F

from prefspark.functions import (clean_text, cut_at_stop, extract_gold, extract_number,
                                 parse_verdict, py_strip, turn_text)

NUMBER_CASES = [
    ("The answer is 6.", "6"),
    ("a 1,234 The answer is -5", "5"),
    ("-2.50", "-2.50"),
    ("x .5", "5"),
    ("none", None),
    ("The answer is 3. The answer is 1,000.25 ok", "1000.25"),
    ("The answer is", None),
    ("+3.0 then +4", "4"),
    ("5.", "5"),
    ("3-4", "4"),
    ("1.2.3", "3"),
]

GOLD_CASES = [
    ("#### 1,234", "1"),
    ("#### -5", None),
    ("####  7.25", "7.25"),
    ("#### .5", ".5"),
    ("### 3", None),
]

VERDICT_CASES = [("1", 1), ("Response 2 is better", 2), ("12", None), ("x1", None),
                 ('"2".', 2), ("both 2 or 1", 2), (None, None)]


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_extract_number(spark):
    got = _one(spark, [c[0] for c in NUMBER_CASES], extract_number)
    assert got == [c[1] for c in NUMBER_CASES]


def test_extract_gold(spark):
    got = _one(spark, [c[0] for c in GOLD_CASES], extract_gold)
    assert got == [c[1] for c in GOLD_CASES]


def test_parse_verdict(spark):
    got = _one(spark, [c[0] for c in VERDICT_CASES], parse_verdict)
    assert got == [c[1] for c in VERDICT_CASES]


@pytest.mark.parametrize("s", ["\t x \n", " y ", "\x1cz\x1f", "　 w ", "plain", ""])
def test_py_strip_matches_python(spark, s):
    assert _one(spark, [s], py_strip) == [s.strip()]


def test_cut_at_stop(spark):
    vals = ["  a b Q: c Q: d", "no stop  ", "Q: first"]
    assert _one(spark, vals, cut_at_stop) == [v.split("Q:")[0].strip() for v in vals]


def test_clean_text(spark):
    vals = ["a b c", None, "plain"]
    assert _one(spark, vals, clean_text) == ["a b c", None, "plain"]


def test_turn_text_rules(spark):
    msgs = [("system", "s"), ("user", "  u1 "), ("assistant", "a1"), ("user", "u2"),
            ("assistant", " a2\t"), ("user", "u3")]
    df = spark.createDataFrame(
        [(0, [{"role": r, "content": c} for r, c in msgs]), (1, []), (2, None)],
        "id int, m array<struct<role:string,content:string>>").orderBy("id")
    out = df.select(
        turn_text("m", "user", "first", True, "").alias("a"),
        turn_text("m", "user", "last", False, "empty").alias("b"),
        turn_text("m", "assistant", "first", False, "").alias("c"),
        turn_text("m", None, "last", False, None).alias("d")).collect()
    assert tuple(out[0]) == ("u1", "u3", "a1", "u3")
    assert tuple(out[1]) == ("", "empty", "", None)
    assert tuple(out[2]) == ("", "empty", "", None)


def test_normalized_mode(spark):
    df = spark.createDataFrame([("The answer is 18.0", "#### 18"), ("The answer is -5", "#### -5")],
                               "g string, a string")
    rows = df.select(extract_number("g", "normalized").alias("p"),
                     extract_gold("a", "normalized").alias("q")).collect()
    assert rows[0]["p"] == rows[0]["q"] == "18"
    assert rows[1]["p"] == rows[1]["q"] == "-5"
