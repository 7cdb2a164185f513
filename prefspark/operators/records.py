"""Preference records (P2, P3) and score attachment.

Records come in one of two layouts:
- nested: one row per record, ``chosen``/``rejected`` are ARRAY<STRUCT<role, content>>;
- long: one row per message, (id, side, turn, role, text) with side
  "chosen" or "rejected". Turns are picked with map-side aggregates, so no
  record is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from prefspark.functions.text import turn_agg, turn_text


def _is_nested(pref: DataFrame) -> bool:
    return "chosen" in pref.columns and isinstance(pref.schema["chosen"].dataType, ArrayType)


def record_turns(pref: DataFrame, trim: bool, id_col: str = "id") -> DataFrame:
    """(id, instruction, chosen, rejected): first user / assistant turns of each side ("" if none)."""
    if _is_nested(pref):
        return pref.select(
            F.col(id_col),
            turn_text("chosen", "user", "first", trim=trim).alias("instruction"),
            turn_text("chosen", "assistant", "first", trim=trim).alias("chosen"),
            turn_text("rejected", "assistant", "first", trim=trim).alias("rejected"))
    side = F.col("side")
    return pref.groupBy(id_col).agg(
        turn_agg("user", "first", trim, where=side == "chosen").alias("instruction"),
        turn_agg("assistant", "first", trim, where=side == "chosen").alias("chosen"),
        turn_agg("assistant", "first", trim, where=side == "rejected").alias("rejected"))


def _complete():
    return ((F.length("instruction") > 0) & (F.length("chosen") > 0)
            & (F.length("rejected") > 0))


def to_dpo_records(pref: DataFrame, id_col: str = "id") -> DataFrame:
    """instruction/chosen/rejected from the first user / assistant turns (stripped).

    A row is dropped when any of the three is empty after stripping.
    """
    rec = record_turns(pref, True, id_col)
    return rec.filter(_complete()).select(
        id_col, "instruction", F.lit("").alias("input"), "chosen", "rejected")


def conversion_report(pref: DataFrame, id_col: str = "id") -> DataFrame:
    """One row with rows converted and rows dropped."""
    ok = _complete()
    return record_turns(pref, True, id_col).agg(
        F.count_if(ok).alias("converted"), F.count_if(~ok).alias("dropped"),
        F.count(F.lit(1)).alias("total"))


def attach_scores(pref: DataFrame, scores: DataFrame, id_col: str = "id",
                  score_col: str = "score") -> DataFrame:
    """Score table rows for every record; a record without a score row gets 0.0.

    A score that is null in its row (undefined) stays null.

    instruction = first user turn of chosen, chosen = its first assistant
    turn (both raw, "" when absent), rejected = chosen (a placeholder).
    """
    rec = record_turns(pref, False, id_col).select(id_col, "instruction", "chosen")
    j = rec.join(scores.select(F.col(id_col), F.col(score_col).alias("_s"), F.lit(True).alias("_scored")), id_col, "left")
    return j.select(
        F.col(id_col), "instruction", F.lit("").alias("input"), "chosen",
        F.col("chosen").alias("rejected"),
        F.when(F.col("_scored"), F.col("_s")).otherwise(F.lit(0.0)).alias("score_datainf"))
