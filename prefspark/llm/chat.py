"""Preference formatting of conversations.

A pair has a chosen and a rejected conversation, given as rows (pair_id, side,
turn, role, text) with side ``chosen`` or ``rejected``.  The two are compared
turn by turn; the longest common prefix of turns (same number, role and text)
becomes the prompt, rendered once, and the turns after it become two
completions.  A completion's mask lists the spans ``start:end`` (code points in
the completion, end exclusive) that are trained on: the text of assistant turns
with its end marker.

Turns meet by pair and turn number in one shuffle; the first turn that differs
is a per-pair minimum; only the rendered record of a pair is gathered, which is
one output row.

Defined cases: a turn that a side lacks differs; null roles and texts equal
only each other and render as empty; a turn given more than once on a side
counts once, the smallest (role, text); a pair without one side has an empty
prompt and a null completion for it; equal conversations have empty
completions; rows with a null pair, turn or an unknown side take no part; an
empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import states_before

# The template's markers.
HEAD, MID, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("")), F.lit(MID), F.coalesce(turn["text"], F.lit("")),
                    F.lit(TAIL))


def _side(turns: Column) -> Column:
    """The text of a side's turns."""
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column) -> Column:
    """Trained spans in ``_side(turns)``."""
    starts = states_before(turns, lambda t: F.length(rendered(t)), lambda a, n: a + n)

    def span(t, at):
        start = at + len(HEAD) + F.length(F.coalesce(t["role"], F.lit(""))) + len(MID)
        end = at + F.length(rendered(t)) - 1  # without the line end after the marker
        return F.when(t["role"] == TRAINED_ROLE, F.concat_ws(":", start, end))

    return F.array_join(F.zip_with(turns, starts, span), ",")  # nulls are left out


def format_preferences(turns: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    said = F.struct("role", "text")
    both = (turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected"))
            .groupBy("pair_id", "turn")
            .agg(F.min(F.when(F.col("side") == "chosen", said)).alias("c"),
                 F.min(F.when(F.col("side") == "rejected", said)).alias("r")))
    differs = F.col("c").isNull() | F.col("r").isNull() | ~F.col("c").eqNullSafe(F.col("r"))
    gathered = both.groupBy("pair_id").agg(
        F.min(F.when(differs, F.col("turn"))).alias("first"),
        F.max(F.col("c").isNotNull()).alias("has_c"), F.max(F.col("r").isNotNull()).alias("has_r"),
        F.array_sort(F.collect_list(F.struct("turn", "c", "r"))).alias("turns"))

    def part(side, prompt):
        def wanted(t):
            early = F.coalesce(t["turn"] < F.col("first"), F.lit(True))
            return t[side].isNotNull() & (early if prompt else ~early)
        return F.transform(F.filter("turns", wanted), lambda t: t[side])

    parts = gathered.select("pair_id", "has_c", "has_r", part("c", True).alias("p"), part("c", False).alias("c"),
                            part("r", False).alias("r"))
    return parts.select(
        "pair_id", F.size("p").cast("long").alias("n_prompt_turns"), _side(F.col("p")).alias("prompt"),
        F.when(F.col("has_c"), _side(F.col("c"))).alias("chosen"), F.when(F.col("has_r"), _side(F.col("r"))).alias("rejected"),
        F.when(F.col("has_c"), _mask(F.col("c"))).alias("chosen_mask"),
        F.when(F.col("has_r"), _mask(F.col("r"))).alias("rejected_mask"))


def last_turn_swapped(conversations: DataFrame) -> DataFrame:
    """A pair for every conversation: itself, and itself with what its neighbour (2k and 2k+1) says from its last turn on."""
    c = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    last = c.groupBy(F.col("conv_id").alias("pair_id")).agg(F.max("turn").alias("last"))
    chosen = c.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    own = chosen.join(last, "pair_id").where(F.col("turn") < F.col("last"))
    theirs = c.select(F.expr("conv_id ^ 1").alias("pair_id"), "turn", "role", "text").join(last, "pair_id")
    columns = ["pair_id", F.lit("rejected").alias("side"), "turn", "role", "text"]
    return chosen.unionByName(own.select(*columns)).unionByName(
        theirs.where(F.col("turn") >= F.col("last")).select(*columns))
