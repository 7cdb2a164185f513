"""String and message-list expressions.

All of these are built-in Spark expressions and stay JVM-side. The string
functions are part of the surrounding generated code; ``filter`` with a lambda
(in ``turn_text``) is evaluated outside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: removes all Unicode whitespace and \\x1c-\\x1f at both ends, in linear time."""
    return F.btrim(_c(col), F.lit(K.PY_WHITESPACE))


def turn_text(msgs, role: str | None, which: str = "first", trim: bool = False,
              default: str | None = "") -> Column:
    """Content of the first/last message of ``role`` (any role when None).

    ``which``: "first" or "last". ``trim`` applies Python-style strip to the
    found content. ``default`` is returned when no message matches (or the
    list itself is null), and for an empty content. Uses ``try_element_at`` so an empty match is null
    rather than an ANSI error.
    """
    arr = _c(msgs)
    if role is not None:
        arr = F.filter(arr, lambda m: m["role"] == F.lit(role))
    idx = F.lit(1) if which == "first" else F.lit(-1)
    if which not in ("first", "last"):
        raise ValueError("which must be 'first' or 'last'")
    return _or_default(F.try_element_at(arr, idx)["content"], trim, default)


def _or_default(content: Column, trim: bool, default: str | None) -> Column:
    if trim:
        content = py_strip(content)
    if default is not None:
        content = F.coalesce(F.nullif(content, F.lit("")), F.lit(default))
    return content


def turn_agg(role: str | None, which: str = "first", trim: bool = False,
             default: str | None = "", where=None, text_col: str = "text",
             role_col: str = "role", order_col: str = "turn") -> Column:
    """P1 over long-form messages: an aggregate for use in ``groupBy(record).agg(...)``.

    Picks the text of the first/last message (by ``order_col``) whose role
    is ``role`` (any role when None) and that satisfies ``where``. min_by /
    max_by skip rows whose ordering is null and combine map-side, so a
    record with a huge number of messages never has to sit in one row.
    """
    if which not in ("first", "last"):
        raise ValueError("which must be 'first' or 'last'")
    cond = F.lit(True) if role is None else (F.col(role_col) == F.lit(role))
    if where is not None:
        cond = cond & where
    order = F.when(cond, F.col(order_col))
    pick = F.min_by if which == "first" else F.max_by
    return _or_default(pick(F.col(text_col), order), trim, default)


def clean_text(col) -> Column:
    """Line and paragraph separators (U+2028, U+2029) become spaces; null stays null."""
    # Two literal replaces: far cheaper on long texts than translate's per-character lookup.
    one = F.replace(_c(col), F.lit("\u2028"), F.lit(" "))
    return F.replace(one, F.lit("\u2029"), F.lit(" "))


def _or_empty_marker(col) -> Column:
    c = _c(col)
    return F.when(c.isNull() | (c == F.lit("")), F.lit(K.EMPTY_TURN)).otherwise(c)


def render_training_text(user, assistant) -> Column:
    """Two-turn chat text; an empty or missing side becomes the literal ``empty``."""
    return F.concat(
        F.lit(K.USER_HEADER), _or_empty_marker(user), F.lit(K.END_OF_TURN),
        F.lit(K.ASSISTANT_HEADER), _or_empty_marker(assistant), F.lit(K.END_OF_TURN),
    )


def render_generation_prompt(instruction) -> Column:
    """Begin-of-text, the stripped user turn, then an open assistant header."""
    return F.concat(
        F.lit(K.BEGIN_OF_TEXT), F.lit(K.USER_HEADER), py_strip(instruction),
        F.lit(K.END_OF_TURN), F.lit(K.ASSISTANT_HEADER),
    )


def render_fewshot_prompt(question) -> Column:
    """Two worked examples followed by the question."""
    return F.concat(F.lit(K.FEWSHOT_PREFIX), _c(question), F.lit(K.FEWSHOT_SUFFIX))


def render_judge_prompt(instruction, output_1, output_2) -> Column:
    """Fill the judge template by concatenating literal segments.

    Concatenation (not chained replace) means an output that itself contains
    a slot marker is never substituted twice.
    """
    return F.concat(
        F.lit(K.JUDGE_HEAD), _c(instruction), F.lit(K.JUDGE_MID_1), _c(output_1),
        F.lit(K.JUDGE_MID_2), _c(output_2), F.lit(K.JUDGE_TAIL),
    )


def cut_at_stop(col, stop: str = K.STOP_MARKER) -> Column:
    """Text before the first stop marker, stripped."""
    return py_strip(F.substring_index(_c(col), stop, 1))


def short_subject(col) -> Column:
    """Remove every ``mmlu_`` substring."""
    return F.replace(_c(col), F.lit(K.SUBJECT_PREFIX), F.lit(""))


def preview(col, n: int = K.PREVIEW_CHARS) -> Column:
    """First ``n`` code points."""
    return F.substring(_c(col), 1, n)
