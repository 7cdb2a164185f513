"""Answer and verdict extraction.

Patterns are Python-regex semantics; ``(?U)`` makes Java's ``\\d``/``\\b``
Unicode-aware the way Python's are for ``str`` patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def extract_number(col, mode: str = "exact") -> Column:
    """Predicted number from generated text.

    exact (default): drop every comma, keep the text after the last
    ``The answer is`` (all of it when absent), take the last match of the
    number pattern and strip dots at both ends; null when nothing matches.
    normalized: the sign is kept on integers too and the result is a
    canonical decimal text (``18.0`` and ``18`` agree).
    """
    if mode not in ("exact", "normalized"):
        raise ValueError("mode must be 'exact' or 'normalized'")
    t = F.replace(_c(col), F.lit(","), F.lit(""))
    t = F.substring_index(t, K.ANSWER_MARKER, -1)
    pattern = K.NUMBER_PATTERN if mode == "exact" else _SIGNED_NUMBER
    matches = F.regexp_extract_all(t, F.lit("(?U)" + pattern), 0)
    last = F.try_element_at(matches, F.lit(-1))
    if mode == "normalized":
        return _normalize_number(last)
    return F.btrim(last, F.lit("."))


def extract_gold(col, mode: str = "exact") -> Column:
    """Reference number after the first ``####``; null when absent.

    normalized: commas are removed first and a sign is allowed on integers.
    """
    if mode == "normalized":
        g = F.regexp_extract(F.replace(_c(col), F.lit(","), F.lit("")),
                             "(?U)####\\s*(" + _SIGNED_NUMBER + ")", 1)
        return _normalize_number(F.nullif(g, F.lit("")))
    g = F.regexp_extract(_c(col), "(?U)" + K.GOLD_PATTERN, 1)
    return F.nullif(g, F.lit(""))


_SIGNED_NUMBER = r"[-+]?(?:\d*\.\d+|\d+)"


def _normalize_number(col) -> Column:
    """Decimal text with sign kept, no leading or trailing zeros, any length (for mode='normalized')."""
    body = F.ltrim(col, F.lit("+-"))
    whole = F.ltrim(F.substring_index(body, ".", 1), F.lit("0"))
    part = F.when(F.contains(body, F.lit(".")), F.rtrim(F.substring_index(body, ".", -1), F.lit("0"))).otherwise(F.lit(""))
    text = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole),
                    F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))
    return F.when(F.startswith(col, F.lit("-")) & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)


def parse_verdict(col) -> Column:
    """First standalone ``1`` or ``2`` as an int; null when there is none."""
    v = F.regexp_extract(_c(col), "(?U)" + K.VERDICT_PATTERN, 1)
    return F.nullif(v, F.lit("")).cast("int")
