"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Everything is DataFrame functions.  A pattern's matches come from
``regexp_extract_all`` and their places from the lengths of what ``split``
leaves between them (code points).  Then each kind has

* a validator: number of digits, parts of an address, Luhn or mod-97 checksum;
* a score for a valid match, to which a context word within ``BEFORE`` code
  points before or ``AFTER`` after it adds ``CONTEXT``.

Email, ip, card (16-19 digits) and phone are kept whenever they are valid;
iban, ssn and short_card (13-15 digits) need a score of ``KEEP``: a valid IBAN
has it by its checksum, the other two only with a context word.  A phone number
and a card side by side make one match with too many digits, which is dropped;
run_card and run_phone look for the usual groupings inside such matches.

The patterns use possessive repeats: they match the same text as their plain
forms, but in linear time and without recursion on very long runs.

Defined cases: a null text counts as empty and stays null when redacted; spans
of different kinds may overlap and are all reported (redaction merges them);
an empty table gives an empty table.  Input columns named like an output
column are replaced.  A very long text takes time in proportion to its length
and its number of matches (redaction reads it once more for every ``GROUP``
spans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import bound, in_groups, states_before, without

# Patterns, in the order in which kinds are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
    "run_card": r"(?<![A-Za-z0-9_])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![A-Za-z0-9_])",
    "run_phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![A-Za-z0-9_])",
}
# Kinds tried only where a match of another kind has more digits than that kind may have.
INSIDE = {"run_card": ("card", 19), "run_phone": ("phone", 15)}
# What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "short_card", "run_card", "run_phone")
# Scores of valid matches, and lower-case context words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "short_card": 0.4,
          "run_card": 0.8, "run_phone": 0.6}
WORDS = {
    "email": "mail|email|e-mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|telephone",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|security number",
    "short_card": "card|visa|amex|american express|diners|credit|debit|karte|carte|tarjeta",
}
WORDS |= {"run_card": WORDS["card"], "run_phone": WORDS["phone"]}
KEEP, CONTEXT, BEFORE, AFTER = 0.6, 0.3, 40, 20
CHUNK = 4_096  # code points
OUT = ("pii",)


def _find(text: Column, kind: str) -> Column:
    """A kind's matches in order; none or null where there is none."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind in INSIDE:
        other, most = INSIDE[kind]
        return F.when(F.exists(f"__f_{other}", lambda v: F.length(_digits(v)) > most), found)
    return F.when(text.contains(NEEDS[kind]), found) if kind in NEEDS else found


def _places(text: Column, found: Column, kind: str) -> Column:
    """array<struct<start,end,value>> of matches (code points, end exclusive)."""
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), m.alias("value")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def span(x, before):
        return F.struct((before + x["gap"]).alias("start"), (before + x["gap"] + x["long"]).alias("end"), x["value"].alias("value"))

    def placed(all_parts):
        return F.zip_with(all_parts, states_before(all_parts, lambda x: x["gap"] + x["long"], lambda a, n: a + n), span)

    return F.when(F.size(found) > 0, bound(parts, placed)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits are right: its country and check digits go last, letters count 10 to 35."""
    compact = F.replace(value, F.lit(" "))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _ip_part(part: Column) -> Column:
    """At most 255, whatever its leading zeros."""
    p = F.ltrim(part, F.lit("0"))
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _ip_part)
    if kind in ("card", "run_card"):
        return F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)
    if kind == "short_card":
        return F.when(n.between(13, 15), luhn(_digits(value))).otherwise(False)
    if kind in ("phone", "run_phone"):
        return n.between(8, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _chunks(text: Column) -> Column:
    """A text as chunks of ``CHUNK`` code points, so that looking around a span does not read the text from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _from_chunks(chunks: Column, first: Column, long: Column) -> Column:
    """``long`` (up to CHUNK) code points from place ``first`` on."""
    k = F.floor(first / CHUNK).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit("")))
    return F.substring(two, first - k * CHUNK + 1, long)


def _scored(chunks: Column, spans: Column, kind: str) -> Column:
    """The valid spans of a kind with their scores; those below KEEP go, except of the base kinds."""
    def score(s):
        first = F.greatest(s["start"] - BEFORE, F.lit(0))
        around = F.concat(_from_chunks(chunks, first, s["start"] - first), F.lit(" "),
                          _from_chunks(chunks, s["end"], F.lit(AFTER)))
        near = F.lower(around).rlike(rf"(?<![a-z0-9_])(?:{WORDS[kind]})(?![a-z0-9_])")
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        s["value"].alias("value"),
                        F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, CONTEXT).otherwise(0.0)).alias("score"))

    out = F.transform(F.filter(spans, lambda s: _valid(kind, s["value"])), score)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= KEEP)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array<struct<kind,start,end,value,score>>, by kind as listed, then start."""
    docs, t = without(docs, *OUT), F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"__f_{k}": _find(t, k) for k in PATTERNS if k not in INSIDE})
    out = out.withColumns({f"__f_{k}": _find(t, k) for k in INSIDE})
    out = out.withColumns({f"__p_{k}": _places(t, F.coalesce(F.col(f"__f_{k}"), F.expr("cast(array() as array<string>)")),
                                               k) for k in PATTERNS})
    out = out.withColumn("__chunks", _chunks(t))
    each = [_scored(F.col("__chunks"), F.col(f"__p_{'card' if k == 'short_card' else k}"), k) for k in KINDS]
    return out.withColumn("pii", F.concat(*each)).select(*[F.col(f"`{c}`") for c in docs.columns], "pii")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def label(kind: Column) -> Column:
    """What a span is replaced by: the upper-case kind, without how it was found."""
    return F.upper(F.regexp_replace(kind, "^(run|short)_", ""))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    # up to where the text has been handled before each span; the groups of spans each have a piece of the text
    def items(spans_in_order):
        done = states_before(spans_in_order, lambda s: s["end"], lambda a, end: F.greatest(a, end))
        return F.zip_with(spans_in_order, done, lambda s, at: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), at.alias("at")))

    last = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))

    def group(g):
        first = F.element_at(g, 1)["at"]
        upto = F.aggregate(g, F.lit(0), lambda a, s: F.greatest(a, s["at"], s["end"]))
        return bound(F.struct(first.alias("first"), F.substring(text, first + 1, upto - first).alias("text")),
                     lambda piece: F.array_join(F.transform(
                         F.filter(g, lambda s: s["start"] >= s["at"]),
                         lambda s: F.concat(F.substring(piece["text"], s["at"] - piece["first"] + 1, s["start"] - s["at"]),
                                            F.lit("["), label(s["kind"]), F.lit("]"))), ""))

    whole = F.concat(F.array_join(F.transform(in_groups(bound(order, items)), group), ""), F.substring(text, last + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its own columns, personal data in ``text`` replaced."""
    keyed = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    found = find_pii(keyed, "__text")
    return found.select(F.col("__row").withField(f"`{text}`", redacted(F.col("__text"), F.col("pii")))
                        .alias("__row")).select("__row.*")
