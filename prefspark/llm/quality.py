"""Quality rules with host-level verdicts.

1. Every document gets counts (words, symbols, repeated lines, repeated words)
   and the rules it fails.
2. Failures are summed per host, and each host's failure rate is shrunk with a
   beta prior that is fitted by moments to the rates of all hosts: a host with
   few documents stays near the corpus rate, one with many keeps its own.
3. A host is rejected if its shrunk rate lies above the prior's mean by more
   than ``DEVIATIONS`` of its standard deviations, a limit that is kept
   between ``LEAST_LIMIT`` and ``MOST_LIMIT``; the verdict is joined back to
   its documents.

A document is kept if it passes the base rules and its host is not rejected.

Defined cases: a null or empty text has no words and fails the base rules;
null hosts are one host of their own; repeated rows count as often as they
occur and share one verdict; an empty table gives an empty table.  Input
columns named like an output column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import release_memory, small_or_not, text_slices, without
from prefspark.session import materialize

# The rules' thresholds.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINES_PERCENT = 30
# A host is rejected if more fail than at most hosts by far; never below the first limit, always above the second.
LEAST_LIMIT, MOST_LIMIT, DEVIATIONS = 0.5, 0.75, 3.0
SYMBOLS = "#*$%&|<>"

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "rule_failed",
       "host_docs", "host_failed", "host_rate", "host_kept", "kept")


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    index: dict = {}
    w = np.fromiter((index.setdefault(x, len(index)) for x in words), dtype=np.int64, count=len(words))
    pairs = np.unique(w[:-1] * len(index) + w[1:], return_inverse=True)[1]  # numbers of two-word windows
    _, window, times = np.unique(pairs[:-1] * len(index) + w[2:], return_inverse=True, return_counts=True)
    hit, inside = times[window] > 1, np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k:len(hit) + k] |= hit
    return int(inside.sum())


def stats_of(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of one text."""
    text = text or ""
    words = text.encode().split()  # of bytes: at ASCII white space only
    space = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return (len(words), len(text) - space, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def document_rules(docs: DataFrame, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with the counts, base_failed and rule_failed (any rule); the text itself only if it is to be carried."""
    docs = without(docs, *OUT)
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    at = docs.columns.index(text)
    kept = [k for k, c in enumerate(docs.columns) if carry_text or k != at]
    counts = [c.split()[0] for c in STATS.split(", ")]
    schema = T.StructType([docs.schema[k] for k in kept] + [T.StructField(c, T.LongType()) for c in counts])

    def count(batches):
        for b in (x for batch in batches for x in text_slices(batch, at)):
            stats = np.array([stats_of(t) for t in b.column(at).to_pylist()], dtype=np.int64).reshape(-1, len(counts))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *[pa.array(c) for c in stats.T]], names=schema.fieldNames())
        release_memory()

    out = docs.mapInArrow(count, schema)
    base = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    more = ((100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines")))
    return out.withColumn("base_failed", base).withColumn("rule_failed", base | more)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by moments over ``host_docs, host_failed``; three sums reach the driver."""
    rate = F.col("host_failed") / F.col("host_docs")
    r = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("x"), F.count("*").alias("k"),
                  F.sum(F.col("host_docs") * rate * rate).alias("sq")).first()
    if not r["n"]:
        return 1.0, 1.0
    mean = min(max(r["x"] / r["n"], 1e-6), 1 - 1e-6)
    between = r["sq"] / r["n"] - (r["x"] / r["n"]) ** 2  # of the rates, weighted by documents
    chance = mean * (1 - mean) * r["k"] / r["n"]  # what sampling alone would give
    spread = max(between - chance, 1e-9)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 10_000.0)
    return mean * weight, (1 - mean) * weight


def rate_limit(alpha: float, beta: float, least: float = LEAST_LIMIT) -> float:
    """The shrunk rate above which a host is rejected: far above the hosts' common rate, from ``least`` to ``MOST_LIMIT``."""
    mean = alpha / (alpha + beta)
    return min(max(least, mean + DEVIATIONS * math.sqrt(mean * (1 - mean) / (alpha + beta + 1))), max(least, MOST_LIMIT))


def host_verdicts(checked: DataFrame, host: str = "source", least_limit: float = LEAST_LIMIT) -> DataFrame:
    """One row per host: __host, host_docs, host_failed, host_rate (shrunk), host_kept."""
    hosts = materialize(
        checked.groupBy(F.col(f"`{host}`").alias("__host"))
        .agg(F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("host_failed") + alpha) / (F.col("host_docs") + (alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", rate <= rate_limit(alpha, beta, least_limit))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", least_limit: float = LEAST_LIMIT,
                  carry_text: bool = True) -> DataFrame:
    """``docs`` with counts, rule results, its host's figures and ``kept``; without the text if it is not to be carried.

    Without the texts the counted rows are written once and read by both the
    host sums and the result.  Texts that are carried are not written for that:
    they are counted again on their way into the result.
    """
    checked = document_rules(docs, text, carry_text)
    narrow = materialize(checked.select(F.col(f"`{host}`"), "rule_failed") if carry_text else checked, "rules")
    checked = checked if carry_text else narrow
    verdicts = small_or_not(host_verdicts(narrow, host, least_limit))
    out = checked.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    text, host = options.pop("text", "text"), options.pop("host", "source")
    names = [f"__c{k}" for k in range(len(docs.columns))]  # no name of the docs can clash with a count
    found = quality_rules(docs.toDF(*names), names[docs.columns.index(text)], names[docs.columns.index(host)], **options)
    return found.where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
