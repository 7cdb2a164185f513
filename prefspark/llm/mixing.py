"""Mixing sources to target weights.

Each source gets a target number of words; a document of a source with
``target / source_size`` = r is emitted floor(r) times, plus once more when a
hash of its id and text falls under the fraction of r.

Targets are a water level: sources in code-point order (null last) weigh
3, 1, 2, 3, 1, 2, ...; ``share`` of all words is dealt by weight, but no source
gets more than ``cap`` times its own words, and what a capped source leaves is
dealt to the others by weight until none is above its cap.

Defined cases: a null text has 0 words; null sources form one source, last in
order; a source without words has target 0 and rate 0; documents without words
are emitted as their source's rate says; rows that repeat an id and a text
draw alike, so a rerun of any layout gives the same rows; an empty table gives
an empty table.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import small_or_not, unit_hash, without, word_count
from prefspark.session import materialize

WEIGHTS = (3, 1, 2)
SEED = "mix-1"
OUT = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size`` -> the same with ``target``.

    One row per source enters; the windows order that table, not the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    level_order = Window.orderBy("full_at", "source")
    w = sizes.select("source", "source_size", weight.alias("weight"))
    w = w.withColumn("most", cap * F.col("source_size").cast("double"))
    w = w.withColumn("full_at", F.col("most") / F.col("weight"))
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    after = level_order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn(
        "level",
        (share * F.sum("source_size").over(everything).cast("double")
         - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source, in the order in which they fill up, that the level leaves unfilled
    w = w.withColumn("open_level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level")))
                     .over(everything)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("open_level"), F.col("level")) * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
             weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target (of the source), copies and taken (words emitted)."""
    docs = without(docs, *OUT)
    sizes = (docs.groupBy(F.col(source).alias("source")).agg(F.sum(word_count(F.col(text))).alias("source_size")))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    t = small_or_not(targets).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = unit_hash(F.lit(seed), F.col(doc_id), F.col(text)) < rate - F.floor(rate)
    out = (docs.withColumn("size", word_count(F.col(text)))
           .join(t, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
           .withColumn("copies", (F.floor(rate) + extra.cast("long")).cast("long")))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as its plan says, with the columns of ``docs``."""
    keyed = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"),
                        F.col(source).alias("__src"), F.col(doc_id).alias("__id"))
    plan = mix_plan(keyed, "__text", "__src", "__id", **options).where("copies > 0")
    return plan.select("__row", F.explode(F.expr("array_repeat(0, int(copies))"))).select("__row.*")
