"""Flow A: gradients -> influence scores -> global rank -> preference pairs.

One scan of the validation gradients (mean vector) and one of the training
gradients (their products, from which damping and scores follow). Only the narrow (id, score) table
is ranked: ``pairs`` writes it once (float sums must not be recomputed
between the rank's counting and numbering passes) and the rank's extra
passes read just those columns. Texts join the ranked ids once, then one
shuffle builds every pair strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark import fixtures as FX
from prefspark.operators import influence, pairs


def influence_pairs(records: DataFrame, train: DataFrame, val: DataFrame,
                    strategy: str = "both", id_col: str = "id") -> DataFrame:
    """Pairs table (strategy, rank, instruction, input, chosen, rejected).

    ``records``: id, instruction, chosen (and optionally input).
    """
    s = influence.influence_scores(train, val, id_col=id_col).withColumn("_scored", F.lit(True))
    # Narrow: every record's id with its score; without a score row it is 0.0, an undefined score stays null.
    keys = records.select(id_col).join(s, id_col, "left").select(
        id_col, F.when(F.col("_scored"), F.col("score")).otherwise(F.lit(0.0)).alias("score_datainf"))
    ranked = pairs.ranked_records(records, keys, "score_datainf", id_col)
    return pairs.pairs(records, strategy, id_col=id_col, ranked=ranked)


def influence_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query over the given tables (embeddings as gradients, documents as texts).

    Every document is a record; one without a gradient row (train split) scores 0.0.
    """
    g = FX.fx_grad(spark, sf_dir)
    train = g.filter(F.col("split") == "train")
    val = g.filter(F.col("split") == "val")
    return influence_pairs(FX.fx_doc(spark, sf_dir), train, val, "both")
