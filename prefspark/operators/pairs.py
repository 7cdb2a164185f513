"""Pair construction from a global rank.

D2/D3/D5 group ranked rows so that partners meet (mirror groups of two,
neighbour blocks of 64 ranks plus one boundary copy): one exchange for all
strategies, each text shuffled about once. D4 (a shift by m) uses blocks of
64 ranks with copies only where the partner's block differs. Group keys are
dense and groups bounded, so the exchange is even and never skews.
``_pair_up`` (one winner and one loser record per row) is the plain scheme
the tests compare both against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark import constants as K
from prefspark.functions.text import clean_text
from prefspark.operators.rank import global_rank, rank_by_score
from prefspark.session import materialize

_OUT = ["rank", "instruction", "input", "chosen", "rejected"]


def _pair_up(ranked: DataFrame, plans: list[tuple[str | None, Column]], rank_col: str = "rank",
             keep_id: str | None = None, clean: bool = True) -> DataFrame:
    """Pairs from one pass over the ranked rows and one shuffle (the plain scheme).

    For each (strategy, giver) plan every row emits a winner record for its
    own pair (pair = its rank) and a loser record for the pair that takes its
    text as rejected (pair = ``giver``). Grouping by (strategy, pair) meets
    exactly one of each; the ranked rows are read once whatever the number of
    strategies, instead of once per side of a self-join.
    """
    recs = []
    for strategy, giver in plans:
        tag = F.lit(strategy or "")
        win = F.struct(tag.alias("s"), F.col(rank_col).alias("p"), F.lit(True).alias("w"),
                       F.col("instruction").alias("i"), F.col("input").alias("n"),
                       F.col("chosen").alias("c"),
                       (F.col(keep_id) if keep_id else F.lit(None).cast("long")).alias("k"))
        lose = F.struct(tag.alias("s"), giver.alias("p"), F.lit(False).alias("w"),
                        F.lit(None).cast("string").alias("i"), F.lit(None).cast("string").alias("n"),
                        F.col("chosen").alias("c"), F.lit(None).cast("long").alias("k"))
        recs += [win, lose]
    x = ranked.select(F.explode(F.array(*recs)).alias("r")).select("r.*")
    # Exchange first: a pair has two records, so a map-side partial aggregate
    # (a full sort before the shuffle for string buffers) would combine nothing.
    g = x.repartition("s", "p").groupBy("s", "p").agg(
        F.first(F.when(F.col("w"), F.struct("i", "n", "c", "k")), ignorenulls=True).alias("win"),
        F.first(F.when(~F.col("w"), F.col("c")), ignorenulls=True).alias("rej"))
    tidy = clean_text if clean else (lambda c: F.col(c) if isinstance(c, str) else c)
    return g.select(
        F.col("s").alias("strategy"), F.col("p").alias("rank"),
        F.col("win.k").alias("_id"),
        tidy("win.i").alias("instruction"),
        tidy(F.coalesce("win.n", F.lit(""))).alias("input"),
        tidy("win.c").alias("chosen"),
        tidy("rej").alias("rejected"))


_BLOCK = 64  # ranks per neighbour-pair block (bounds the rows gathered per group)


def _pair_blocks(ranked: DataFrame, strategies: list[str], block: int = _BLOCK,
                 upper_half: bool = False) -> DataFrame:
    """Mirror and neighbour pairs with each text shuffled about once per strategy.

    Mirror pairs: ranks r and n-1-r meet in group least(r, n-1-r) (one or two
    rows). Neighbour pairs: ranks meet in blocks of ``block`` consecutive
    ranks, and the first rank of each block is also copied to the block
    before it (rank 0 to the last block, ordered after n-1), so rank r finds
    r+1 mod n in its own group. Groups hold at most block+1 rows, and all
    strategies share one exchange. ``upper_half`` emits only mirror pairs with
    r < n-1-r.
    """
    r, n = F.col("rank"), F.col("_n")
    emits = 2 * r + 1 < n if upper_half else F.lit(True)
    body = [r.alias("r"), F.col("instruction").alias("i"), F.col("input").alias("n"),
            F.col("chosen").alias("c")]
    recs = []
    if "symmetric" in strategies:
        recs.append(F.struct(F.lit("symmetric").alias("s"), F.least(r, n - 1 - r).alias("k"),
                             r.alias("v"), emits.alias("own"), *body))
    if "next_neighbor" in strategies:
        blk = F.floor(r / F.lit(block))
        last = F.floor((n - 1) / F.lit(block))
        recs.append(F.struct(F.lit("next_neighbor").alias("s"), blk.alias("k"), r.alias("v"),
                             F.lit(True).alias("own"), *body))
        recs.append(F.when(r % F.lit(block) == 0, F.struct(
            F.lit("next_neighbor").alias("s"),
            F.when(r == 0, last).otherwise(blk - 1).alias("k"),
            F.when(r == 0, n).otherwise(r).alias("v"), F.lit(False).alias("own"), *body)))
    x = (ranked.select(F.explode(F.array(*recs)).alias("e")).filter(F.col("e").isNotNull())
         .select("e.*"))
    g = (x.repartition("s", "k").groupBy("s", "k")
         .agg(F.array_sort(F.collect_list(F.struct("v", "own", "r", "i", "n", "c"))).alias("m")))
    m = F.col("m")

    def emit(e, idx):
        partner = F.when(F.col("s") == "symmetric", F.element_at(m, F.size(m) - idx)) \
            .otherwise(F.element_at(m, idx + 2))
        return F.when(e["own"], F.struct(e["r"].alias("rank"), e["i"].alias("instruction"),
                                         e["n"].alias("input"), e["c"].alias("chosen"),
                                         partner["c"].alias("rejected")))
    out = g.select("s", F.explode(F.transform(m, emit)).alias("o")).filter(F.col("o").isNotNull())
    return out.select(
        F.col("s").alias("strategy"), F.col("o.rank").alias("rank"),
        clean_text("o.instruction").alias("instruction"),
        clean_text(F.coalesce("o.input", F.lit(""))).alias("input"),
        clean_text("o.chosen").alias("chosen"), clean_text("o.rejected").alias("rejected"))


def _pair_shift(ranked: DataFrame, shift: Column, block: int = _BLOCK,
                keep_id: str | None = None) -> DataFrame:
    """Pairs (r, (r + shift) mod n) with each text shuffled once plus only the copies needed.

    Every row goes to its block of ``block`` consecutive ranks; it is copied
    to the block of the pair that takes its text only when that is another
    block (a fraction shift/block of the rows when shift < block, every row
    at worst). A group holds at most 2 x block rows; the partner is found in
    the group by rank.
    """
    r, n = F.col("rank"), F.col("_n")
    own_blk = F.floor(r / F.lit(block))
    target = F.floor(F.pmod(r - shift, n) / F.lit(block))
    kid = F.col(keep_id) if keep_id else F.lit(None).cast("long")
    body = [r.alias("r"), F.col("instruction").alias("i"), F.col("input").alias("n"),
            F.col("chosen").alias("c"), kid.alias("id"), n.alias("nn"), shift.alias("sh")]
    own = F.struct(own_blk.alias("k"), F.lit(True).alias("own"), *body)
    copy = F.when(target != own_blk, F.struct(target.alias("k"), F.lit(False).alias("own"), *body))
    x = (ranked.select(F.explode(F.array(own, copy)).alias("e")).filter(F.col("e").isNotNull())
         .select("e.*"))
    g = (x.repartition("k").groupBy("k")
         .agg(F.collect_list(F.struct("r", "own", "i", "n", "c", "id")).alias("m"),
              F.first("nn").alias("nn"), F.first("sh").alias("sh")))
    m = F.col("m")

    def emit(e):
        want = F.pmod(e["r"] + F.col("sh"), F.col("nn"))
        partner = F.element_at(F.filter(m, lambda y: y["r"] == want), 1)
        return F.when(e["own"], F.struct(e["r"].alias("rank"), e["id"].alias("_id"),
                                         e["i"].alias("instruction"), e["n"].alias("input"),
                                         e["c"].alias("chosen"), partner["c"].alias("rejected")))
    out = g.select(F.explode(F.transform(m, emit)).alias("o")).filter(F.col("o").isNotNull())
    return out.select("o.*")


def _mirror_giver() -> Column:
    # Row r's text is rejected for pair p with n-1-p = r.
    return F.col("_n") - 1 - F.col("rank")


def _next_giver() -> Column:
    # Row r's text is rejected for pair p with (p+1) mod n = r.
    return F.pmod(F.col("rank") - 1, F.col("_n"))


def require_unique(keys: DataFrame, col: str, name: str) -> None:
    """Raises, naming an id, if one is null or repeated: a repeated id would pair its rows with each other.

    One shuffle of the narrow key table; equal ids are summed before it.
    """
    odd = keys.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(col).isNull()).limit(1).collect()
    if odd:
        raise ValueError(f"{name} must be unique and not null: {odd[0][0]!r} occurs {odd[0][1]} times "
                         "(rows without such an id: by_position=True)")


def by_place(df: DataFrame) -> DataFrame:
    """``df``, written once, with its rows' places as ``_place``: ids for rows that have none of their own.

    Places ascend in the order of the rows, so that ties go to the earlier row.
    """
    return materialize(df.withColumn("_place", F.monotonically_increasing_id()), "placed")


def ranked_records(records: DataFrame, keys: DataFrame, score_col: str, id_col: str = "id") -> DataFrame:
    """Ranked rows of ``records`` (the wide side) by the scores in ``keys`` (id, score), for ``ranked=``."""
    return _ranked(records, score_col, id_col, keys=keys)


def _ranked(scored: DataFrame, score_col: str, id_col: str,
            materialize_keys: bool = True, keys: DataFrame | None = None) -> DataFrame:
    """Ranked rows with their payload.

    Only the narrow (id, score) table is ranked; with ``materialize_keys`` it
    is written once to the checkpoint folder, so the rank's counting passes
    read two columns and a score computed upstream is never re-evaluated
    between them. The payload joins the ranked ids once.
    """
    keys = (scored if keys is None else keys).select(F.col(id_col).alias("_id"), F.col(score_col).alias("_s"))
    if materialize_keys:
        keys = materialize(keys, "rank-keys")
    require_unique(keys, "_id", id_col)
    ranked = rank_by_score(keys, score_col="_s", id_col="_id", total_col="_n")
    payload = scored.select(F.col(id_col).alias("_id"), "instruction",
                            (F.col("input") if "input" in scored.columns else F.lit("")).alias("input"),
                            "chosen")
    return ranked.select("_id", "rank", "_n").join(payload, "_id")


def _ranked_rows(scored: DataFrame, score_col: str, id_col: str, by_position: bool) -> DataFrame:
    return _ranked(by_place(scored), score_col, "_place") if by_position else _ranked(scored, score_col, id_col)


def symmetric_pairs(scored: DataFrame, score_col: str = "score_datainf", id_col: str = "id",
                    keep: str = "all", ranked: DataFrame | None = None, by_position: bool = False) -> DataFrame:
    """Rank i (chosen) against rank n-1-i (its chosen text becomes rejected).

    keep="all" reproduces every i (the lower half has the worse text as
    chosen, an odd middle row pairs with itself); keep="upper_half" keeps
    only i < n-1-i.

    n rows give n pairs. Ids must be unique (checked); with ``by_position``
    rows go by their place instead, and ids may repeat, be null or be absent.
    """
    if keep not in ("all", "upper_half"):
        raise ValueError("keep must be 'all' or 'upper_half'")
    r = ranked if ranked is not None else _ranked_rows(scored, score_col, id_col, by_position)
    return _pair_blocks(r, ["symmetric"], upper_half=keep == "upper_half").select(*_OUT)


def next_neighbor_pairs(scored: DataFrame, score_col: str = "score_datainf", id_col: str = "id",
                        ranked: DataFrame | None = None, by_position: bool = False) -> DataFrame:
    """D3: rank i against rank (i+1) mod n (the last row wraps to the best); ids as in ``symmetric_pairs``."""
    r = ranked if ranked is not None else _ranked_rows(scored, score_col, id_col, by_position)
    return _pair_blocks(r, ["next_neighbor"]).select(*_OUT)


def pairs(scored: DataFrame, strategy: str = "both", score_col: str = "score_datainf",
          id_col: str = "id", ranked: DataFrame | None = None, by_position: bool = False) -> DataFrame:
    """One table with a ``strategy`` column; rank once, shuffle once for all strategies; ids as in ``symmetric_pairs``."""
    plans = {"symmetric": ["symmetric"], "next_neighbor": ["next_neighbor"],
             "both": ["symmetric", "next_neighbor"]}
    if strategy not in plans:
        raise ValueError("strategy must be symmetric, next_neighbor or both")
    r = ranked if ranked is not None else _ranked_rows(scored, score_col, id_col, by_position)
    return _pair_blocks(r, plans[strategy]).select("strategy", *_OUT)


def self_pair_order_keys(text_col: str = "chosen", seed: int = K.SELF_PAIR_SEED):
    """The seeded order of D4: md5 of "seed:text", all 32 hex digits, as three exact longs."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(text_col), F.lit(""))))
    return h, _hash_keys(h)


def _hash_keys(h: Column) -> list[Column]:
    return [F.conv(F.substring(h, 1, 13), 16, 10).cast("long"),
            F.conv(F.substring(h, 14, 13), 16, 10).cast("long"),
            F.conv(F.substring(h, 27, 6), 16, 10).cast("long")]


def self_pairs_random(df: DataFrame, seed: int = K.SELF_PAIR_SEED, text_col: str = "chosen",
                      id_col: str = "id", materialize_keys: bool = True, by_position: bool = False) -> DataFrame:
    """rejected = another row's chosen text, each used once, never the row's own text.

    Rows are ordered by (md5("seed:text"), id), so equal texts sit next to
    each other, and row r takes the text of row (r + m) mod n where m is the
    largest multiplicity of one text. When 2m <= n no row can meet its own
    text; when 2m > n no such assignment exists and the query raises.

    Texts are hashed once into a narrow (id, hash) table (written to the
    checkpoint folder unless ``materialize_keys`` is False); the rank and the
    multiplicity read only that table, and the texts join the ranked ids once.
    n rows give n pairs: ids must be unique (checked), or rows go
    ``by_position``, and the id column comes out as it was given.
    """
    if by_position:
        placed = by_place(df)
        out = self_pairs_random(placed, seed, text_col, "_place", materialize_keys)
        return out.join(placed.select("_place", id_col), "_place").select(id_col, "instruction", "input", "chosen", "rejected")
    h, _ = self_pair_order_keys(text_col, seed)
    keys = df.select(F.col(id_col).alias("_id"), h.alias("_h"))
    if materialize_keys:
        keys = materialize(keys, "self-pair-keys")
    require_unique(keys, "_id", id_col)
    ranked = global_rank(keys, _hash_keys(F.col("_h")), id_col="_id", rank_col="_r",
                         total_col="_n")
    # Largest multiplicity of one text: a partial aggregate on the 32-char hash.
    m = (keys.groupBy("_h").agg(F.count(F.lit(1)).alias("c"))
         .agg(F.max("c").alias("_m"))).scalar()  # scalar subquery, evaluated once
    x = ranked.withColumn("_m", m)
    shift = F.when(F.col("_m") * 2 > F.col("_n"), F.raise_error(F.concat(
        F.lit("self_pairs_random: a text fills more than half of the rows (m="),
        F.col("_m").cast("string"), F.lit(", n="), F.col("_n").cast("string"), F.lit(")")))
    ).otherwise(F.col("_m"))
    order = x.select("_id", F.col("_r").alias("rank"), "_n", shift.alias("_shift"))
    payload = df.select(F.col(id_col).alias("_id"), "instruction",
                        F.coalesce("input", F.lit("")).alias("input"),
                        F.col(text_col).alias("chosen"))
    wide = order.join(payload, "_id")
    out = _pair_shift(wide, F.col("_shift"), keep_id="_id")
    return out.select(F.col("_id").alias(id_col), "instruction", "input", "chosen", "rejected")
