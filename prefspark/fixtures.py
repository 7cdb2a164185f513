"""Test inputs derived from the given tables (the FX-* shapes of FIXTURES.md).

Each builder reads whole tables and uses only expressions that mean the same
in Spark and in the SQL oracle (``prefspark.oracle`` mirrors every one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _msg_list(entries):
    """array<struct<role, content>> from array<struct<..., role, text>> sorted upstream."""
    return F.transform(entries, lambda m: F.struct(m["role"].alias("role"),
                                                   m["text"].alias("content")))


def fx_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested layout, as stored: id k: chosen = conversation 2k, rejected = 2k+1, prompt.

    Gathers each conversation into an array (a stored record is one row).
    """
    conv = table(spark, sf_dir, "conversations")
    g = (conv.groupBy(F.expr("conv_id div 2").alias("id"))
         .agg(F.array_sort(F.collect_list(
             F.struct((F.col("conv_id") % 2).alias("side"), "turn", "role", "text"))).alias("m")))
    chosen = _msg_list(F.filter("m", lambda x: x["side"] == 0))
    rejected = _msg_list(F.filter("m", lambda x: x["side"] == 1))
    out = g.select("id", chosen.alias("chosen"), rejected.alias("rejected"))
    prompt = F.try_element_at(F.filter("chosen", lambda x: x["role"] == "user"), F.lit(1))["content"]
    return out.select("id", prompt.alias("prompt"), "chosen", "rejected")


def fx_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-msg: conv_id and its messages as one array, the way stored records hold them."""
    conv = table(spark, sf_dir, "conversations")
    g = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return g.select("conv_id", _msg_list(F.col("m")).alias("msgs"))


def fx_subject_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result document a label: {"results": {task: {"acc,none": acc}}} (a label has few tasks)."""
    entry = F.struct("task", F.struct(F.col("acc").alias("acc,none")))
    g = fx_subj(spark, sf_dir).groupBy("label").agg(F.map_from_entries(F.collect_list(entry)).alias("results"))
    return g.select("label", F.to_json(F.struct("results")).alias("value"))


def fx_pref_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-pref in the long layout: one row per message (id, side, turn, role, text)."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        F.expr("conv_id div 2").alias("id"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        "turn", "role", "text")


def fx_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with newlines turned into U+2028 (even ids) / U+2029 (odd ids); some null texts."""
    d = table(spark, sf_dir, "documents")
    text = (F.when(F.col("doc_id") % 50 == 0, F.lit(None).cast("string"))
            .when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\u2028")))
            .otherwise(F.replace("text", F.lit("\n"), F.lit("\u2029"))))
    return d.select(F.col("doc_id").alias("id"), text.alias("text"))


def fx_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split (val when id % 5 = 0), grad = embedding x (1 + id % 7); some train rows lack one."""
    e = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("vec_id") % 5 == 0, F.lit("val")).otherwise(F.lit("train"))
    scale = (F.col("vec_id") % 7 + 1).cast("double")
    grad = F.transform("embedding", lambda x: x.cast("double") * scale)
    grad = F.when((split == "train") & (F.col("vec_id") % 97 == 1),
                  F.lit(None).cast("array<double>")).otherwise(grad)
    return e.select(F.col("vec_id").alias("id"), split.alias("split"), grad.alias("grad"))


def fx_gradblk(spark: SparkSession, sf_dir: str, n_blocks: int = 4) -> DataFrame:
    """FX-grad cut into ``n_blocks`` equal slices; a missing gradient is one row with null vals."""
    g = fx_grad(spark, sf_dir)
    width = F.floor(F.size("grad") / n_blocks).cast("int")
    blocks = F.when(F.col("grad").isNull(),
                    F.array(F.lit(None).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    x = g.select("id", "split", "grad", F.explode(blocks).alias("block_id"))
    vals = F.when(F.col("block_id").isNull(), F.lit(None).cast("array<double>")).otherwise(
        F.slice("grad", F.col("block_id") * width + 1, width))
    return x.select("id", "split", "block_id", vals.alias("vals"))


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3 over FX-grad (train rows), score rounded to 9 places."""
    from prefspark.operators.influence import influence_scores
    g = fx_grad(spark, sf_dir)
    s = influence_scores(g.filter(F.col("split") == "train"), g.filter(F.col("split") == "val"))
    return s.select("id", F.round("score", 9).alias("score"))


def fx_scored(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    """Score rows: every document with its FX-grad score (0.0 without one); ``ties`` uses doc_id % 11 instead."""
    d = table(spark, sf_dir, "documents")
    s = fx_scores(spark, sf_dir)
    j = d.join(s, s["id"] == d["doc_id"], "left")
    score = (F.col("doc_id") % 11).cast("double") if ties else F.coalesce("score", F.lit(0.0))
    return j.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Summarise document "), F.col("doc_id").cast("string")).alias("instruction"),
        F.lit("").alias("input"),
        F.col("text").alias("chosen"),
        F.col("text").alias("rejected"),
        score.alias("score_datainf"))


def fx_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Summarise document "), F.col("doc_id").cast("string")).alias("instruction"),
        F.lit("").alias("input"),
        F.col("text").alias("chosen"))


_GENERATED = [
    "So 3 + 4. The answer is {k}. Q: next 99",
    "First 1,234 then 1,00{k}",
    "no numbers here",
    "The answer is -{k}",
    "about .{k} of it",
    "The answer is 7. No. The answer is {k}.0",
]


def fx_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, question, answer (#### gold), generated text (six shapes by o_orderkey % 6)."""
    o = table(spark, sf_dir, "orders")
    k = (F.col("o_orderkey") % 10).cast("string")
    gen = None
    for i, tpl in enumerate(_GENERATED):
        head, _, tail = tpl.partition("{k}")
        text = F.concat(F.lit(head), k, F.lit(tail)) if "{k}" in tpl else F.lit(tpl)
        cond = (F.col("o_orderkey") % 6) == i
        gen = F.when(cond, text) if gen is None else gen.when(cond, text)
    cust = (F.col("o_custkey") % 10).cast("string")
    answer = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("Work. #### -"), cust)) \
        .otherwise(F.concat(F.lit("Work. #### "), cust))
    return o.select(
        F.col("o_orderkey").alias("idx"),
        F.concat(F.lit("How many for "), F.col("o_custkey").cast("string"), F.lit("?")).alias("question"),
        answer.alias("answer"),
        gen.alias("generated"))


def fx_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, instruction, model_output, reference_output, verdict_raw.

    reference_output is the text of document (idx + 1) mod n (null when
    idx % 29 = 0): a self equi-join on the shifted id.
    """
    d = table(spark, sf_dir, "documents")
    n = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    a = d.select(
        F.col("doc_id").alias("idx"), F.col("text").alias("model_output"), "n_chars",
        F.pmod(F.col("doc_id") + 1, n).alias("_ref_id"))
    b = d.select(F.col("doc_id").alias("_rid"), F.col("text").alias("_rtext"))
    j = a.join(b, F.col("_ref_id") == F.col("_rid"), "left")
    idx = F.col("idx")
    ref = F.when(idx % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("_rtext"))
    verdict = (F.when(idx % 31 == 0, F.lit(None).cast("string"))
               .when(idx % 11 == 0, F.lit("unclear"))
               .when(idx % 11 == 1, F.lit("12"))
               .when(idx % 11 == 2, F.lit("both 2 or 1"))
               .when(F.col("n_chars") % 2 == 0, F.lit("Response 1"))
               .otherwise(F.lit("2.")))
    return j.select(
        idx,
        F.concat(F.lit("Summarise document "), idx.cast("string")).alias("instruction"),
        F.col("model_output"), ref.alias("reference_output"), verdict.alias("verdict_raw"))


def fx_subj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label (lang), task (mmlu_ + source), acc = avg(quality); ('fr','mmlu_src3') is null."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    g = (d.join(lab, "doc_id")
         .groupBy(F.col("lang").alias("label"),
                  F.concat(F.lit("mmlu_"), F.col("source")).alias("task"))
         .agg(F.avg("quality").alias("acc")))
    acc = F.when((F.col("label") == "fr") & (F.col("task") == "mmlu_src3"),
                 F.lit(None).cast("double")).otherwise(F.col("acc"))
    return g.select("label", "task", acc.alias("acc"))


def fx_subject_list() -> list[str]:
    """Canonical list for FX-subj: mmlu_src0..19 without src5, plus one absent subject."""
    return [f"mmlu_src{i}" for i in range(20) if i != 5] + ["mmlu_absent"]


def fx_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, qid, choice, ll, is_true, gold (choice with least (o_orderdate, o_orderkey))."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    rows = j.select(
        F.col("c_mktsegment").alias("subject"), F.col("o_custkey").alias("qid"),
        F.col("o_orderkey").alias("choice"),
        (-F.col("o_totalprice") / F.lit(100000.0)).alias("ll"),
        (F.col("o_orderstatus") == "F").alias("is_true"),
        F.col("o_orderdate"))
    gold = rows.groupBy("qid").agg(
        F.min_by("choice", F.struct("o_orderdate", "choice")).alias("gold"))
    return rows.join(gold, "qid").select("subject", "qid", "choice", "ll", "is_true", "gold")


def fx_inst(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    strict = F.col("o_orderstatus") != "P"
    return o.select(
        F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("inst_id"),
        strict.alias("strict"), (strict | (F.col("o_orderkey") % 2 == 0)).alias("loose"))


def fx_upsert(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """old: orders with status F or O; new: orders with status O or P, marked 'U'.

    So O keys are replaced, P keys are added and F keys are kept.
    """
    o = table(spark, sf_dir, "orders")
    old = o.filter(F.col("o_orderstatus").isin("F", "O")).select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"))
    new = o.filter(F.col("o_orderstatus").isin("O", "P")).select(
        F.col("o_orderkey").alias("key"), F.lit("U").alias("status"),
        F.col("o_totalprice").alias("price"))
    return old, new


def fx_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-judge after verdict parsing, position resolution and length features."""
    from prefspark.operators.judge import judge_rows
    return judge_rows(fx_judge(spark, sf_dir))


def fx_judge_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = fx_judged(spark, sf_dir)
    return j.filter((F.col("idx") % 3 == 0) & F.col("winner").isNotNull())


__all__ = [n for n in dir() if n.startswith("fx_")] + ["table"]
