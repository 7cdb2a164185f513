"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

Floating results that come out of sums are rounded to 9 places here (not in
the library) so two engines summing in different orders agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark import fixtures as FX
from prefspark.functions import extract as X
from prefspark.functions import text as T
from prefspark.operators import hooks, influence, judge, metrics, pairs, records
from prefspark.operators.rank import rank_by_score
from prefspark.operators.upsert import upsert_by_key
from prefspark.session import scratch_path
from prefspark.sources import io

Query = Callable[[SparkSession, str], DataFrame]


def _r9(c):
    return F.round(c, 9)


# --- 2.1 sources and sinks ---------------------------------------------------

def q_read_preferences(spark, sf):
    path = scratch_path(spark, "preferences")
    FX.fx_pref_long(spark, sf).write.parquet(path)
    msgs = io.read_preferences(spark, path, layout="long")
    prompt = msgs.groupBy("id").agg(
        T.turn_agg("user", "first", default=None, where=F.col("side") == "chosen").alias("prompt"))
    return msgs.join(prompt, "id").select(
        "id", "prompt", "side", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def q_limit_first(spark, sf):
    return io.limit_first(FX.fx_doc(spark, sf), 100, "id").select("id", "instruction", "chosen")


def _scores_with_gaps(spark, sf):
    sep = FX.fx_sep(spark, sf)
    return sep.select(
        "id",
        F.concat(F.lit("Summarise document "), F.col("id").cast("string")).alias("instruction"),
        F.lit(None).cast("string").alias("input"),
        F.col("text").alias("chosen"), F.col("text").alias("rejected"),
        F.when(F.col("id") % 7 == 0, F.lit(None).cast("double"))
        .otherwise((F.col("id") % 11).cast("double")).alias("score_datainf"))


def q_read_scores(spark, sf):
    path = scratch_path(spark, "score-file")
    _scores_with_gaps(spark, sf).write.json(path)
    return io.read_scores(spark, path)


def q_write_scores(spark, sf):
    path = scratch_path(spark, "scores")
    io.write_scores(FX.fx_scored(spark, sf), path)
    return io.read_scores(spark, path)


def q_write_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    io.write_pairs(pairs.symmetric_pairs(FX.fx_scored(spark, sf)), path)
    return io.read_pairs(spark, path)


def q_upsert_by_key(spark, sf):
    old, new = FX.fx_upsert(spark, sf)
    return upsert_by_key(old, new, "key")


def q_read_subject_results(spark, sf):
    path = scratch_path(spark, "subjects")
    io.write_subject_results(FX.fx_subj(spark, sf), path)
    return io.read_subject_results(spark, path, layout="long")


def q_read_subject_documents(spark, sf):
    path = scratch_path(spark, "subject-documents")
    FX.fx_subject_documents(spark, sf).repartition("label").write.partitionBy("label").text(path)
    acc = io.read_subject_results(spark, path, file_name="part-*")
    return acc.withColumn("label", F.regexp_replace("label", "^label=", ""))


def q_read_math_results(spark, sf):
    path = scratch_path(spark, "math")
    scored = metrics.score_math(FX.fx_math(spark, sf)).select(
        "idx", "question", "gold", "prediction", "correct", "generated_text")
    io.write_metrics(metrics.math_accuracy, scored, path)
    return io.read_math_results(spark, path)


def q_write_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    scored = metrics.score_math(FX.fx_math(spark, sf)).select(
        "idx", "question", "gold", "prediction", "correct", "generated_text")
    io.write_metrics(metrics.math_accuracy, scored, path)
    return spark.read.parquet(f"{path}/metrics")


def q_read_prompts(spark, sf):
    path = scratch_path(spark, "prompts")
    FX.fx_judge(spark, sf).select("idx", "instruction", F.col("reference_output").alias("output")).write.json(path)
    return io.read_prompts(spark, path)


# --- 2.2 projections and scalar functions ------------------------------------

def _turns(spark, sf, which, trim, default):
    conv = FX.table(spark, sf, "conversations")
    return conv.groupBy("conv_id").agg(
        T.turn_agg("user", which, trim, default).alias("user_text"),
        T.turn_agg("assistant", which, trim, default).alias("assistant_text"))


def q_first_turn_trimmed(spark, sf):
    return _turns(spark, sf, "first", True, "")


def q_last_turn_or_empty(spark, sf):
    return _turns(spark, sf, "last", False, "empty")


def q_first_turn_raw(spark, sf):
    return _turns(spark, sf, "first", False, "")


def q_last_message(spark, sf):
    conv = FX.table(spark, sf, "conversations")
    return conv.groupBy("conv_id").agg(T.turn_agg(None, "last", default=None).alias("content"))


def _nested_turns(spark, sf, which, trim, default):
    conv = FX.fx_conv(spark, sf)
    return conv.select("conv_id", T.turn_text("msgs", "user", which, trim, default).alias("user_text"),
                       T.turn_text("msgs", "assistant", which, trim, default).alias("assistant_text"))


def q_first_turn_trimmed_nested(spark, sf):
    return _nested_turns(spark, sf, "first", True, "")


def q_last_turn_or_empty_nested(spark, sf):
    return _nested_turns(spark, sf, "last", False, "empty")


def q_first_turn_raw_nested(spark, sf):
    return _nested_turns(spark, sf, "first", False, "")


def q_last_message_nested(spark, sf):
    return FX.fx_conv(spark, sf).select("conv_id", T.turn_text("msgs", None, "last", default=None).alias("content"))


def q_to_dpo_records_nested(spark, sf):
    return records.to_dpo_records(FX.fx_pref(spark, sf))


def q_conversion_report_nested(spark, sf):
    return records.conversion_report(FX.fx_pref(spark, sf))


def q_to_dpo_records(spark, sf):
    return records.to_dpo_records(FX.fx_pref_long(spark, sf))


def q_conversion_report(spark, sf):
    return records.conversion_report(FX.fx_pref_long(spark, sf))


def q_clean_text(spark, sf):
    return FX.fx_sep(spark, sf).select("id", T.clean_text("text").alias("text"))


def q_render_training_text(spark, sf):
    conv = FX.table(spark, sf, "conversations")
    t = conv.groupBy("conv_id").agg(T.turn_agg("user", "last", default=None).alias("u"),
                                    T.turn_agg("assistant", "last", default=None).alias("a"))
    return t.select("conv_id", T.render_training_text("u", "a").alias("text"))


def q_render_generation_prompt(spark, sf):
    p = q_read_prompts(spark, sf)
    return p.select("idx", T.render_generation_prompt("instruction").alias("prompt"))


def q_render_fewshot_prompt(spark, sf):
    m = FX.fx_math(spark, sf)
    return m.select("idx", T.render_fewshot_prompt("question").alias("prompt"))


def q_render_judge_prompt(spark, sf):
    j = judge.judge_prompts(judge.judge_rows(FX.fx_judge(spark, sf)))
    return j.select("idx", "judge_prompt")


def q_cut_at_stop(spark, sf):
    return FX.fx_math(spark, sf).select("idx", T.cut_at_stop("generated").alias("text"))


def q_extract_number(spark, sf):
    m = FX.fx_math(spark, sf)
    return m.select("idx", X.extract_number(T.cut_at_stop("generated")).alias("prediction"))


def q_extract_gold(spark, sf):
    return FX.fx_math(spark, sf).select("idx", X.extract_gold("answer").alias("gold"))


def q_parse_verdict(spark, sf):
    return FX.fx_judge(spark, sf).select("idx", X.parse_verdict("verdict_raw").alias("winner"))


def q_assign_positions(spark, sf):
    j = judge.judge_rows(FX.fx_judge(spark, sf))
    return j.select("idx", "model_is_1", "output_1", "output_2")


def q_resolve_win(spark, sf):
    return judge.judge_rows(FX.fx_judge(spark, sf)).select("idx", "winner", "model_win")


def q_length_features(spark, sf):
    j = judge.judge_rows(FX.fx_judge(spark, sf))
    return j.select("idx", "model_len", "ref_len", "length_diff", _r9("length_diff_sq").alias("length_diff_sq"),
                    _r9("log_model_len").alias("log_model_len"), _r9("log_ref_len").alias("log_ref_len"))


def q_short_subject(spark, sf):
    return FX.fx_subj(spark, sf).select("label", "task", T.short_subject("task").alias("subject"))


def q_preview(spark, sf):
    return FX.fx_doc(spark, sf).select("id", T.preview("chosen").alias("preview"))


# --- 2.3 influence -------------------------------------------------------------

def _grad_split(spark, sf):
    g = FX.fx_grad(spark, sf)
    return g.filter(F.col("split") == "train"), g.filter(F.col("split") == "val")


def q_mean_vector(spark, sf):
    _, val = _grad_split(spark, sf)
    return influence.mean_vector(val).select("pos", _r9("value").alias("value"))


def q_damping(spark, sf):
    train, _ = _grad_split(spark, sf)
    return influence.damping(train).select(_r9("lam").alias("lam"))


def q_influence_scores(spark, sf):
    train, val = _grad_split(spark, sf)
    return influence.influence_scores(train, val).select("id", _r9("score").alias("score"))


def q_influence_scores_blocked(spark, sf):
    s = influence.influence_scores_blocked(FX.fx_gradblk(spark, sf))
    return s.select("id", _r9("score").alias("score"))


def q_attach_scores(spark, sf):
    train, val = _grad_split(spark, sf)
    scores = influence.influence_scores(train, val)
    out = records.attach_scores(FX.fx_pref_long(spark, sf), scores)
    return out.withColumn("score_datainf", _r9("score_datainf"))


def q_attach_scores_nested(spark, sf):
    train, val = _grad_split(spark, sf)
    out = records.attach_scores(FX.fx_pref(spark, sf), influence.influence_scores(train, val))
    return out.withColumn("score_datainf", _r9("score_datainf"))


def q_top_k_helpful(spark, sf):
    return influence.top_k_helpful(FX.fx_scored(spark, sf))


def q_bottom_k_helpful(spark, sf):
    return influence.bottom_k_helpful(FX.fx_scored(spark, sf))


# --- 2.4 ranking and pairs -----------------------------------------------------

def q_rank_by_score(spark, sf):
    return rank_by_score(FX.fx_scored(spark, sf)).select("id", "rank")


def q_rank_by_score_ties(spark, sf):
    return rank_by_score(FX.fx_scored(spark, sf, ties=True)).select("id", "rank")


def q_symmetric_pairs(spark, sf):
    return pairs.symmetric_pairs(FX.fx_scored(spark, sf))


def q_next_neighbor_pairs(spark, sf):
    return pairs.next_neighbor_pairs(FX.fx_scored(spark, sf))


def q_self_pairs_random(spark, sf):
    return pairs.self_pairs_random(FX.fx_doc(spark, sf), seed=42)


def q_influence_pairs(spark, sf):
    from prefspark.plans.influence_pairs import influence_pairs_query
    return influence_pairs_query(spark, sf)


def q_pairs(spark, sf):
    return pairs.pairs(FX.fx_scored(spark, sf, ties=True), "both")


# --- 2.5 metrics ---------------------------------------------------------------

def _scored_math(spark, sf):
    return metrics.score_math(FX.fx_math(spark, sf)).select(
        "idx", "question", "gold", "prediction", "correct", "generated_text")


def q_score_math(spark, sf):
    return _scored_math(spark, sf)


def q_math_accuracy(spark, sf):
    return metrics.math_accuracy(_scored_math(spark, sf))


def q_math_summary(spark, sf):
    return metrics.math_summary(_scored_math(spark, sf))


def q_subject_macro_average(spark, sf):
    m = metrics.subject_macro_average(FX.fx_subj(spark, sf), FX.fx_subject_list())
    return m.select("label", _r9("avg_acc").alias("avg_acc"), "n_scored")


def q_subject_missing(spark, sf):
    return metrics.subject_missing(FX.fx_subj(spark, sf), FX.fx_subject_list())


def q_subject_report(spark, sf):
    r = metrics.subject_report(FX.fx_subj(spark, sf), FX.fx_subject_list())
    return r.select("label", "pos", "subject", _r9("acc_pct").alias("acc_pct"))


def q_compare_models(spark, sf):
    m = metrics.subject_macro_average(FX.fx_subj(spark, sf), FX.fx_subject_list())
    c = metrics.compare_models(m.withColumn("avg_acc", _r9("avg_acc")))
    return c


def q_choice_accuracy(spark, sf):
    return metrics.choice_accuracy(FX.fx_mc(spark, sf)).select("subject", "n_questions", "accuracy")


def q_true_mass(spark, sf):
    t = metrics.true_mass(FX.fx_mc(spark, sf))
    return t.select("subject", "n_questions", _r9("mc2").alias("mc2"))


def q_instruction_metrics(spark, sf):
    return metrics.instruction_metrics(FX.fx_inst(spark, sf))


def q_raw_winrate(spark, sf):
    return judge.raw_winrate(judge.judgments(FX.fx_judge(spark, sf)))


def q_lc_winrate(spark, sf):
    r = judge.lc_winrate(judge.judgments(FX.fx_judge(spark, sf)))
    return r.select("raw_winrate", F.round("lc_winrate", 6).alias("lc_winrate"), "n_examples", "n_wins")


def q_judging_report(spark, sf):
    return judge.judging_report(FX.fx_judge(spark, sf))


def q_resume_judging(spark, sf):
    prompts = FX.fx_judge(spark, sf)
    cache = FX.fx_judge_cache(spark, sf).select(*judge.JUDGMENT_COLS)
    return judge.resume_judging(prompts, cache)


# --- 2.6 hooks -----------------------------------------------------------------

def _stub_responder(batch):
    """A deterministic stand-in generator over whole texts: "<length> <text on one line>"."""
    return [None if t is None else f"{len(t)} " + t.replace("\n", " ") for t in batch]


def q_map_responses(spark, sf):
    d = FX.fx_doc(spark, sf).select("id", "chosen")
    return hooks.map_responses(d, _stub_responder, text_col="chosen", out_col="response",
                               batch_size=64).select("id", "response")


def stub_judge(prompt: str) -> str:
    """A deterministic stand-in judge: fails on some prompts, else answers by length."""
    n = len(prompt)
    if n % 7 == 0:
        raise RuntimeError("judge unavailable")
    return " 1\n" if n % 2 == 0 else "Response 2"


def q_map_verdicts(spark, sf):
    p = judge.judge_prompts(judge.judge_rows(FX.fx_judge(spark, sf)).drop("verdict_raw"))
    p = p.select("idx", "judge_prompt")
    return hooks.map_verdicts(p, stub_judge, backoff=lambda attempt: 0.0).select("idx", "verdict_raw")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
