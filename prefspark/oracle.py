"""The same queries as DuckDB SQL over the given tables (the correctness oracle).

Fixture CTEs mirror ``prefspark.fixtures``; literals come from
``prefspark.constants`` so both sides use identical texts.
"""

from __future__ import annotations

from prefspark import constants as K
from prefspark.fixtures import fx_subject_list

# --- SQL helpers -------------------------------------------------------------

_WS_RE2 = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS_RE2}+|{_WS_RE2}+$', '', 'g')"


def clean(e: str) -> str:
    return f"replace(replace({e}, chr(8232), ' '), chr(8233), ' ')"


def empty_marker(e: str) -> str:
    return f"(CASE WHEN {e} IS NULL OR {e} = '' THEN {lit(K.EMPTY_TURN)} ELSE {e} END)"


def r9(e: str) -> str:
    return f"round({e}, 9)"


def extract_number(e: str) -> str:
    t = f"string_split(replace({e}, ',', ''), {lit(K.ANSWER_MARKER)})"
    last = f"list_last({t})"
    m = f"regexp_extract_all({last}, {lit(K.NUMBER_PATTERN)}, 0)"
    return f"trim({m}[-1], '.')"


def extract_gold(e: str) -> str:
    return f"nullif(regexp_extract({e}, {lit(K.GOLD_PATTERN)}, 1), '')"


def parse_verdict(e: str) -> str:
    return f"CAST(nullif(regexp_extract({e}, {lit(K.VERDICT_PATTERN)}, 1), '') AS INTEGER)"


def cut_at_stop(e: str) -> str:
    return strip(f"split_part({e}, {lit(K.STOP_MARKER)}, 1)")


def judge_prompt(i: str, o1: str, o2: str) -> str:
    return (f"{lit(K.JUDGE_HEAD)} || {i} || {lit(K.JUDGE_MID_1)} || {o1} || "
            f"{lit(K.JUDGE_MID_2)} || {o2} || {lit(K.JUDGE_TAIL)}")


# --- fixtures ------------------------------------------------------------------

FX_PREF_MSGS = """fx_pref_msgs AS (
  SELECT conv_id // 2 AS id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
         turn AS pos,
         role, text AS content, turn, conv_id
  FROM conversations)"""

FX_PREF_FLAT = FX_PREF_MSGS + """,
fx_pref_prompt AS (
  SELECT conv_id // 2 AS id, first(text ORDER BY turn) FILTER (WHERE role = 'user') AS prompt
  FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id // 2),
fx_pref_ids AS (SELECT DISTINCT conv_id // 2 AS id FROM conversations)"""


def _pref_turn(side: str, role: str, trim: bool) -> str:
    c = "content"
    first = f"first({c} ORDER BY pos) FILTER (WHERE side = '{side}' AND role = '{role}')"
    if trim:
        first = strip(first)
    return f"coalesce({first}, '')"


FX_SEP = """fx_sep AS (
  SELECT doc_id AS id,
         CASE WHEN doc_id % 50 = 0 THEN NULL
              WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(8232))
              ELSE replace(text, chr(10), chr(8233)) END AS text
  FROM documents)"""

FX_GRAD = """fx_grad AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split,
         CASE WHEN vec_id % 5 <> 0 AND vec_id % 97 = 1 THEN NULL
              ELSE list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7 + 1)::DOUBLE) END AS grad
  FROM embeddings),
fx_mv AS (
  SELECT pos, avg(x) AS value FROM (
    SELECT unnest(range(len(grad))) AS pos, unnest(grad) AS x
    FROM fx_grad WHERE split = 'val' AND grad IS NOT NULL) GROUP BY pos),
fx_v AS (SELECT list(value ORDER BY pos) AS v FROM fx_mv),
fx_lam AS (SELECT avg(list_dot_product(grad, grad)) / 1000.0::DOUBLE AS lam
           FROM fx_grad WHERE split = 'train' AND grad IS NOT NULL),
fx_scores_raw AS (
  SELECT id, list_dot_product(grad, v) / (lam + list_dot_product(grad, grad)) AS score
  FROM fx_grad, fx_v, fx_lam WHERE split = 'train' AND grad IS NOT NULL
  UNION ALL
  SELECT id, 0.0::DOUBLE AS score FROM fx_grad WHERE split = 'train' AND grad IS NULL),
fx_scores AS (SELECT id, round(score, 9) AS score FROM fx_scores_raw)"""

FX_SCORED = FX_GRAD + """,
fx_scored AS (
  SELECT d.doc_id AS id, 'Summarise document ' || d.doc_id AS instruction, '' AS input,
         d.text AS chosen, d.text AS rejected, coalesce(s.score, 0.0::DOUBLE) AS score_datainf
  FROM documents d LEFT JOIN fx_scores s ON d.doc_id = s.id),
fx_scored_ties AS (
  SELECT id, instruction, input, chosen, rejected, CAST(id % 11 AS DOUBLE) AS score_datainf
  FROM fx_scored)"""

FX_DOC = """fx_doc AS (
  SELECT doc_id AS id, 'Summarise document ' || doc_id AS instruction, '' AS input, text AS chosen
  FROM documents)"""

_K = "CAST(o_orderkey % 10 AS VARCHAR)"
FX_MATH = f"""fx_math AS (
  SELECT o_orderkey AS idx, 'How many for ' || o_custkey || '?' AS question,
         CASE WHEN o_orderkey % 13 = 0 THEN 'Work. #### -' || (o_custkey % 10)
              ELSE 'Work. #### ' || (o_custkey % 10) END AS answer,
         CASE o_orderkey % 6
           WHEN 0 THEN 'So 3 + 4. The answer is ' || {_K} || '. Q: next 99'
           WHEN 1 THEN 'First 1,234 then 1,00' || {_K}
           WHEN 2 THEN 'no numbers here'
           WHEN 3 THEN 'The answer is -' || {_K}
           WHEN 4 THEN 'about .' || {_K} || ' of it'
           ELSE 'The answer is 7. No. The answer is ' || {_K} || '.0' END AS generated
  FROM orders),
fx_math_scored AS (
  SELECT idx, question, {extract_gold('answer')} AS gold,
         {extract_number(cut_at_stop('generated'))} AS prediction,
         ({extract_number(cut_at_stop('generated'))}) IS NOT DISTINCT FROM ({extract_gold('answer')}) AS correct,
         {cut_at_stop('generated')} AS generated_text
  FROM fx_math)"""

FX_JUDGE = f"""fx_judge AS (
  SELECT a.doc_id AS idx, 'Summarise document ' || a.doc_id AS instruction,
         a.text AS model_output,
         CASE WHEN a.doc_id % 29 = 0 THEN NULL ELSE b.text END AS reference_output,
         CASE WHEN a.doc_id % 31 = 0 THEN NULL
              WHEN a.doc_id % 11 = 0 THEN 'unclear'
              WHEN a.doc_id % 11 = 1 THEN '12'
              WHEN a.doc_id % 11 = 2 THEN 'both 2 or 1'
              WHEN a.n_chars % 2 = 0 THEN 'Response 1'
              ELSE '2.' END AS verdict_raw
  FROM documents a CROSS JOIN (SELECT count(*) AS n FROM documents) c
  LEFT JOIN documents b ON b.doc_id = (a.doc_id + 1) % c.n),
fx_judge_rows AS (
  SELECT idx, instruction, coalesce(model_output, '') AS model_output,
         coalesce(reference_output, '') AS reference_output, verdict_raw,
         idx % 2 = 0 AS model_is_1,
         {parse_verdict('verdict_raw')} AS winner
  FROM fx_judge),
fx_judged_all AS (
  SELECT *,
         CASE WHEN model_is_1 THEN model_output ELSE reference_output END AS output_1,
         CASE WHEN model_is_1 THEN reference_output ELSE model_output END AS output_2,
         CASE WHEN model_is_1 THEN winner = 1 ELSE winner = 2 END AS model_win,
         length(model_output) AS model_len, length(reference_output) AS ref_len,
         length(model_output) - length(reference_output) AS length_diff
  FROM fx_judge_rows),
fx_judged AS (
  SELECT idx, instruction, model_output, reference_output, winner, model_win,
         model_len, ref_len, length_diff
  FROM fx_judged_all WHERE winner IS NOT NULL)"""

FX_SUBJ = """fx_subj AS (
  SELECT d.lang AS label, 'mmlu_' || d.source AS task,
         CASE WHEN d.lang = 'fr' AND 'mmlu_' || d.source = 'mmlu_src3' THEN NULL
              ELSE avg(l.quality) END AS acc
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  GROUP BY d.lang, d.source),
fx_subjects AS (
  SELECT CAST(pos AS BIGINT) AS pos, task FROM (VALUES {SUBJECT_VALUES}) t(pos, task))"""

FX_SUBJ = FX_SUBJ.replace("{SUBJECT_VALUES}", ", ".join(
    f"({i}, '{t}')" for i, t in enumerate(fx_subject_list())))

FX_MC = """fx_mc_rows AS (
  SELECT c.c_mktsegment AS subject, o.o_custkey AS qid, o.o_orderkey AS choice,
         -o.o_totalprice / 100000.0::DOUBLE AS ll, o.o_orderstatus = 'F' AS is_true,
         o.o_orderdate
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
fx_mc AS (
  SELECT r.subject, r.qid, r.choice, r.ll, r.is_true, g.gold
  FROM fx_mc_rows r JOIN (
    SELECT qid, arg_min(choice, (o_orderdate, choice)) AS gold FROM fx_mc_rows GROUP BY qid) g
  USING (qid))"""

FX_INST = """fx_inst AS (
  SELECT o_custkey AS prompt_id, o_orderkey AS inst_id, o_orderstatus <> 'P' AS strict,
         (o_orderstatus <> 'P') OR o_orderkey % 2 = 0 AS loose
  FROM orders)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _turns_sql(which: str, trim: bool, default: str) -> str:
    agg = "first" if which == "first" else "last"

    def one(role):
        e = f"{agg}(text ORDER BY turn) FILTER (WHERE role = '{role}')"
        if trim:
            e = strip(e)
        return f"coalesce(nullif({e}, ''), {lit(default)})"
    return (f"SELECT conv_id, {one('user')} AS user_text, {one('assistant')} AS assistant_text "
            f"FROM conversations GROUP BY conv_id")


_DPO = _with(FX_PREF_FLAT) + f"""
, conv AS (
  SELECT i.id, {_pref_turn('chosen', 'user', True)} AS instruction,
         {_pref_turn('chosen', 'assistant', True)} AS chosen,
         {_pref_turn('rejected', 'assistant', True)} AS rejected
  FROM fx_pref_ids i LEFT JOIN fx_pref_msgs m USING (id) GROUP BY i.id)
"""

_PAIR_RANKED = """r AS (
  SELECT *, row_number() OVER (ORDER BY score_datainf DESC NULLS LAST, id) - 1 AS rk,
         count(*) OVER () AS n FROM {src})"""


def _pair_select(partner: str, strategy: str | None = None) -> str:
    s = f"'{strategy}' AS strategy, " if strategy else ""
    return (f"SELECT {s}a.rk AS rank, {clean('a.instruction')} AS instruction, "
            f"{clean('coalesce(a.input, ' + chr(39) * 2 + ')')} AS input, {clean('a.chosen')} AS chosen, "
            f"{clean('b.chosen')} AS rejected FROM r a JOIN r b ON b.rk = {partner}")


_SYM = "a.n - 1 - a.rk"
_NEXT = "(a.rk + 1) % a.n"

_SCORE_GAPS = _with(FX_SEP) + """
, g AS (
  SELECT id, 'Summarise document ' || id AS instruction, '' AS input,
         coalesce(text, '') AS chosen, coalesce(text, '') AS rejected,
         CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 11 AS DOUBLE) END AS score_datainf
  FROM fx_sep)
SELECT * FROM g"""

_MATH_ACC = _with(FX_MATH) + """
SELECT count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
       (count(*) FILTER (WHERE correct))::DOUBLE / count(*)::DOUBLE AS accuracy
FROM fx_math_scored"""

_MACRO = """macro AS (
  SELECT l.label, a.avg_acc, coalesce(a.n_scored, 0) AS n_scored
  FROM (SELECT DISTINCT label FROM fx_subj) l LEFT JOIN (
    SELECT label, avg(acc * 100.0::DOUBLE) AS avg_acc, count(*) AS n_scored
    FROM fx_subj JOIN fx_subjects USING (task) WHERE acc IS NOT NULL GROUP BY label) a
  USING (label))"""

_STUB_PROMPTS = _with(FX_JUDGE) + f"""
, p AS (SELECT idx, {judge_prompt('instruction', 'output_1', 'output_2')} AS jp FROM fx_judged_all)
SELECT idx, CASE WHEN length(jp) % 7 = 0 THEN NULL
                 WHEN length(jp) % 2 = 0 THEN '1' ELSE 'Response 2' END AS verdict_raw
FROM p"""


def _d4() -> str:
    h = "md5('42:' || coalesce(chosen, ''))"
    return _with(FX_DOC) + f"""
, h AS (SELECT *, {h} AS hk FROM fx_doc),
r AS (SELECT *, row_number() OVER (ORDER BY hk, id) - 1 AS rk FROM h),
s AS (SELECT (SELECT count(*) FROM h) AS n,
             (SELECT max(c) FROM (SELECT count(*) AS c FROM h GROUP BY hk)) AS m)
SELECT a.id, a.instruction, a.input, a.chosen, b.chosen AS rejected
FROM r a CROSS JOIN s JOIN r b ON b.rk = (a.rk + s.m) % s.n"""


def _topk(desc: bool) -> str:
    o = "DESC" if desc else "ASC"
    return _with(FX_SCORED) + f"""
SELECT id, score_datainf, substring(instruction, 1, 80) AS preview,
       row_number() OVER (ORDER BY score_datainf {o}, id) AS position
FROM fx_scored WHERE score_datainf IS NOT NULL AND NOT isnan(score_datainf)
ORDER BY score_datainf {o}, id LIMIT 3"""


def _lc_winrate(steps: int = 12) -> str:
    """The penalised logistic fit as a chain of Newton steps, each with its 5 x 5 elimination spelled out.

    Features are divided by their largest magnitude; the penalty is that of the raw coefficients.
    """
    d = 5
    feats = ["length_diff::DOUBLE", "length_diff::DOUBLE * length_diff::DOUBLE",
             "ln(1 + model_len::DOUBLE)", "ln(1 + ref_len::DOUBLE)"]
    ctes = [FX_JUDGE,
            "lf AS (SELECT CASE WHEN model_win THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, "
            + ", ".join(f"{e} AS f{j}" for j, e in enumerate(feats)) + " FROM fx_judged)",
            "sc AS MATERIALIZED (SELECT " + ", ".join(f"max(abs(f{j})) AS s{j}" for j in range(4))
            + ", avg(f2) AS m2, avg(f3) AS m3, count(*) AS n, sum(y) AS wins FROM lf)",
            "xs AS MATERIALIZED (SELECT y, " + ", ".join(f"f{j} / s{j} AS x{j}" for j in range(4))
            + ", 1.0::DOUBLE AS x4 FROM lf, sc)",
            "w_0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS w{j}" for j in range(d)) + ")"]
    for k in range(steps):
        z = " + ".join(f"w{j} * x{j}" for j in range(d))
        ws = ", ".join(f"w{j}" for j in range(d))
        ctes.append(f"p_{k} AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))) AS p FROM xs, w_{k})")
        pen = [f"1.0::DOUBLE / (s{j} * s{j})" if j < 4 else "0.0::DOUBLE" for j in range(d)]
        sums = [f"sum(p * (1 - p) * x{i} * x{j}) AS a{i}{j}" for i in range(d) for j in range(i, d)]
        sums += [f"sum((p - y) * x{j}) AS b{j}" for j in range(d)]
        ctes.append(f"h_{k} AS MATERIALIZED (SELECT {', '.join(sums)}, {', '.join(f'first(w{j}) AS w{j}' for j in range(d))} FROM p_{k})")
        cols = [f"a{min(i, j)}{max(i, j)}" + (f" + {pen[i]}" if i == j else "") + f" AS a{i}{j}" for i in range(d) for j in range(d)]
        cols += [f"b{j} + w{j} * {pen[j]} AS b{j}" for j in range(d)]
        ctes.append(f"e_{k}_0 AS MATERIALIZED (SELECT {', '.join(cols)}, {ws} FROM h_{k}, sc)")
        for c in range(d):  # eliminate column c from the rows below
            cols = []
            for i in range(d):
                factor = f"a{i}{c} / a{c}{c}"
                cols += [f"a{i}{j} - {factor} * a{c}{j} AS a{i}{j}" if i > c else f"a{i}{j}" for j in range(d)]
                cols.append(f"b{i} - {factor} * b{c} AS b{i}" if i > c else f"b{i}")
            ctes.append(f"e_{k}_{c + 1} AS MATERIALIZED (SELECT {', '.join(cols)}, {ws} FROM e_{k}_{c})")
        source = f"e_{k}_{d}"
        for i in reversed(range(d)):  # back substitution
            rest = "".join(f" - a{i}{j} * t{j}" for j in range(i + 1, d))
            ctes.append(f"t_{k}_{i} AS MATERIALIZED (SELECT *, (b{i}{rest}) / a{i}{i} AS t{i} FROM {source})")
            source = f"t_{k}_{i}"
        ctes.append(f"w_{k + 1} AS MATERIALIZED (SELECT " + ", ".join(f"w{j} - t{j} AS w{j}" for j in range(d)) + f" FROM {source})")
    return _with(*ctes) + f"""
SELECT (wins / n::DOUBLE) * 100.0::DOUBLE AS raw_winrate,
       round(100.0::DOUBLE / (1.0::DOUBLE + exp(-(w4 + w2 / s2 * m2 + w3 / s3 * m3))), 6) AS lc_winrate,
       n AS n_examples, wins::BIGINT AS n_wins
FROM w_{steps}, sc"""


ORACLE: dict[str, str] = {
    # 2.1
    "read_preferences": _with(FX_PREF_FLAT) + """
SELECT m.id, p.prompt, m.side, m.pos, m.role, m.content
FROM fx_pref_msgs m LEFT JOIN fx_pref_prompt p USING (id)""",
    "limit_first": _with(FX_DOC) + "SELECT id, instruction, chosen FROM fx_doc ORDER BY id LIMIT 100",
    "read_scores": _SCORE_GAPS,
    "write_scores": _with(FX_SCORED) + "SELECT * FROM fx_scored",
    "write_pairs": _with(FX_SCORED, _PAIR_RANKED.format(src="fx_scored")) + _pair_select(_SYM),
    "upsert_by_key": """
SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price
FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey AS key, 'U' AS status, o_totalprice AS price
FROM orders WHERE o_orderstatus IN ('O', 'P')""",
    "read_subject_results": _with(FX_SUBJ) + "SELECT label, task, acc FROM fx_subj",
    "read_math_results": _with(FX_MATH) + "SELECT * FROM fx_math_scored",
    "write_metrics": _MATH_ACC,
    "read_prompts": _with(FX_JUDGE) + """
SELECT idx, instruction, coalesce(reference_output, '') AS output FROM fx_judge""",
    # 2.2
    "first_turn_trimmed": _turns_sql("first", True, ""),
    "last_turn_or_empty": _turns_sql("last", False, "empty"),
    "first_turn_raw": _turns_sql("first", False, ""),
    "last_message": "SELECT conv_id, last(text ORDER BY turn) AS content FROM conversations GROUP BY conv_id",
    "to_dpo_records": _DPO + """
SELECT id, instruction, '' AS input, chosen, rejected FROM conv
WHERE length(instruction) > 0 AND length(chosen) > 0 AND length(rejected) > 0""",
    "conversion_report": _DPO + """
SELECT count(*) FILTER (WHERE length(instruction) > 0 AND length(chosen) > 0 AND length(rejected) > 0) AS converted,
       count(*) FILTER (WHERE NOT (length(instruction) > 0 AND length(chosen) > 0 AND length(rejected) > 0)) AS dropped,
       count(*) AS total
FROM conv""",
    "clean_text": _with(FX_SEP) + f"SELECT id, {clean('text')} AS text FROM fx_sep",
    "render_training_text": f"""
SELECT conv_id, {lit(K.USER_HEADER)} || {empty_marker("u")} || {lit(K.END_OF_TURN)} ||
       {lit(K.ASSISTANT_HEADER)} || {empty_marker("a")} || {lit(K.END_OF_TURN)} AS text
FROM (SELECT conv_id,
             last(text ORDER BY turn) FILTER (WHERE role = 'user') AS u,
             last(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS a
      FROM conversations GROUP BY conv_id)""",
    "render_generation_prompt": _with(FX_JUDGE) + f"""
SELECT idx, {lit(K.BEGIN_OF_TEXT)} || {lit(K.USER_HEADER)} || {strip('instruction')} ||
       {lit(K.END_OF_TURN)} || {lit(K.ASSISTANT_HEADER)} AS prompt FROM fx_judge""",
    "render_fewshot_prompt": _with(FX_MATH) + f"""
SELECT idx, {lit(K.FEWSHOT_PREFIX)} || question || {lit(K.FEWSHOT_SUFFIX)} AS prompt FROM fx_math""",
    "render_judge_prompt": _with(FX_JUDGE) + f"""
SELECT idx, {judge_prompt('instruction', 'output_1', 'output_2')} AS judge_prompt FROM fx_judged_all""",
    "cut_at_stop": _with(FX_MATH) + f"SELECT idx, {cut_at_stop('generated')} AS text FROM fx_math",
    "extract_number": _with(FX_MATH) + f"""
SELECT idx, {extract_number(cut_at_stop('generated'))} AS prediction FROM fx_math""",
    "extract_gold": _with(FX_MATH) + f"SELECT idx, {extract_gold('answer')} AS gold FROM fx_math",
    "parse_verdict": _with(FX_JUDGE) + f"SELECT idx, {parse_verdict('verdict_raw')} AS winner FROM fx_judge",
    "assign_positions": _with(FX_JUDGE) + "SELECT idx, model_is_1, output_1, output_2 FROM fx_judged_all",
    "resolve_win": _with(FX_JUDGE) + "SELECT idx, winner, model_win FROM fx_judged_all",
    "length_features": _with(FX_JUDGE) + """
SELECT idx, model_len, ref_len, length_diff,
       round(length_diff::DOUBLE * length_diff::DOUBLE, 9) AS length_diff_sq,
       round(ln(1 + model_len::DOUBLE), 9) AS log_model_len,
       round(ln(1 + ref_len::DOUBLE), 9) AS log_ref_len
FROM fx_judged_all""",
    "short_subject": _with(FX_SUBJ) + "SELECT label, task, replace(task, 'mmlu_', '') AS subject FROM fx_subj",
    "preview": _with(FX_DOC) + "SELECT id, substring(chosen, 1, 80) AS preview FROM fx_doc",
    # 2.3
    "mean_vector": _with(FX_GRAD) + "SELECT pos, round(value, 9) AS value FROM fx_mv",
    "damping": _with(FX_GRAD) + "SELECT round(lam, 9) AS lam FROM fx_lam",
    "influence_scores": _with(FX_GRAD) + "SELECT id, round(score, 9) AS score FROM fx_scores_raw",
    "influence_scores_blocked": _with(FX_GRAD) + "SELECT id, round(score, 9) AS score FROM fx_scores_raw",
    "attach_scores": _with(FX_GRAD, FX_PREF_FLAT) + f"""
, conv AS (
  SELECT i.id, {_pref_turn('chosen', 'user', False)} AS instruction,
         {_pref_turn('chosen', 'assistant', False)} AS chosen
  FROM fx_pref_ids i LEFT JOIN fx_pref_msgs m USING (id) GROUP BY i.id)
SELECT c.id, c.instruction, '' AS input, c.chosen, c.chosen AS rejected,
       round(coalesce(s.score, 0.0::DOUBLE), 9) AS score_datainf
FROM conv c LEFT JOIN fx_scores_raw s USING (id)""",
    "top_k_helpful": _topk(True),
    "bottom_k_helpful": _topk(False),
    # 2.4
    "rank_by_score": _with(FX_SCORED) + """
SELECT id, row_number() OVER (ORDER BY score_datainf DESC NULLS LAST, id) - 1 AS rank FROM fx_scored""",
    "rank_by_score_ties": _with(FX_SCORED) + """
SELECT id, row_number() OVER (ORDER BY score_datainf DESC NULLS LAST, id) - 1 AS rank FROM fx_scored_ties""",
    "symmetric_pairs": _with(FX_SCORED, _PAIR_RANKED.format(src="fx_scored")) + _pair_select(_SYM),
    "next_neighbor_pairs": _with(FX_SCORED, _PAIR_RANKED.format(src="fx_scored")) + _pair_select(_NEXT),
    "self_pairs_random": _d4(),
    "influence_pairs": _with(FX_GRAD, FX_DOC) + """
, fx_flow AS (
  SELECT d.id, d.instruction, d.input, d.chosen, coalesce(s.score, 0.0::DOUBLE) AS score_datainf
  FROM fx_doc d LEFT JOIN fx_scores_raw s USING (id)),
""" + _PAIR_RANKED.format(src="fx_flow") + "\n"
    + _pair_select(_SYM, "symmetric") + "\nUNION ALL\n" + _pair_select(_NEXT, "next_neighbor"),
    "pairs": _with(FX_SCORED, _PAIR_RANKED.format(src="fx_scored_ties"))
    + _pair_select(_SYM, "symmetric") + "\nUNION ALL\n" + _pair_select(_NEXT, "next_neighbor"),
    # 2.5
    "score_math": _with(FX_MATH) + "SELECT * FROM fx_math_scored",
    "math_accuracy": _MATH_ACC,
    "math_summary": _with(FX_MATH) + """
SELECT correct, total - correct AS incorrect, total,
       (correct::DOUBLE / total::DOUBLE) * 100.0::DOUBLE AS accuracy_pct
FROM (SELECT count(*) FILTER (WHERE correct IS TRUE) AS correct, count(*) AS total FROM fx_math_scored)
WHERE total > 0""",
    "subject_macro_average": _with(FX_SUBJ, _MACRO) + "SELECT label, round(avg_acc, 9) AS avg_acc, n_scored FROM macro",
    "subject_missing": _with(FX_SUBJ) + """
SELECT l.label, s.task, replace(s.task, 'mmlu_', '') AS subject
FROM (SELECT DISTINCT label FROM fx_subj) l CROSS JOIN fx_subjects s
WHERE NOT EXISTS (SELECT 1 FROM fx_subj x WHERE x.label = l.label AND x.task = s.task AND x.acc IS NOT NULL)""",
    "subject_report": _with(FX_SUBJ) + """
SELECT label, pos, replace(task, 'mmlu_', '') AS subject, round(acc * 100.0::DOUBLE, 9) AS acc_pct
FROM fx_subj JOIN fx_subjects USING (task) WHERE acc IS NOT NULL""",
    "compare_models": _with(FX_SUBJ, _MACRO) + """
SELECT label, round(avg_acc, 9) AS avg_acc,
       row_number() OVER (ORDER BY round(avg_acc, 9) DESC NULLS LAST, label) AS position
FROM macro""",
    "choice_accuracy": _with(FX_MC) + """
, q AS (SELECT subject, qid, arg_max(choice, (ll, -choice)) AS pred, first(gold) AS gold
        FROM fx_mc GROUP BY subject, qid)
SELECT subject, count(*) AS n_questions,
       (count(*) FILTER (WHERE pred = gold))::DOUBLE / count(*)::DOUBLE AS accuracy
FROM q GROUP BY subject""",
    "true_mass": _with(FX_MC) + """
, mx AS (SELECT subject, qid, max(ll) AS mx FROM fx_mc GROUP BY subject, qid),
q AS (SELECT subject, qid,
             sum(CASE WHEN is_true THEN exp(ll - mx) ELSE 0.0::DOUBLE END) AS t,
             sum(exp(ll - mx)) AS z
      FROM fx_mc JOIN mx USING (subject, qid) GROUP BY subject, qid)
SELECT subject, count(*) AS n_questions, round(avg(t / z), 9) AS mc2 FROM q GROUP BY subject""",
    "instruction_metrics": _with(FX_INST) + """
, p AS (SELECT prompt_id, bool_and(strict) AS ps, bool_and(loose) AS pl, count(*) AS n,
               count(*) FILTER (WHERE strict) AS nis, count(*) FILTER (WHERE loose) AS nil
        FROM fx_inst GROUP BY prompt_id),
a AS (SELECT count(*) AS np, count(*) FILTER (WHERE ps) AS nps, count(*) FILTER (WHERE pl) AS npl,
             sum(n) AS ni, sum(nis) AS nis, sum(nil) AS nil FROM p)
SELECT coalesce((nps::DOUBLE / nullif(np, 0)::DOUBLE) * 100.0::DOUBLE, 0.0::DOUBLE) AS prompt_level_strict_acc,
       coalesce((npl::DOUBLE / nullif(np, 0)::DOUBLE) * 100.0::DOUBLE, 0.0::DOUBLE) AS prompt_level_loose_acc,
       coalesce((nis::DOUBLE / nullif(ni, 0)::DOUBLE) * 100.0::DOUBLE, 0.0::DOUBLE) AS inst_level_strict_acc,
       coalesce((nil::DOUBLE / nullif(ni, 0)::DOUBLE) * 100.0::DOUBLE, 0.0::DOUBLE) AS inst_level_loose_acc
FROM a""",
    "raw_winrate": _with(FX_JUDGE) + """
SELECT count(*) AS n_examples, count(*) FILTER (WHERE model_win) AS n_wins,
       ((count(*) FILTER (WHERE model_win))::DOUBLE / count(*)::DOUBLE) * 100.0::DOUBLE AS raw_winrate
FROM fx_judged""",
    "lc_winrate": _lc_winrate(),
    "judging_report": _with(FX_JUDGE) + f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE {parse_verdict('verdict_raw')} IS NOT NULL) AS judged,
       count(*) FILTER (WHERE verdict_raw IS NOT NULL AND {parse_verdict('verdict_raw')} IS NULL) AS unparsable,
       count(*) FILTER (WHERE verdict_raw IS NULL) AS no_verdict
FROM fx_judge""",
    "resume_judging": _with(FX_JUDGE) + "SELECT * FROM fx_judged",
    # 2.6
    "map_responses": _with(FX_DOC) + f"""
SELECT id, {strip("length(chosen) || ' ' || replace(chosen, chr(10), ' ')")} AS response FROM fx_doc""",
    "map_verdicts": _STUB_PROMPTS,
}

# The same results from nested records and from result documents.
for _name in ("first_turn_trimmed", "last_turn_or_empty", "first_turn_raw", "last_message", "to_dpo_records",
              "conversion_report", "attach_scores"):
    ORACLE[f"{_name}_nested"] = ORACLE[_name]
ORACLE["read_subject_documents"] = ORACLE["read_subject_results"]
