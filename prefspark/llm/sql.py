"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from prefspark.llm.pii import KINDS, SCORES, WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


def _merkle() -> str:
    """Trees level by level, then each leaf folded level by level; DuckDB has no crc32, so it is computed bit by bit."""
    crc = """xor(list_reduce([4294967295::ubigint] || [ascii(x)::ubigint for x in string_split(doc_id::varchar, '')],
    lambda c, b: list_reduce([xor(c, b)] || [0::ubigint for i in range(8)],
      lambda x, i: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"""

    def leaf(text):
        return "sha256(" + " || ".join(f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"
                                       for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name, leaves):
        return f"""{name} as (
  select g, 0 lv, p, n, h from {leaves}
  union all
  select g, lv + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' order by p)) from {name} where n > 1 group by g, lv, n, p // 8)"""

    run = "over (partition by g, lv, p // 8 order by p rows between"
    return f"""
with recursive d as (select *, coalesce({crc} % 3 = 0, false) hit, coalesce('=' || lang, '-') g from documents),
l as (select doc_id, g, {leaf('text')} h, case when hit then {leaf(f'translate(text, {_LOWER})')} else {leaf('text')} end bad from d),
o as (select *, (row_number() over (partition by g order by doc_id nulls first, h) - 1)::bigint p, (count(*) over (partition by g))::bigint n from l),
{tree('t1', 'o')},
top as (select g, h from t1 where n = 1),
z as (select '' g, g of_, (row_number() over (order by g) - 1)::bigint p, (count(*) over ())::bigint n, h from top),
{tree('t2', 'z')},
r as (select h root from t2 where n = 1),
nodes as (select g, lv, p, h, n from t1 union all select '/', lv, p, h, n from t2),
sib as (select g, lv, p, n, coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') lft,
    coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') rgt from nodes),
fold as (
  select o.doc_id, o.g own, o.h leaf, o.bad x, o.g tr, 0 lv, o.p, '' sibs from o
  union all
  select doc_id, own, leaf, case when s.n > 1 then sha256(lft || x || rgt) else x end,
    case when s.n > 1 then tr else '/' end, case when s.n > 1 then fold.lv + 1 else 0 end,
    case when s.n > 1 then fold.p // 8 else z.p end, case when s.n > 1 then sibs || lft || rgt else sibs end
  from fold join sib s on s.g = tr and s.lv = fold.lv and s.p = fold.p join z on z.of_ = own
  where s.n > 1 or tr <> '/'),
done as (select fold.* from fold join sib s on s.g = tr and s.lv = fold.lv and s.p = fold.p where tr = '/' and s.n = 1)
select doc_id, leaf, top.h subroot, root, sha256(sibs) proof_sha256, x folded_root, x = root verified
from done join top on top.g = done.own cross join r
"""


def _pii() -> str:
    """Spans of personal data; ``\\b`` stands for the looking around of the Spark patterns."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
             "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
             "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "run_card": r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b",
             "run_phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}\b"}

    def too_long(kind, most):
        return f"len([x for x in regexp_extract_all(t, '{plain[kind]}') if length(regexp_replace(x, '[^0-9]', '', 'g')) > {most}]) > 0"

    only = {"run_card": too_long("card", 19), "run_phone": too_long("phone", 15)}
    found = "\n  union all ".join(
        f"select id, t, '{k}' k, regexp_extract_all(t, '{p}') m, regexp_split_to_array(t, '{p}') g from d where {only.get(k, 'true')}"
        for k, p in plain.items())
    near = "\n      ".join(f"when '{k}' then regexp_matches(around, '\\b(?:{w})\\b')" for k, w in WORDS.items())
    score = " ".join(f"when '{k}' then {x}" for k, x in SCORES.items())
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    luhn = ("list_sum([case when (length(dg) - i) % 2 = 0 then dg[i]::int when dg[i]::int > 4 then 2 * dg[i]::int - 9 "
            "else 2 * dg[i]::int end for i in range(1, length(dg) + 1)]) % 10 = 0")
    return f"""
with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
f as ({found}),
u as (select id, t, k, unnest(m) v, unnest(g[1:len(m)]) gap, unnest(range(1, len(m) + 1)) i from f where len(m) > 0),
e as (select *, (sum(length(gap) + length(v)) over (partition by id, k order by i))::bigint e_ from u),
b as (select id, t, k, v, e_ - length(v) b_, e_, regexp_replace(v, '[^0-9]', '', 'g') dg from e),
c as (select * from b union all select id, t, 'short_card', v, b_, e_, dg from b where k = 'card'),
w as (
  select *, lower(substr(t, greatest(b_ - 40, 0) + 1, least(b_, 40)) || ' ' || substr(t, e_ + 1, 20)) around,
    replace(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ' ', '') turned from c),
o as (
  select *, case k
      when 'ip' then len([x for x in string_split(v, '.') if length(ltrim(x, '0')) > 3
        or (length(ltrim(x, '0')) = 3 and ltrim(x, '0') > '255')]) = 0
      when 'card' then length(dg) between 16 and 19 and {luhn}
      when 'run_card' then length(dg) between 16 and 19 and {luhn}
      when 'short_card' then length(dg) between 13 and 15 and {luhn}
      when 'phone' then length(dg) between 8 and 15
      when 'run_phone' then length(dg) between 8 and 15
      when 'iban' then list_reduce([0] || [case when ascii(turned[i]) >= 65 then ascii(turned[i]) - 55 + 1000
        else ascii(turned[i]) - 48 end for i in range(1, length(turned) + 1)],
        lambda x, y: case when y >= 1000 then (x * 100 + y - 1000) % 97 else (x * 10 + y) % 97 end) = 1
      else true end ok,
    (case k {score} end) + case when (case k {near} end) then 0.3 else 0.0 end score,
    case k {order} end n from w),
s as (select * from o where ok and (n < 4 or score >= 0.6)),
a as (
  select id, count(*) filter (where k = 'email') n_email, count(*) filter (where k = 'ip') n_ip,
    count(*) filter (where k = 'card') n_card, count(*) filter (where k = 'phone') n_phone,
    string_agg(k || ':' || b_ || ':' || e_, ',' order by n, b_) filter (where n < 4) base,
    string_agg(k || ':' || b_ || ':' || e_, ',' order by n, b_) spans from s group by id)
select doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join a using (id)
"""


ORACLE = {
    "op10_pii": _pii(),
    "op12_merkle": _merkle(),
    "op11_search": f"""
with d as (select doc_id, row_number() over () r, {_TERMS} t from documents),
f as (select r, doc_id, t, count(*)::bigint tf from d group by all),
n as (select r, sum(tf)::bigint n from f group by r),
c as (select count(*)::bigint cn, sum(n)::bigint cl from n),
m as (select r, n, 75 + (25 * n * cn) // cl m from n, c),
q as (select item_id, row_number() over () u, {_TERMS} t from benchmark),
qt as (select u, item_id, t, count(*)::bigint times from q group by all),
df as (select t, count(*)::bigint df from f group by t),
w as (select t, floor(1000 * ln((2 * cn + 2) / (2 * df + 1)))::bigint w from df, c),
s as (select u, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
  from qt join f using (t) join w using (t) join m using (r) group by all),
k as (select *, row_number() over (partition by u order by score desc, doc_id nulls last)::int "rank" from s where score > 0)
select item_id, "rank", doc_id, score from k where "rank" <= 20
""",
    "op8_mix": rf"""
with d as (
  select *, coalesce(len({_WORDS}), 0)::bigint size_ from documents),
s as (select source, sum(size_)::bigint source_size from d group by source),
w as (
  select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] weight
  from s),
m as (select *, 2.0::double * source_size most, 2.0::double * source_size / weight full_at from w),
l as (
  select *, (1.5::double * (sum(source_size) over ())::double
     - coalesce(sum(most) over (order by full_at, source rows between unbounded preceding and 1 preceding), 0))
     / sum(weight) over (order by full_at, source rows between current row and unbounded following) lev from m),
o as (select arg_min(lev, full_at) open_level from l where lev <= full_at),
t as (select source, source_size, least(most, coalesce(open_level, lev) * weight) target from l left join o on true),
r as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end rate
  from d join t on d.source is not distinct from t.source),
c as (
  select *, (floor(rate) + (case when ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '\N') || '|'
     || coalesce(text, '\N')), 1, 13))::bigint / 4503599627370496.0::double < rate - floor(rate)
     then 1 else 0 end))::bigint copies from r)
select doc_id, size_ as size, source_size, target, copies * size_ as taken, source, copies from c
""",
    "op9_quality": rf"""
with d as (select *, {_WORDS} w, string_split(coalesce(text, ''), chr(10)) ln from documents),
n as (select row_number() over () id, *, len(w) n from d),
u as (select id, unnest(w) x, unnest(range(1, n + 1)) i from n),
g as (select id, i, x, lead(x) over p b, lead(x, 2) over p c from u window p as (partition by id order by i)),
k as (select id, i, count(*) over (partition by id, x, b, c) >= 2 and c is not null hit from g),
h as (select id, i, hit or coalesce(lag(hit) over p, false) or coalesce(lag(hit, 2) over p, false) inside
      from k window p as (partition by id order by i)),
rw as (select id, count(*) filter (where inside) rep from h group by id),
ll as (select id, unnest(ln) line from n),
lc as (select id, count(*) lines, count(*) - count(distinct line) dup from ll
       where regexp_matches(line, '[^\x20\x09-\x0D]') group by id),
st as (
  select n.*, n.n::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint n_symbols,
    coalesce(dup, 0)::bigint n_dup_lines, coalesce(lines, 0)::bigint n_lines, coalesce(rep, 0)::bigint n_repeat_words
  from n left join rw using (id) left join lc using (id)),
ru as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 30 * n_words
      or 100 * n_dup_lines > 30 * n_lines rule_failed from st),
ho as (select source, count(*)::bigint host_docs, sum(rule_failed::int)::bigint host_failed from ru group by source),
pr as (
  select greatest(1e-6, least(1 - 1e-6, sum(host_failed) / sum(host_docs))) mean,
    sum(host_docs * (host_failed / host_docs) ** 2) / sum(host_docs) - (sum(host_failed) / sum(host_docs)) ** 2 between_,
    count(*) k, sum(host_docs) n from ho),
we as (select mean, least(10000, greatest(1, mean * (1 - mean)
         / greatest(between_ - mean * (1 - mean) * k / n, 1e-9) - 1)) wt from pr),
ve as (select ho.*, (host_failed + mean * wt) / (host_docs + wt)
         <= least(0.75, greatest(0.5, mean + 3.0 * sqrt(mean * (1 - mean) / (wt + 1)))) host_kept from ho, we)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and host_kept as kept, ru.source as source, host_docs, host_failed
from ru join ve on ru.source is not distinct from ve.source
""",
    "op4_search": """
with v as (
  select row_number() over () uid, vec_id, [floor(256 * x::double) for x in embedding] e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.uid, q.vec_id query_id, c.uid cuid, c.vec_id, list_dot_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id % 50 = 0 and c.uid <> q.uid),
r as (select *, row_number() over (partition by uid order by score desc, vec_id nulls last, cuid)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op6_chat": """
with c as (select conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
l as (select conv_id pair_id, max(turn) last_ from c group by conv_id),
t as (
  select conv_id pair_id, 'chosen' side, turn, role, text from c
  union all
  select l.pair_id, 'rejected', c.turn, c.role, c.text from c join l
    on (c.conv_id = l.pair_id and c.turn < last_) or (xor(c.conv_id, 1) = l.pair_id and c.turn >= last_)),
b as (
  select pair_id, turn, min({'role': role, 'text': text}) filter (where side = 'chosen') c,
    min({'role': role, 'text': text}) filter (where side = 'rejected') r from t group by pair_id, turn),
f as (select pair_id, min(turn) filter (where c is null or r is null or c is distinct from r) first_,
        bool_or(c is not null) has_c, bool_or(r is not null) has_r from b group by pair_id),
p as (
  select pair_id, turn, 'p' part, c x from b join f using (pair_id) where c is not null and coalesce(turn < first_, true)
  union all
  select pair_id, turn, 'c', c from b join f using (pair_id) where c is not null and turn >= first_
  union all
  select pair_id, turn, 'r', r from b join f using (pair_id) where r is not null and turn >= first_),
s as (
  select *, '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10) t from p),
o as (select *, sum(length(t)) over (partition by pair_id, part order by turn) - length(t) at_ from s),
g as (
  select pair_id, part, count(*) n, string_agg(t, '' order by turn) t,
    string_agg((at_ + 13 + length(coalesce(x.role, '')))::bigint::varchar || ':' || (at_ + length(t) - 1)::bigint::varchar,
      ',' order by turn) filter (where x.role = 'assistant') m from o group by pair_id, part)
select f.pair_id, coalesce(p.n, 0)::bigint n_prompt_turns, coalesce(p.t, '') prompt,
  case when has_c then coalesce(c.t, '') end chosen, case when has_r then coalesce(r.t, '') end rejected,
  case when has_c then coalesce(c.m, '') end chosen_mask, case when has_r then coalesce(r.m, '') end rejected_mask
from f left join g p on p.pair_id = f.pair_id and p.part = 'p' left join g c on c.pair_id = f.pair_id and c.part = 'c'
  left join g r on r.pair_id = f.pair_id and r.part = 'r'
""",
    "op2_jaccard": r"""
with recursive d as (
  select row_number() over () id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct id, sh from (
    select id, unnest(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) sh from d)),
n as (select id, count(*) n from s group by id),
c as (select a.id x, b.id y, count(*) i from s a join s b on a.sh = b.sh and a.id < b.id group by a.id, b.id),
l as (select x, y from c join n a on a.id = x join n b on b.id = y where 100 * i >= 85 * (a.n + b.n - i)),
e as (select x, y from l union select y, x from l),
r as (select id x, id y from d union select r.x, e.y from r join e on r.y = e.x),
k as (select r.x id, min(d.doc_id) component_id from r join d on d.id = r.y group by r.x)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id from d left join n using (id) join k using (id)
""",
}
