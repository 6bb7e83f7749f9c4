"""DuckDB SQL, by brute force over whole tables, of the operators that SQL can express. The others need XXH64, a tokenizer, a trained model or a
parser of pages; their tests compare them with plain Python."""

from __future__ import annotations

import re

from .licenses import CONTAINMENT, LEAST_WINDOW, SHINGLE, TEMPLATES
from .secrets import RULES, Rule

#: Words as in the scan for grams: (row, id, words).
_SCANNED = r"""select row_number() over () as r, {id}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from {source}"""

OP1 = f"""with d as ({_SCANNED.format(id="doc_id", source="documents")}),
b as ({_SCANNED.format(id="item_id", source="benchmark")}),
wins as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') as gram from (select *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as k from b where len(ws) > 0)),
sizes as (select distinct n from wins),
spots as (select r, k, n, array_to_string(ws[k : k + n - 1], ' ') as gram from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, sizes)),
hits as (select r, k, s.n, item_id from spots s join wins using (gram)),
n_hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hits) group by r),
items as (select r, list_sort(list_distinct(list(item_id::varchar))) as items from hits group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, len(coalesce(items, []))::bigint as n_items,
 sha256(array_to_string(coalesce(items, []), ',')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n_hit using (r) left join items using (r)"""

OP3 = r"""with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
wins as (select r, k, array_to_string(ws[k : k + 34], ' ') as win from (select r, ws, unnest(range(1, len(ws) - 33)) as k from d)),
twice as (select win from wins group by win having count(*) > 1),
gone as (select distinct r, unnest(range(k, k + 35)) as p from wins join twice using (win)),
each as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
kept as (select r, string_agg(word, ' ' order by p) as kept from each anti join gone using (r, p) group by r),
counts as (select r, count(*) as n from gone group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (r) left join counts using (r)"""


def _spans(k: int, rule: Rule) -> str:
    """(row, start, kind number, end) of a rule's matches: running sums over the matches and what is between them."""
    regex = rule.regex.replace("'", "''")
    if rule.any_case:  # ASCII letters only, where (?i) would fold others too
        regex = re.sub(r"(?<![\\\[A-Za-z-])[a-z]+(?![^\[]*\])", lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]), regex)
    return f"""select r, s as "start", {k} as kind, e as "end" from (
 select r, e - length(m) as s, e, length(g) as checked from (
  select r, m, g, sum(length(gap) + length(m)) over (partition by r order by i rows unbounded preceding) as e from (
   select r, unnest(ms) as m, unnest(gs) as g, unnest(gaps[1 : len(ms)]) as gap, unnest(range(len(ms))) as i from (
    select r, regexp_extract_all(t, '{regex}') as ms, regexp_extract_all(t, '{regex}', {rule.group}) as gs, string_split_regex(t, '{regex}') as gaps from d)))) where checked >= {rule.least}"""


# RE2 has neither lookaheads nor possessive loops, so what follows a BEGIN line is taken in steps: up to the next marker, or header lines, long runs of
# base64 and whole lines of it, of which the last must end like a line.
_BREAK = r"(\r\n|\n|\r|\\r\\n|\\n)"
_LINE = rf"[ \t]*{_BREAK}[ \t]*[A-Za-z0-9+/=]+"


def _keys(k: int, rule: Rule) -> str:
    """(row, start, kind number, end) of whole private keys, without those that begin within one."""
    after = lambda *taken: "substr(rest, 1" + "".join(f" + length({t})" for t in taken) + ")"
    return rf"""select r, "start", {k} as kind, "end" from (
 select *, max("end") over (partition by r order by "start" rows between unbounded preceding and 1 preceding) as before from (
  select r, "start", "end" + case when closing <> '' then length(up_to) + length(closing) else length(headers) + length(runs) + length(case when regexp_matches({after('headers', 'runs', 'lines')}, '^[ \t]*({_BREAK}|\z)') then lines else regexp_replace(lines, '{_LINE}$', '') end) end as "end" from (
   select *, regexp_extract({after('headers', 'runs')}, '^({_LINE})*') as lines from (
    select *, regexp_extract({after('headers')}, '^(([ \t\n\x0B\f\r]|\\[rn])*[A-Za-z0-9+/=]{{16,}})*') as runs from (
     select *, regexp_extract(substr(rest, 1 + length(up_to)), '^-----END [A-Z ]*PRIVATE KEY-----') as closing, regexp_extract(rest, '^([ \t]*{_BREAK}[ \t]*[A-Z][A-Za-z0-9-]*:\x20[^\r\n\\]*)*') as headers from (
      select *, regexp_extract(rest, '(?s)^(.*?)-----(BEGIN|END) ', 1) as up_to from (select s.*, substr(t, "end"::bigint + 1) as rest from ({_spans(k, rule)}) s join d using (r)))))))) where before is null or "start" >= before"""


def _secrets() -> str:
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    count = lambda k: f"count(*) filter (kind = {k})"
    one = """name || ':' || "start"::bigint || ':' || "end"::bigint"""
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
spans as ({' union all '.join((_keys if r.whole else _spans)(k, r) for k, r in enumerate(RULES))}),
named as (select *, {kinds}[kind + 1] as name from spans),
per as (select r, {count(0)} as n_assign, {count(1)} as n_access, {count(2)} as n_hex, string_agg({one}, ',' order by "start", kind) filter (kind < 3) as base, string_agg({one}, ',' order by "start", kind) as spans from named group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (r)"""


OP4 = _secrets()

OP6 = """with recursive v as (select vec_id, label, case when list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)) then embedding::double[] end as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v join least on least.a = vec_id left join counts on counts.a = vec_id"""


def _licenses() -> str:
    rows = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(TEMPLATES))
    last = SHINGLE - 1
    return f"""with given(t, license, text) as (values {rows}),
d as ({_SCANNED.format(id="doc_id", source="documents")}),
k as ({_SCANNED.format(id="t, license", source="given")}),
sized as (select t, license, ws, greatest({LEAST_WINDOW}, 1 << ceil(log2(2 * len(ws)))::int) as w from k),
ts as (select distinct t, license, w, array_to_string(ws[p : p + {last}], ' ') as shingle from (select *, unnest(range(1, len(ws) - {last - 1})) as p from sized)),
whole as (select t, count(*) as of from ts group by t),
ds as (select r, p - 1 as p, array_to_string(ws[p : p + {last}], ' ') as shingle from (select r, ws, unnest(range(1, len(ws) - {last - 1})) as p from d)),
met as (select r, t, license, w, shingle, unnest(range(greatest(ceil((p + {SHINGLE} - w) / (w // 2)), 0)::bigint, p // (w // 2) + 1)) as spot from ds join ts using (shingle)),
good as (select r, t, license, w, spot from met join whole using (t) group by r, t, license, w, spot, of having count(distinct shingle) >= {CONTAINMENT} * of),
per as (select r, count(distinct (w, spot)) as n, list_sort(list_distinct(list(license))) as licenses from good group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_windows, len(coalesce(licenses, []))::bigint as n_licenses, array_to_string(coalesce(licenses, []), ',') as licenses from d left join per using (r)"""


OP10 = _licenses()

#: Unsigned CRC-32 of ASCII strings: a table of the bytes' remainders, from its rule, and a fold over the characters.
_CRC_TABLE = "crc(tab) as (select list(c order by b) from (select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as b)))"


def _crc(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::int, 1))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle(fanout: int = 3) -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    same = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    hit = f"doc_id is not null and {_crc('doc_id::varchar')} % 2 = 0"
    level = lambda name, of: f"""{name} as (select {of}, 0 as l, i, d from {name}0 union all
 select {of}, l + 1, i // {fanout}, sha256(string_agg(d, '' order by i)) from {name} where ({of}, l) in (select ({of}, l) from {name} group by all having count(*) > 1) group by {of}, l, i // {fanout})"""  # noqa: E731
    beside = lambda cmp: f"coalesce(string_agg(d, '' order by i) filter (i {cmp} spot), '')"
    return f"""with recursive {_CRC_TABLE},
docs as (select row_number() over () as r, doc_id, source, sha256({same} || {field('text')}) as leaf, sha256({same} || {field("(case when " + hit + " then replace(text, chr(10), '') else text end)")}) as checked from documents, crc),
t0 as (select r, dense_rank() over (order by source nulls first) - 1 as s, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, leaf as d from docs),
{level("t", "s")},
tops as (select s, max(l) as depth, arg_max(d, l) as d from t group by s),
u0 as (select 0 as one, s as i, d from tops),
{level("u", "one")},
root as (select max(l) as depth, arg_max(d, l) as root from u),
spots as (select r, s, l, i // ({fanout} ** l)::bigint as spot from t0 join tops using (s), lateral (select unnest(range(depth)) as l)),
tops_at as (select s, l, s // ({fanout} ** l)::bigint as spot from tops, root, lateral (select unnest(range(root.depth)) as l)),
inner_steps as (select r, p.l as k, {beside('<')} as lo, {beside('>')} as hi from spots p join t on t.s = p.s and t.l = p.l and t.i // {fanout} = spot // {fanout} group by r, p.l),
outer_steps as (select p.s, p.l, {beside('<')} as lo, {beside('>')} as hi from tops_at p join u on u.l = p.l and u.i // {fanout} = spot // {fanout} group by p.s, p.l),
steps as (select * from inner_steps union all select r, depth + l, lo, hi from t0 join tops using (s) join outer_steps using (s)),
walk as (select r, 0 as k, checked as now from docs union all select r, k + 1, sha256(lo || now || hi) from walk join steps using (r, k)),
proofs as (select r, string_agg(lo || hi, '' order by k) as proof from steps group by r),
ends as (select r, arg_max(now, k) as folded_root from walk group by r)
select doc_id, leaf, tops.d as subroot, root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = root as verified
from docs join t0 using (r) join tops using (s) join ends using (r) left join proofs using (r), root"""


OP11 = _merkle()


def _conversations() -> str:
    """The cheapest edits turn by turn: k0 to k3 hold, for each state of the grammar, nine digits of cost and then the audit, so that the least string is the
    best way. a2 and a3 are those ways with insertions after them."""
    add = lambda k, cost, letter: f"lpad((left({k}, 9)::int + {cost})::varchar, 9, '0') || substr({k}, 10) || '{letter}'"
    a2 = f"least(k2, {add('k0', 3, 'I')}, {add('k1', 3, 'I')}, {add('k3', 3, 'I')})"
    closed = f"select *, least(k3, {add('a2', 3, 'I')}) as a3 from (select *, {a2} as a2 from ways)"
    to_user = [f"case when not gone and initial = 'u' then {add(k, 'more', 'K')} end, case when not gone then {add(k, '3 + more', 'R')} end" for k in ("k0", "k1", "a3")]
    to_assistant = f"case when not gone and initial = 'a' then {add('a2', 'more', 'K')} end, case when not gone then {add('a2', '3 + more', 'R')} end"
    to_system = f"case when not gone and initial = 's' then {add('k0', 'more', 'K')} end"
    given = "case when (place - system) % 2 = 0 then 'user' else 'assistant' end"
    return rf"""with recursive {_CRC_TABLE},
talks as (select dense_rank() over (order by conv_id) as c, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
 {_crc("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as fault from conversations, crc),
faulty as (select c, turn, case when fault = 4 then 'user' else role end as role, case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
 unnest(range(case when fault = 3 then 2 else 1 end)) as copy from talks where fault <> 0),
turns as (select *, row_number() over (partition by c order by turn nulls first, role, md5(text), copy) as i, left(role, 1) as initial, regexp_replace(text, '[ 	-
]+$', '') as said from faulty),
judged as (select *, said = '' as blank, said <> '' and row_number() over (partition by c, role, text order by i) > 1 as duplicate, lag(initial) over (partition by c order by i) as last from turns),
edits as (select *, blank or duplicate as gone, case when not blank and not duplicate and right(said, 1) not in ('.', '!', '?') then 3 else 0 end as more from judged),
ways as (select distinct c, 0::bigint as i, '000000000' as k0, null::varchar as k1, null::varchar as k2, null::varchar as k3 from talks
 union all select c, i, {add('k0', 4, 'D')}, least({add('k1', 4, 'D')}, {to_system}), least({add('a2', 4, 'D')}, {', '.join(to_user)}), least({add('a3', 4, 'D')}, {to_assistant})
 from (select e.*, k0, k1, a2, a3 from ({closed}) w join edits e on e.c = w.c and e.i = w.i + 1)),
ends as (select c, arg_max(least(k0, a3), i) as best from ({closed}) group by c),
steps as (select c, p, substr(best, 9 + p, 1) as edit from (select c, best, unnest(range(1, length(best) - 8))::int as p from ends)),
taken as (select c, p, edit, count(*) filter (edit <> 'I') over (partition by c order by p) as i, count(*) filter (edit <> 'D') over (partition by c order by p) - 1 as place from steps),
kept as (select t.c, p, place, edit, case when edit <> 'I' then role end as role, case when edit <> 'I' then text else '' end as text from taken t left join turns u on u.c = t.c and u.i = t.i where edit <> 'D'),
begun as (select c, max((place = 0 and edit = 'K' and left(role, 1) = 's')::int) as system from kept group by c),
left_over as (select c, string_agg(case when edit = 'K' then role else {given} end || ':' || text, chr(10) order by p) as said from kept join begun using (c) group by c),
counts as (select c, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (more > 0) as truncated,
 count(*) filter (last is not null and last || initial not in ('su', 'ua', 'au')) as illegal from edits group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
 left(best, 9)::bigint as cost, substr(best, 10) as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct c, conv_id from talks) join ends using (c) left join counts using (c) left join left_over using (c)"""


OP13 = _conversations()

ORACLE_SQL = {"op1_decontamination": OP1, "op3_substring": OP3, "op4_secrets": OP4, "op6_embeddings": OP6, "op10_licenses": OP10, "op11_merkle": OP11, "op13_conversations": OP13}
