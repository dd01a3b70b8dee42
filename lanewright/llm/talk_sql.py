"""Check SQL of the conversation operators."""

from __future__ import annotations

#: The CRC-32 of a text of ASCII characters, as an expression over the text.
CRC_TABLE = (
    "(select list(v order by n) as t from (select n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from (select unnest(range(0, 256)) as n)))"
)


def crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


WORDS = "len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))"

TRIE_SQL = f"""
with o as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
    from conversations where conv_id is not null
), k as materialized (select c, c - c % 20 as base, {crc("cast(c as varchar)")} % 4 as h from (select distinct c from o), {CRC_TABLE}),
s as (select k.c, k.h, least(k.h, count(o.c)) as given from k left join o on o.c = k.base group by k.c, k.h),
b as (
    select k.c, o.pos, o.role, o.text from k join o on o.c = k.base and o.pos < k.h
    union all select o.c, o.pos - s.h + s.given, o.role, o.text from o join s using (c) where o.pos >= s.h
), p as materialized (
    select c, pos + 1 as d, text, sha256(string_agg(len(role) || ':' || role || len(text) || ':' || text, '|') over (partition by c order by pos)) as node from b
), u as (
    select c, d, node, lag(node) over (partition by c order by d) as above, {WORDS} as words from p
    union all select c, 0, 'root', null, 0 from k
), l as (select c, max(d) as size from u group by c),
n as materialized (
    select node, d as depth, min(c) as conv_id, any_value(case when d = 1 then 'root' else above end) as above, count(*) as n_convs, any_value(words) as words,
        string_agg(c, ',' order by c) filter (d = size) as ends from u join l using (c) group by node, d
), m as (select above as node, count(*) as n_children from n where above is not null group by above),
a as (select n.node as low, u.node as high from n join u on u.c = n.conv_id and u.d <= n.depth),
t as (
    select high as node, count(*) filter (m.node is null) as n_leaves, sum((n.n_convs - 1) * n.words) as saved
    from a join n on n.node = a.low left join m on m.node = a.low group by high
)
select n.conv_id, n.depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(m.n_children, 0) as n_children, t.n_leaves, cast(t.saved as bigint) as saved_tokens,
    sha256(coalesce(n.ends, '')) as ends_sha256
from n left join n q on q.node = n.above left join m on m.node = n.node join t on t.node = n.node
"""

#: Edits as (state before, initial needed: u, a, s, any, or not u, not a), initial of the edit, state after, cost.  States: 0 nothing yet, 1 system, 2 user, 3 assistant.
MOVES = [(s, "*", "D", s, 2) for s in range(4)] + [(0, "s", "K", 1, 0), (2, "a", "K", 3, 0), (2, "-a", "R", 3, 1)]
MOVES += [(s, need, edit, 2, cost) for s in (0, 1, 3) for need, edit, cost in (("u", "K", 0), ("-u", "R", 1))]
#: Up to two turns may be put in before a turn or at the end.
PUT_IN = [(s, "", s, 0) for s in range(4)] + [(s, "I", 3 if s == 2 else 2, 5) for s in range(4)] + [(s, "II", 2 if s == 2 else 3, 10) for s in range(4)]

REPAIR_SQL = f"""
with recursive v(s0, need, edit, s1, cost) as (values {", ".join(map(str, MOVES))}), i(s0, edit, s1, cost) as (values {", ".join(map(str, PUT_IN))}),
r as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind
    from conversations, {CRC_TABLE}
), x as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(0, case when kind = 3 then 2 else 1 end)) as copy
    from r where kind <> 0
), y as (
    select *, min(q) over (partition by conv_id, role, text) < q as again, left(role, 1) as initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as last
    from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as q from x)
), z as materialized (
    select conv_id, q, turn, role, text, initial, last = '' as blank, last <> '' and again as duplicate, last <> '' and not again and not contains('.!?', last) as truncated,
        lag(initial) over (partition by conv_id order by q) || initial as pair from y
), sums as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
        count(*) filter (truncated) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from z group by conv_id
), w as (
    select z.conv_id, z.q, i.s0, v.s1, i.edit || v.edit as edit, i.cost + v.cost + case when truncated and v.edit <> 'D' then 5 else 0 end as cost
    from z, i join v on i.s1 = v.s0
    where (v.edit = 'D' or not (blank or duplicate)) and (need = '*' or need = initial or (need = '-u' and initial <> 'u') or (need = '-a' and initial <> 'a'))
), steps as materialized (
    select conv_id, q, s0, s1, min({{'cost': cost, 'edit': edit}}) as best from w group by conv_id, q, s0, s1
), walk(conv_id, q, state, best) as (
    select conv_id, 0 as q, 0 as state, {{'cost': 0, 'audit': ''}} as best from sums
    union all
    select walk.conv_id, walk.q + 1, s1, min({{'cost': walk.best.cost + steps.best.cost, 'audit': walk.best.audit || steps.best.edit}})
    from walk join steps on walk.conv_id is not distinct from steps.conv_id and steps.q = walk.q + 1 and steps.s0 = walk.state group by walk.conv_id, walk.q, s1
), found as materialized (
    select conv_id, min({{'cost': best.cost + i.cost, 'audit': best.audit || i.edit}}) as best
    from walk join sums using (conv_id) join i on i.s0 = state where q = n and i.s1 in (0, 3) group by conv_id
), e as (select conv_id, unnest(string_split(best.audit, '')) as edit, generate_subscripts(string_split(best.audit, ''), 1) as k from found where best.audit <> ''),
f as (
    select *, count(*) filter (edit <> 'I') over u as q, count(*) filter (edit <> 'D') over u as place from e window u as (partition by conv_id order by k)
), g as (
    select f.*, z.role, case when edit = 'I' then '' else z.text end as text,
        max(case when place = 1 and edit = 'K' and z.initial = 's' then 1 else 0 end) over (partition by f.conv_id) as has_system
    from f left join z on z.conv_id = f.conv_id and z.q = f.q where edit <> 'D'
), h as (
    select conv_id, string_agg(case when edit = 'K' then role when (place - has_system) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by place) as body from g group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join sums using (conv_id) left join found using (conv_id) left join h using (conv_id)
"""
