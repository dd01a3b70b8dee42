"""The registered queries of this folder and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import (
    byte_bpe, decontaminate, fingerprints, html_text, near_dedup, preferences, prefix_trie, radix_dedup, structure_repair, suffix_dedup, talks, token_counts, toxicity,
    url_filter,
)
from lanewright.llm.talk_sql import REPAIR_SQL, TRIE_SQL
from lanewright.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def query(name: str, check: str | None = None):
    """Register ``build(spark, table)``, where ``table(name)`` reads a table."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return build

    return register


@query("op1_html_text")
def op1(spark, table):
    found = html_text.extract(table("pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op2_toxicity")
def op2(spark, table):
    documents, labels = table("documents"), table("labels")
    model = toxicity.fit(documents, labels.filter(toxicity.learnable()))
    return toxicity.score(documents, model, ["doc_id"]).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "p_value", "passages"
    )


@query("op3_byte_bpe")
def op3(spark, table):
    tokens = byte_bpe.encode(table("documents"), BYTE_RANKS, ["doc_id"])
    texts = byte_bpe.decode(tokens, BYTE_RANKS, ["doc_id"])
    return texts.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("raw"), 256).alias("decoded_sha256"),
    )


@query("op4_token_counts")
def op4(spark, table):
    counts = token_counts.count_tokens(table("documents"), PIECE_MODEL, token_counts.new_cache(spark))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


NEAR_SQL = """
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents
), o as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p, len(words) as n from w),
f as (
    select doc_id, p, n, word || ' ' || lead(word) over d || ' ' || lead(word, 2) over d || ' ' || lead(word, 3) over d || ' ' || lead(word, 4) over d as shingle
    from o window d as (partition by doc_id order by p)
), s as (
    select doc_id, list(distinct shingle order by shingle) as shingles from (
        select doc_id, md5_number(shingle) as shingle from f where shingle is not null
        union all select doc_id, md5_number(array_to_string(words, ' ')) from w where len(words) between 1 and 4
    ) group by doc_id
), c as (select min(doc_id) as rep, shingles, len(shingles) as n from s group by shingles),
x as (select rep, n, unnest(shingles) as shingle from c),
l as (
    select a.rep as a, b.rep as b from x a join x b on a.shingle = b.shingle and a.rep < b.rep
    group by a.rep, a.n, b.rep, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e as (select a, b from l union all select b, a from l),
r(node, seen) as (select rep, rep from c union select r.node, e.b from r join e on r.seen = e.a),
m as (select node, min(seen) as component_id from r group by node)
select w.doc_id, coalesce(len(s.shingles), 0) as n_shingles, coalesce(m.component_id, w.doc_id) as component_id,
    w.doc_id = coalesce(m.component_id, w.doc_id) as kept
from w left join s using (doc_id) left join c on s.shingles = c.shingles left join m on c.rep = m.node
"""


@query("op5_near_dedup", NEAR_SQL)
def op5(spark, table):
    return near_dedup.near_components(table("documents"), 85)


REPEAT_SQL = """
with d as (select row_number() over () as rid, doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
k as (select rid, o, substr(h, 2 * o + 1, 2 * (64 + 199)) as part from (select rid, h, unnest(range(0, len(h) // 2 - 199, 64)) as o from d)),
p as materialized (select rid, o + i as place, hash(substr(part, 2 * i + 1, 400)) as string
    from (select rid, o, part, unnest(range(0, least(64, len(part) // 2 - 199))) as i from k)),
q as (select rid, place from p where string in (select string from p group by string having count(*) > 1)),
g as (select rid, place, case when place > lag(place) over (partition by rid order by place) + 200 then 1 else 0 end as fresh from q),
n as (select rid, place, sum(fresh) over (partition by rid order by place) as run from g),
v as (select rid, min(place) as a, max(place) + 200 as b from n group by rid, run),
z as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before from v),
t as (
    select rid, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head
    from z join d using (rid) group by rid
)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) as kept_sha256
from d left join t using (rid)
"""


@query("op6_repeated_bytes", REPEAT_SQL)
def op6(spark, table):
    cut = suffix_dedup.remove_repeats(table("documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


EXACT_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(body) as text_sha256
from d window w as (partition by body)
"""


@query("op7_exact_dedup", EXACT_SQL)
def op7(spark, table):
    return radix_dedup.mark_duplicates(table("documents"))


def _term_count(terms: tuple[str, ...]) -> str:
    return " + ".join(f"cast(regexp_matches(address, '(^|[^a-z0-9]){t}($|[^a-z0-9])') as integer)" for t in terms)


URL_SQL = f"""
with a as (
    select page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as address,
        case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), b as (
    select page_id, address, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from a
), r(mark, h, p) as (
    values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m as (
    select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(mark, length(h || p)) as mark
    from b join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
), s as (select page_id, {_term_count(url_filter.STRICT_TERMS)} as n_strict, {_term_count(url_filter.SOFT_TERMS)} as n_soft from b)
select b.page_id, b.host, b.path, m.rule, coalesce(m.mark, case when n_strict >= 1 or n_soft >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end) as verdict,
    n_strict, n_soft
from b join s using (page_id) left join m using (page_id)
"""


@query("op9_url_filter", URL_SQL)
def op9(spark, table):
    judged = url_filter.judge(table("pages"), URL_RULES, ["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


PAIR_SQL = """
with c as (
    select conv_id, list({'n': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
    from conversations where conv_id is not null group by conv_id
), p as (
    select conv_id // 2 as pair_id, arg_max(conv_id, len(turns) * 2 - conv_id % 2) as chosen, arg_min(conv_id, len(turns) * 2 - conv_id % 2) as rejected
    from c group by conv_id // 2 having count(*) = 2
), j as (
    select p.*, list_transform(x.turns, lambda t: {'role': t.role, 'text': t.text}) as a, list_transform(y.turns, lambda t: {'role': t.role, 'text': t.text}) as b
    from p join c x on chosen = x.conv_id join c y on rejected = y.conv_id
), k as (
    select *, coalesce((select min(i) - 1 from (select unnest(range(1, least(len(a), len(b)) + 1)) as i) where a[i] <> b[i]), least(len(a), len(b))) as n_common from j
), s as (
    select pair_id, 'prompt' as side, a[1:n_common] as turns from k union all select pair_id, 'chosen', a[n_common + 1:] from k
    union all select pair_id, 'rejected', b[n_common + 1:] from k
), u as (select pair_id, side, unnest(turns) as t, generate_subscripts(turns, 1) as i from s),
f as (
    select pair_id, side, i, t.role as role, '<|' || t.role || '|>' || chr(10) as header, t.text || '<|end|>' || chr(10) as body from u
), h as (
    select *, sum(len(header) + len(body)) over (partition by pair_id, side order by i) as last from f
), o as (
    select pair_id, side, string_agg(header || body, '' order by i) as text,
        string_agg((last - len(body)) || ':' || last, ' ' order by i) filter (role = 'assistant') as mask from h group by pair_id, side
)
select pair_id, chosen, rejected, cast(n_common as integer) as n_common, coalesce(q.text, '') as prompt, coalesce(x.text, '') as chosen_text, coalesce(x.mask, '') as chosen_mask,
    coalesce(y.text, '') as rejected_text, coalesce(y.mask, '') as rejected_mask
from k left join (from o where side = 'prompt') q using (pair_id) left join (from o where side = 'chosen') x using (pair_id)
    left join (from o where side = 'rejected') y using (pair_id)
"""


@query("op8_preference_format", PAIR_SQL)
def op8(spark, table):
    """Masks as text, ``start:end`` of each span, so that SQL can state them."""
    turns = table("conversations")
    made = preferences.format_pairs(preferences.opening_pairs(turns), turns)
    masks = [f"{side}_mask" for side in ("chosen", "rejected")]
    return made.withColumns({m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"], s["end"])), " ") for m in masks})


# A stretch of 13 words with two replaced ones has three words in a row that are not, and so has every shorter item of three words or more.
LEAK_SQL = f"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as words from documents),
b as (
    select min(item_id) as item_id, words, least({decontaminate.SPAN}, len(words)) as span
    from (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as words from benchmark) where len(words) > 0 group by words
),
dp as (select doc_id, words, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as three from (select doc_id, words, unnest(range(1, len(words) + 1)) as p from d)),
bp as (select item_id, words, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as three from (select item_id, words, unnest(range(1, len(words) + 1)) as p from b)),
h as (
    select distinct dp.doc_id, bp.item_id, dp.p - bp.p as diagonal from dp join bp on dp.three = bp.three
    union select dp.doc_id, bp.item_id, dp.p - 1 from dp join bp on dp.words[dp.p] = bp.words[1] where bp.p = 1 and len(bp.words) < 3
),
m as (
    select h.doc_id, h.item_id, h.diagonal, span, bp.p, cast(d.words[bp.p + h.diagonal] = bp.words[bp.p] as integer) as same
    from h join b using (item_id) join bp using (item_id) join d using (doc_id) where bp.p + h.diagonal between 1 and len(d.words)
),
s as (
    select doc_id, item_id, span, sum(same) over w as equal, count(*) over w as n from m
    window w as (partition by doc_id, item_id, diagonal order by p rows between current row and {decontaminate.SPAN - 1} following)
),
l as (select doc_id, count(distinct item_id) as n_items, min(item_id) as first_item from s where n >= span and n - equal <= floor(span / {decontaminate.ONE_IN}) group by doc_id)
select doc_id, l.doc_id is not null as leaked, coalesce(n_items, 0) as n_items, first_item from d left join l using (doc_id)
"""


@query("op10_decontaminate", LEAK_SQL)
def op10(spark, table):
    found = decontaminate.find_leaks(table("documents"), table("benchmark"))
    return found.select("doc_id", "leaked", F.size("items").cast("bigint").alias("n_items"), F.array_min("items").alias("first_item"))


@query("op11_structure_repair", REPAIR_SQL)
def op11(spark, table):
    return structure_repair.repair(talks.damaged(table("conversations"))).withColumnRenamed("_conv", "conv_id")


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark, table):
    turns = materialize(talks.numbered_turns(table("conversations")), "turns")
    return prefix_trie.trie(talks.rebuilt(turns), turns.select("_conv").distinct())


@query("op13_fingerprints")
def op13(spark, table):
    return fingerprints.edited_fingerprints(table("documents"))
