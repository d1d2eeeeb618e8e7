"""The queries of the numbered operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomlake.llm import bpe, decontaminate, html_extract, ngram_join, prefix_trie, quality, repair, secrets, sharding, substring_dedup, token_counts, topk, toxicity
from loomlake.llm.common import table

BPE_FILE = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_bytes(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_html_extraction, op3_bpe, op4_quality_rules, op5_substring_dedup, op6_decontamination, op7_ngram_jaccard_join, op8_secret_scan, op9_token_counts, op10_sharding, op11_conversation_repair, op12_exact_top_k, op13_prefix_trie)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The bytes' table of CRC-32, and the CRC of a string with that table ``t`` at hand.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _edit(value: str, cost: str, letter: str) -> str:
    """A value, six digits of cost and the audit, after one more edit; ~ stands for none."""
    return f"case when {value} = '~' then '~' else lpad(cast(cast({value}[1:6] as int) + {cost} as varchar), 6, '0') || {value}[7:] || '{letter}' end"


_COST = "case when r[2] = 't' then 5 else 0 end"
#: Values of the states (start, s, u, a) after row r (initial, fault), then after insertions.
_STEP = f"""[{_edit('x[1]', '2', 'D')},
 least({_edit('x[2]', '2', 'D')}, case when r[1] = 's' and r[2] not in ('b', 'd') then {_edit('x[1]', _COST, 'K')} else '~' end),
 least({_edit('x[3]', '2', 'D')}, case when r[2] in ('b', 'd') then '~' when r[1] = 'u' then least({', '.join(_edit(f'x[{k}]', _COST, 'K') for k in (1, 2, 4))})
   else least({', '.join(_edit(f'x[{k}]', f'1 + {_COST}', 'R') for k in (1, 2, 4))}) end),
 least({_edit('x[4]', '2', 'D')}, case when r[2] in ('b', 'd') then '~' when r[1] = 'a' then {_edit('x[3]', _COST, 'K')} else {_edit('x[3]', f'1 + {_COST}', 'R')} end)]"""
_INSERT_USER = f"[v[1], v[2], least(v[3], {', '.join(_edit(f'v[{k}]', '5', 'I') for k in (1, 2, 4))}), v[4]]"
_INSERT_ASSISTANT = f"[v[1], v[2], v[3], least(v[4], {_edit('v[3]', '5', 'I')})]"

ORACLE_SQL = {
    # these pages hold the article in one element; its blocks are headings and paragraphs
    "op2_html_extraction": r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') as body from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(body, '</?(p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) as parts from a),
c as (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) as t from b)
select page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') as text,
  length(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) as n_chars from c""",
    "op5_substring_dedup": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, unnest(list_transform(range(1, len(w) - 48), lambda p: struct_pack(p := p, h := md5(array_to_string(w[p:p+49], ' ')))), recursive := true) from d),
firsts as (select h, min(doc_id) as m from win group by h),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as i from win join firsts using (h) where m < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op6_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
test as (select distinct item, least(10, len(w)) as k, array_to_string(w[p:p+9], ' ') as s from (select item, w, unnest(range(1, greatest(2, len(w) - 8))) as p from b where len(w) > 0)),
ks as (select distinct k from test),
win as (select doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda p: struct_pack(p := p, k := k, s := array_to_string(w[p:p+k-1], ' '))), recursive := true) from d, ks),
hit as (select doc_id, p, win.k, item from win join test on win.s = test.s and win.k = test.k),
n as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(p, p + k)) as i from hit) group by doc_id),
i as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join i using (doc_id)""",
    "op7_ngram_jaccard_join": rf"""
with recursive d as (select doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda p: array_to_string(w[p:p+4], ' ')))) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
links as (select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 75 * (x.n + y.n - k)),
two as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, a as r from two union select reach.doc_id, two.b from reach join two on two.a = reach.r),
least_of as (select doc_id, min(r) as r from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(r, d.doc_id) as component_id from d left join n using (doc_id) left join least_of using (doc_id)""",
    "op10_sharding": r"""
with t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 1 as size from documents),
c as (select doc_id, text, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from d, t),
o as (select doc_id, size, crc, sum(size) over w as upto, sum(size) over () as total, row_number() over w as n
  from c window w as (order by md5(text), cast(doc_id as varchar), size rows unbounded preceding)),
p as (select *, least(15, (16 * (2 * upto - size)) // (2 * total)) as shard from o)
select doc_id, size, crc as text_crc32, 'bytes' as law, cast(shard as integer) as shard, n - min(n) over (partition by shard) as slot, cast(null as integer) as grown_shard from p""",
    "op11_conversation_repair": rf"""
with t as ({_CRC_TABLE}),
w as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' '))")} % 20 as what from conversations, t),
d as (select conv_id, turn, case when what = 4 then 'user' else role end as role, case when what = 1 then '' when what = 2 then translate(text, '.!?', '') else text end as text,
  unnest(case when what = 0 then [] when what = 3 then [1, 2] else [1] end) as k from w),
o as (select *, row_number() over c as n, lag(role) over c as before, row_number() over (partition by conv_id, role, text order by turn nulls first, k) > 1 as again,
  regexp_extract_all(text, '[^\x20\x09-\x0D]')[-1] as final from d window c as (partition by conv_id order by turn nulls first, role, text, k)),
f as (select *, case when final is null then 'b' when again then 'd' when final not in ('.', '!', '?') then 't' else '' end as fault from o),
s as (select conv_id, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
  count(*) filter (n > 1 and before[1:1] || role[1:1] not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
  list([role[1:1], fault] order by n) as rows from f group by conv_id),
best as (select conv_id, list_reduce(list_prepend(['000000', '~', '000005I', '000010II'], rows), lambda x, r:
  list_transform([list_transform([{_STEP}], lambda v: {_INSERT_USER})[1]], lambda v: {_INSERT_ASSISTANT})[1]) as x from s),
least_of as (select conv_id, least(x[1], x[4]) as v from best),
edits as (select conv_id, v[7:] as audit, unnest(range(1, length(v) - 5)) as p from least_of),
letters as (select *, audit[p:p] as l, count(*) filter (audit[p:p] <> 'I') over (partition by conv_id order by p) as n from edits),
turned as (select e.conv_id, p, l, role, text, count(*) filter (not (l = 'K' and role[1:1] = 's')) over (partition by e.conv_id order by p) as place
  from letters e left join f on e.conv_id is not distinct from f.conv_id and e.n = f.n and l <> 'I' where l <> 'D'),
fixed as (select conv_id, string_agg(case when l = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end || ':' || case when l = 'I' then '' else text end, chr(10) order by p) as turns from turned group by conv_id)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cast(v[1:6] as bigint), 0) as cost, coalesce(v[7:], '') as audit, sha256(coalesce(turns, '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join s on i.conv_id is not distinct from s.conv_id left join least_of on i.conv_id is not distinct from least_of.conv_id
left join fixed on i.conv_id is not distinct from fixed.conv_id""",
    "op12_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20""",
    "op13_prefix_trie": rf"""
with t as ({_CRC_TABLE}),
o as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos from conversations where conv_id is not null),
i as (select c, {_crc("cast(c as varchar)")} % 4 as h from (select distinct c from o), t),
r as (select i.c, 0 as part, pos, role, text from i join o on o.c = i.c - i.c % 20 and pos < h union all select i.c, 1, pos, role, text from i join o on o.c = i.c and pos >= h),
l as (select c, list(length(role) || ':' || role || text order by part, pos) as said, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) order by part, pos) as words from r group by c),
p as (select i.c, coalesce(said, []) as said, coalesce(words, []) as words from i left join l on i.c = l.c),
m as (select c, d, md5(to_json(said[1:d])::varchar) as node, md5(to_json(said[1:d-1])::varchar) as up, case when d > 0 then words[d] else 0 end as w, len(said) = d as ends
  from (select c, said, words, unnest(range(0, len(said) + 1)) as d from p)),
n as (select node, d, any_value(case when d > 0 then up end) as up, min(c) as conv, count(*) as n, any_value(w) as w, string_agg(c, ',' order by c) filter (ends) as ids from m group by node, d),
k as (select up, d - 1 as d, count(*) as k from n where d > 0 group by all),
x as (select n.*, coalesce(k, 0) as k from n left join k on n.node = k.up and n.d = k.d),
b as (select m.node, m.d, sum(cast(x.k = 0 as int)) as leaves, sum((x.n - 1) * x.w) as saved from x join m on m.c = x.conv and m.d <= x.d group by m.node, m.d)
select x.conv as conv_id, x.d as depth, y.conv as parent_conv_id, x.n as n_convs, x.k as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(x.ids, '')) as ends_sha256
from x join b on x.node = b.node and x.d = b.d left join x y on x.up = y.node and x.d = y.d + 1""",
}
