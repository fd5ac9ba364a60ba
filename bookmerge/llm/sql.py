"""SQL twins of the operators' queries, for an engine that checks results on small tables."""

from __future__ import annotations

import string

from bookmerge.llm import jaccard_join, line_dedup, prefix_trie, quality_rules, url_filters
from bookmerge.llm.decontaminate import WINDOW

_LOW = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_WORD = r"[^\x20\x09-\x0D]+"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, {_LOW}), '{_TOKEN}'), []) as w from documents),
iw as (select item_id, regexp_extract_all(translate(text, {_LOW}), '{_TOKEN}') as w from benchmark),
win as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as key from (select item_id, w, least({WINDOW}, len(w)) as size, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as i from iw where len(w) > 0)),
dwin as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as key from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, (select distinct size from win))),
hit as (select distinct doc_id, i, size, item_id from dwin join win using (size, key)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hit) group by doc_id),
ids as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by doc_id),
place as (select doc_id, i, sum(length(gap) + length(word)) over (partition by doc_id order by i) as upto, length(word) as n from (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, unnest(gaps[:len(w)]) as gap
  from (select doc_id, w, regexp_split_to_array(translate(text, {_LOW}), '{_TOKEN}') as gaps from documents join dw using (doc_id) where doc_id in (select doc_id from hit)))),
run as (select doc_id, min(p) as a, max(p) as b from (select doc_id, p, p - row_number() over (partition by doc_id order by p) as g from (select distinct doc_id, unnest(range(i, i + size)) as p from hit)) group by doc_id, g),
said as (select run.doc_id, string_agg(concat(x.upto - x.n, ':', y.upto), ',' order by run.a) as spans from run join place x on x.doc_id = run.doc_id and x.i = run.a join place y on y.doc_id = run.doc_id and y.i = run.b group by run.doc_id)
select dw.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(spans, '') as spans
from dw left join pos using (doc_id) left join ids using (doc_id) left join said using (doc_id)
"""

QUALITY_RULES = f"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as host from documents),
w as (select *, regexp_extract_all(t, '{_WORD}') as w from d),
g as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by doc_id),
l as (select doc_id, host, t, line, regexp_extract_all(line, '{_WORD}') as lw from (select *, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{_WORD}')),
k as (select *, translate(array_to_string(lw, ' '), {_LOW}) as key from l),
dup as (select doc_id, count(*) - count(distinct line) as n from l group by doc_id),
hosts as (select host, count(distinct doc_id) as docs from d group by host),
often as (select host, key from (select host, key, count(distinct doc_id) as n from k group by host, key) join hosts using (host) where n > greatest({quality_rules.LOW}, {quality_rules.SHARE} * docs)),
gone as (select doc_id, sum(len(lw)) as n from k join often using (host, key) group by doc_id),
b as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as n_boilerplate_words
  from w left join dup using (doc_id) left join rep using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and n_boilerplate_words <= {quality_rules.MAX_REMOVED} * n_words as kept, n_boilerplate_words from b
"""

LINE_DEDUP = rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOW}) as key from l),
f as (select key, min(doc_id) as owner from k where length(key) >= {line_dedup.MIN_POINTS} group by key),
r as (select k.*, coalesce(owner, doc_id) = doc_id as keep from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (not keep) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (keep), '')) as kept_sha256 from r group by doc_id
"""

JACCARD_JOIN = f"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, {_LOW}), '{_WORD}'), []) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as n_both from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * n_both >= {jaccard_join.PERCENT} * (na.n + nb.n - n_both)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select a, b from both_ways union select reach.a, x.b from reach join both_ways x on x.a = reach.b),
c as (select a as doc_id, least(a, min(b)) as component from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component, w.doc_id) as component_id from w left join n using (doc_id) left join c using (doc_id)
"""

SQL = {"op1_decontaminate": DECONTAMINATE, "op2_quality_rules": QUALITY_RULES, "op3_url_filters": url_filters.oracle(), "op7_line_dedup": LINE_DEDUP, "op10_jaccard_join": JACCARD_JOIN, "op11_prefix_trie": prefix_trie.ORACLE}
