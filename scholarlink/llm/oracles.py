"""DuckDB SQL for the operators whose result SQL can express, written from their contracts: whole windows and sets, no index and no hash order."""

from __future__ import annotations

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Later copies of runs of two lines or more, of lines of 50 words or more, and of lines that are a whole document.
OP1 = rf"""
with lines as (select doc_id, line, content, lead(content) over (partition by doc_id order by line) as next, count(*) over (partition by doc_id) = 1 as sole
    from (select doc_id, unnest(range(len(l))) as line, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))),
pairs as (select doc_id, line, min((doc_id, line)) over (partition by content, next) as first from lines where next is not null),
singles as (select doc_id, line, min((doc_id, line)) over (partition by content) as first,
    case when sole then regexp_matches(content, '[^\x20\x09-\x0D]') else len({WORDS.replace("text", "content")}) >= 50 end as counts from lines),
gone as (select doc_id, line from pairs where (doc_id, line) > first union select doc_id, line + 1 from pairs where (doc_id, line) > first union select doc_id, line from singles where counts and (doc_id, line) > first),
kept as (select doc_id, count(*) as n_lines, count(g.line) as n_removed, coalesce(string_agg(content, chr(10) order by l.line) filter (where g.line is null), '') as text from lines l left join gone g using (doc_id, line) group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(k.text) as kept_sha256 from documents d left join kept k using (doc_id)"""

#: Windows of 50 words that also start in a document with a smaller doc_id.
OP4 = f"""
with docs as (select doc_id, {WORDS} as w from documents),
words as (select doc_id, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from docs),
starts as (select doc_id, j, md5(array_to_string(w[j:j + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as j from docs where len(w) >= 50)),
later as (select doc_id, j from (select doc_id, j, min(doc_id) over (partition by h) as first from starts) where doc_id > first),
marked as (select words.*, max(case when later.j is null then 0 else 1 end) over (partition by doc_id order by words.j rows between 49 preceding and current row) as gone from words left join later using (doc_id, j)),
kept as (select doc_id, sum(gone) as n_removed, string_agg(word, ' ' order by j) filter (where gone = 0) as text from marked group by doc_id)
select docs.doc_id, coalesce(len(w), 0) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from docs left join kept using (doc_id)"""

#: Windows of 10 words of benchmark items, or the whole of shorter ones, anywhere in a document.
OP6 = rf"""
with docs as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select cast(item_id as varchar) as item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as phrase from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows) where len(w) >= n)),
hits as (select distinct doc_id, i, n, item_id from places join windows using (n, phrase)),
covered as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hits group by doc_id)
select doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (doc_id) left join found using (doc_id)"""

#: Jaccard similarity of 0.75 or more between sets of 5-word shingles, all pairs that share one, and what they link.
OP7 = f"""
with recursive docs as (select doc_id, {WORDS.replace("text", LOWERED)} as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as o from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
reach as (select doc_id as a, doc_id as b from docs union select reach.a, links.b from reach join links on links.a = reach.b)
select doc_id, coalesce(n, 0) as n_shingles, component_id from (select a as doc_id, min(b) as component_id from reach group by a) left join sizes using (doc_id)"""

#: Positions of code points from the tokens' lengths; the text that has to come back is the text.
OP11 = r"""
with cut as (select doc_id, coalesce(text, '') as text, list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda t: length(t)) as sizes, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (select *, len(sizes) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from cut),
placed as (select *, coalesce(list_sum(sizes[1:least(h1 % (n + 1), h2 % (n + 1))]), 0) as p, coalesce(list_sum(sizes[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0) as m,
    case when text = '' or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from drawn)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then p end as bigint) as prefix_chars, cast(case when form <> 'plain' then m - p end as bigint) as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || substring(text, 1, cast(p as bigint)) || '<S>' || substring(text, cast(m as bigint) + 1) || '<M>' || substring(text, cast(p as bigint) + 1, cast(m - p as bigint))
        else '<S>' || substring(text, cast(m as bigint) + 1) || '<P>' || substring(text, 1, cast(p as bigint)) || '<M>' || substring(text, cast(p as bigint) + 1, cast(m - p as bigint)) end) as output_sha256,
    sha256(text) as restored_sha256 from placed"""

#: All documents through all orders one by one: a document is at a step if it has passed every filter before.
OP12 = rf"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
words as (select *, {WORDS} as w from texts),
rated as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
flags as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(words.doc_id > min(words.doc_id) over (partition by text), false)}} as f from words left join rated using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select [a.x, b.x, c.x, d.x, e.x] as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, unnest(range(1, 6)) as step from orders),
states as (select part, array_to_string(o, '') as filter_order, step, o[step] as filter, good, toxic,
    list_bool_or(list_transform(o[1:step - 1], lambda x: case x when 'A' then f.A when 'B' then f.B when 'C' then f.C when 'D' then f.D else f.E end)) as earlier,
    case o[step] when 'A' then f.A when 'B' then f.B when 'C' then f.C when 'D' then f.D else f.E end as fails,
    cast(f.A as int) + cast(f.B as int) + cast(f.C as int) + cast(f.D as int) + cast(f.E as int) as failures from flags, steps),
counts as (select part, filter_order, cast(step as int) as step, filter, count(*) filter (where not coalesce(earlier, false) and not fails) as kept, count(*) filter (where not coalesce(earlier, false) and fails) as removed,
    count(*) filter (where earlier and fails) as redundant, count(*) filter (where fails and failures = 1) as unique_fails,
    count(*) filter (where not coalesce(earlier, false) and fails and good) as good_lost, count(*) filter (where not coalesce(earlier, false) and fails and toxic) as toxic_lost from states group by all)
select *, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from counts"""

#: Every query against every other row.
OP13 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
scored as (select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10"""

ORACLES = {"op11_fill_in_middle": OP11, "op12_filter_audit": OP12, "op13_exact_topk": OP13, "op1_line_dedup": OP1, "op4_substring_dedup": OP4, "op6_decontamination": OP6, "op7_ngram_jaccard": OP7}
