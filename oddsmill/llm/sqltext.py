"""Reference SQL (DuckDB) of the operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op5_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""

ORACLES["op8_mixing"] = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5('8|' || coalesce(cast(doc_id as varchar), '')) as k from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size,
    1.0::double + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source
), r as (
  select *, source_size * 3.0::double as cap, sum(source_size) over () as total, sum(w) over () as weights,
    row_number() over (order by source_size * 3.0::double / w, source nulls last) as place from s
), a as (
  select *, (total - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0))
    / (weights - coalesce(sum(w) over (order by place rows between unbounded preceding and 1 preceding), 0)) as rate from r
), t as (
  select source, source_size, case when cap <= rate * w then cap else
    (select b.rate from a b where not b.cap <= b.rate * b.w order by b.place limit 1) * w end as target from a
), p as (
  select doc_id, size, source_size, target, cast(round(target) as bigint) as budget,
    coalesce(sum(size) over (partition by d.source order by k, size rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source
), e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
  cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) as bigint) as taken from e
"""

# No seeds: words that agree on a diagonal, counted in every window of an item that begins with one of them. A window that
# runs over the item's end counts no more than the last whole one.
ORACLES["op10_decontamination"] = r"""
with items as (
  select row_number() over () as item, item_id, w, least(13, len(w)) as n from (
    select w, min(item_id) as item_id from (select item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from benchmark)
    where len(w) > 0 group by w)
), texts as (
  select row_number() over () as t, text, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from (select distinct text from documents where text is not null)
), iw as (select item, n, n - n * 2 // 13 as need, unnest(w) as word, unnest(range(len(w))) as j from items),
tw as (select t, unnest(w) as word, unnest(range(len(w))) as i from texts),
agree as (select t, item, i - j as d, j, n, need from tw join iw using (word)),
long_enough as (select t, item, d from agree group by t, item, d having count(*) >= any_value(need)),
windows as (
  select t, item, need, count(*) over (partition by t, item, d order by j range between current row and n - 1 following) as same
  from agree join long_enough using (t, item, d)
), best as (select t, item, max(same) as best from windows where same >= need group by t, item),
found as (
  select text, count(*) as n_items, min(item_id) as item_id, max(best) as overlap
  from best join texts using (t) join items using (item) group by text
)
select d.doc_id, f.text is not null as contaminated, coalesce(n_items, 0) as n_items, item_id, coalesce(overlap, 0) as overlap
from documents d left join found f on d.text = f.text
"""

ORACLES["op11_collocations"] = r"""
with p as (
  select coalesce(lang, 'und') as lang, row_number() over () as piece, piece as words from (
    select lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), w as (select lang, regexp_extract_all(words, '[^ \t]+') as w from p),
totals as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (
    select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) as sizes(k)) g
), f as (select lang, k, phrase, cast(count(*) as bigint) as c from grams group by all having count(*) >= 10),
cuts as (
  select lang, k, phrase, c as a, cut, string_split(phrase, ' ') as s from f, (values (1), (2)) as cuts(cut) where k > cut
), sides as (
  select c.lang, c.k, c.phrase, c.a, c.cut, l.c as l, r.c as r,
    cast((1000000::hugeint * c.a * c.a) // (l.c::hugeint * r.c) as bigint) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.s[1 : c.cut], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.s[c.cut + 1 : c.k], ' ')
), best as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as o from sides) where o = 1
), kept as (
  select * from best b where not exists (
    select 1 from best t where t.k = 3 and b.k = 2 and t.lang = b.lang and 100 * t.a >= 50 * b.a
      and (starts_with(t.phrase, b.phrase || ' ') or ends_with(t.phrase, ' ' || b.phrase)))
)
select lang, rank, phrase, a, l, r, n, score from (
  select k.*, n, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept k join totals using (lang))
where rank <= 2000
"""

# Positions are the running lengths of what lies between the matches and of the matches.
ORACLES["op13_secrets"] = r"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
kinds as (
  select * from (values (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'owned')) as k(kind, name)
), m as (
  select row, 0 as kind, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as found,
    regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) as vals,
    regexp_split_to_array(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as gaps from d
  union all select row, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') from d
  union all select row, 2, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_split_to_array(text, '[0-9a-f]{24,}') from d
  union all select row, 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{16,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{16,}'),
    regexp_split_to_array(text, '[A-Za-z0-9+/_=-]{16,}') from d
), spans as (
  select row, kind, value, start, start + length(whole) as finish from (
    select row, kind, found[i] as whole, vals[i] as value,
      cast(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) as bigint) as start
    from (select *, unnest(range(1, len(found) + 1)) as i from m))
  where length(value) >= case kind when 0 then 6 when 1 then 20 when 2 then 24 else 16 end
    and (kind < 3 or regexp_matches(value, '[A-Za-z]') and regexp_matches(value, '[0-9]'))
), apart as (
  select * from spans s where kind < 3 or not exists (select 1 from spans b where b.row = s.row and b.kind < 3 and b.start < s.finish and s.start < b.finish)
), owners as (
  select value, count(distinct coalesce('=' || source, '')) as owners, max(cast(kind < 3 as int)) = 1 as labelled from apart join d using (row) group by value
), judged as (
  select a.*, case when owners >= 3 then 'example' else 'owned' end as verdict from apart a join owners o using (value)
  where kind < 3 or owners < 3 and (labelled or regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]')
    and length(value) >= 20 and len(list_distinct(string_split(value, ''))) >= 10)
)
select d.doc_id, cast(count(*) filter (j.kind = 0) as bigint) as n_assign, cast(count(*) filter (j.kind = 1) as bigint) as n_access,
  cast(count(*) filter (j.kind = 2) as bigint) as n_hex, cast(count(*) filter (j.kind = 3) as bigint) as n_owned,
  sha256(coalesce(string_agg(name || ':' || start || ':' || finish, ',' order by start, j.kind) filter (j.kind < 3), '')) as base_sha256,
  coalesce(string_agg(name || ':' || start || ':' || finish, ',' order by start, j.kind), '') as spans,
  cast(count(*) filter (verdict = 'example') as bigint) as n_example
from d left join judged j using (row) left join kinds k on k.kind = j.kind group by d.row, d.doc_id
"""
