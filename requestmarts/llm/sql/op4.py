"""Benchmark decontamination, by all windows of both tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
with d as (select doc_id, row_number() over () as r, coalesce({WORDS}, []) as words from documents),
b as (select item_id, {WORDS} as words from benchmark where text is not null),
i as (select item_id, words, least(len(words), 13) as size from b where len(words) > 0),
iw as (
  select distinct item_id, size, array_to_string(words[s:s + size - 1], ' ') as w
  from (select *, unnest(range(1, len(words) - size + 2)) as s from i)
),
dw as (
  select r, s, size, array_to_string(words[s:s + size - 1], ' ') as w
  from (select *, unnest(range(1, len(words) - size + 2)) as s from d, (select distinct size from i))
),
m as (select r, s, dw.size, item_id from dw join iw on dw.w = iw.w and dw.size = iw.size),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(s, s + size)) as j from m) group by r),
it as (
  select r, count(distinct item_id) as n_items,
    string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items
  from m group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join hit using (r) left join it using (r)
"""
