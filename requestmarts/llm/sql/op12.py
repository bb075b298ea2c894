"""DuckDB SQL of the source divergence audit: counts by term text, pairs over all kept terms."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARE = "1 + (1000000000::hugeint * ({c} + 2)) // ({n} + 2 * v)"

SQL = rf"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
),
tokens as (select r, lang, source, unnest(w) as term from docs),
kept as (select lang, term from tokens group by lang, term having count(distinct r) >= 10),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as c from tokens semi join kept using (lang, term) group by all),
totals as (
  select g.lang, g.source, coalesce(sum(c), 0) as n from groups g left join counts using (lang, source) group by all
),
own as (
  select t.lang, t.source, k.term, coalesce(c.c, 0) as c, {SHARE.format(c="coalesce(c.c, 0)", n="t.n")} as p
  from totals t join sizes using (lang) join kept k using (lang)
    left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
),
lang_n as (select lang, sum(n) as n from totals group by lang),
lang_c as (select lang, term, sum(c) as c from counts group by lang, term),
whole as (
  select k.lang, k.term, {SHARE.format(c="coalesce(c.c, 0)", n="l.n")} as q
  from kept k join sizes using (lang) join lang_n l using (lang) left join lang_c c on c.lang = k.lang and c.term = k.term
),
sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from own a join own b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
),
terms as (
  select o.lang, o.source, 'term' as part, o.term as item, (p - q) * (p - q) // (p + q) as value
  from own o join whole w on w.lang = o.lang and w.term = o.term
  where o.c > 0 and p > q
),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value::bigint as value, rank::int as rank
from ranked where part = 'pair' or rank <= 10
"""
