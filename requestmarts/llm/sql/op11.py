"""DuckDB SQL of the filter interaction audit: every order is walked, and Shapley is the plain sum over orders."""

SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
),
firsts as (select t, min(doc_id) as first_id from docs group by t),
marked as (
  select d.part,
         (len(w) < 100)::int as fa,
         (100 * len(list_distinct(w)) < 80 * len(w))::int as fb,
         (100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t))::int as fc,
         regexp_matches(d.t, '[#$%&*|]')::int as fd,
         coalesce(f.first_id < d.doc_id, false)::int as fe,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)::int as good,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)::int as toxic
  from docs d join firsts f on f.t = d.t
),
hist as (
  select part, [fa, fb, fc, fd, fe] as fails, good, toxic, count(*) as n from marked group by all
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 3, 4, 5]) as i),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.i, b.i, c.i, d.i, e.i] as path
  from letters a, letters b, letters c, letters d, letters e
  where a.i not in (b.i, c.i, d.i, e.i) and b.i not in (c.i, d.i, e.i) and c.i not in (d.i, e.i) and d.i <> e.i
),
steps as (select filter_order, path, k::int as step, path[k] as f from orders, range(1, 6) r(k)),
walked as (
  select h.part, s.filter_order, s.step, s.f,
         h.n, h.good, h.toxic, h.fails[s.f] = 1 as fails_own,
         list_sum(h.fails) = 1 as one_only,
         coalesce(list_sum([h.fails[x] for x in s.path[1:s.step - 1]]), 0) > 0 as gone
  from hist h, steps s
),
counted as (
  select part, filter_order, step, f,
         coalesce(sum(n) filter (where not gone and not fails_own), 0)::bigint as kept,
         coalesce(sum(n) filter (where not gone and fails_own), 0)::bigint as removed,
         coalesce(sum(n) filter (where gone and fails_own), 0)::bigint as redundant,
         coalesce(sum(n) filter (where fails_own and one_only), 0)::bigint as unique_fails,
         coalesce(sum(n) filter (where not gone and fails_own and good = 1), 0)::bigint as good_lost,
         coalesce(sum(n) filter (where not gone and fails_own and toxic = 1), 0)::bigint as toxic_lost
  from walked group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""
