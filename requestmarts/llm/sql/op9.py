"""Hierarchical budgeting: one level of the tree after another."""

WEIGHTS = """(values ('d0', 4), ('d1', 3), ('d2', 2), ('d3', 1),
  ('d0/en', 5), ('d1/en', 5), ('d2/en', 5), ('d3/en', 5)) v(node, weight)"""


def level(name: str, above: str, node: str, parent: str) -> str:
    """Budgets of the nodes of a level from those of the level above."""
    return f"""
{name}_n as (
  select {node} as node, {parent} as parent, (sum(tokens) * 2)::hugeint as capacity from leaves group by 1, 2
),
{name}_c as (
  select n.node, n.parent, capacity, coalesce(weight, 1)::hugeint as weight, budget as given
  from {name}_n n join {above} a on a.node = n.parent left join {WEIGHTS} on v.node = n.node
),
{name}_u as (
  select *,
    coalesce(sum(capacity) over (o rows between unbounded preceding and 1 preceding), 0)::hugeint as used,
    (sum(weight) over (o rows between current row and unbounded following))::hugeint as weights
  from {name}_c window o as (partition by parent order by capacity::double / weight::double, node)
),
{name}_f as (select *, capacity * weights <= (given - used) * weight as filled from {name}_u),
{name}_r as (
  select *,
    coalesce(sum(capacity) filter (filled) over (partition by parent), 0)::hugeint as taken,
    (sum(weight) filter (not filled) over (partition by parent))::hugeint as open
  from {name}_f
),
{name} as (
  select node, case when filled then capacity else (given - taken) * weight // open end as budget from {name}_r
)"""


SQL = rf"""
with rows as (
  select doc_id, coalesce(lang, '?') as lang, coalesce(source, '?') as source,
    (len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::bigint as n_tokens,
    md5(coalesce(text, '')) as digest, row_number() over () as r
  from documents
),
domains as (
  select *, case when md5(source) < '4' then 'd0' when md5(source) < '8' then 'd1'
    when md5(source) < 'c' then 'd2' else 'd3' end as domain
  from rows
),
tree as (select *, domain || '/' || lang || '/' || source as leaf from domains),
leaves as (select domain, lang, source, leaf, sum(n_tokens)::hugeint as tokens from tree group by 1, 2, 3, 4),
root as (select '' as node, least(sum(tokens)::hugeint * 80 // 100, sum(tokens)::hugeint * 2) as budget from leaves),
{level("l1", "root", "domain", "''")},
{level("l2", "l1", "domain || '/' || lang", "domain")},
{level("l3", "l2", "leaf", "domain || '/' || lang")},
spent as (
  select leaf, budget::bigint as leaf_budget,
    (case when tokens = 0 then 1 else budget // tokens end)::bigint as whole,
    (case when tokens = 0 then 0 else budget % tokens end)::bigint as part
  from leaves join l3 on l3.node = leaf
),
ordered as (
  select t.*, leaf_budget, whole, part,
    sum(n_tokens) over (partition by t.leaf order by md5('17:' || whole || ':' || doc_id || ':' || digest), doc_id
      rows unbounded preceding) as upto
  from tree t join spent s on s.leaf = t.leaf
)
select doc_id, domain, lang, source, n_tokens, leaf_budget,
  least(whole + case when upto - n_tokens < part then 1 else 0 end, 2)::bigint as copies
from ordered
"""
