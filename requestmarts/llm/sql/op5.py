"""Rule ledger."""

SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
),
g as (
  select *, row_number() over () as r,
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) as grams
  from w
),
p as (select r, unnest(grams) as gram, unnest(range(1, len(grams) + 1)) as i from g),
twice as (select r, i from p qualify count(*) over (partition by r, gram) > 1),
hit as (
  select r, count(distinct j) as n_repeat_words
  from (select r, unnest([i, i + 1, i + 2]) as j from twice) group by r
),
m as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines, len(regexp_extract_all(t, '!'))::bigint as n_exclamations
  from g left join hit using (r)
),
b as (
  select *,
    (case when n_words < 50 then 1 else 0 end
    + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 15 * n_words then 8 else 0 end
    + case when 10 * n_dup_lines > 5 * n_lines then 16 else 0 end
    + case when 10 * n_exclamations > 3 * n_words then 32 else 0 end)::bigint as failed_bits
  from m
)
select *, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, 'web-2' as policy from b
"""

#: Rows that fail each rule of each policy, fail it alone, and are kept with and without it.
ABLATIONS = f"""
with ledger as ({SQL}),
rules(rule, bit) as (
  values ('too_few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('word_length', 8), ('duplicate_lines', 16),
    ('emphasis', 32)
),
policies(policy, mask) as (values ('base-1', 3), ('web-1', 31), ('web-2', 63))
select policy, rule,
  count(*) filter ((failed_bits & bit) <> 0) as failed,
  count(*) filter ((failed_bits & mask) = bit) as failed_only_this,
  count(*) filter ((failed_bits & mask) = 0) as kept,
  count(*) filter ((failed_bits & mask & ~bit) = 0) as kept_without
from (select failed_bits from ledger) as l cross join policies join rules on (mask & bit) <> 0
group by policy, rule
"""
