"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE["op6_quality_rules"] = f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents
), g as (
  select r, i, list_slice(w, i, i + 4) as g from (select r, w, unnest(range(1, len(w) - 3)) as i from d)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1
), covered as (
  select r, count(distinct i + k) as n from twice, (select unnest(range(0, 5)) as k) group by r
), m as (
  select doc_id, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words,
    cast(len(l) as bigint) as n_lines,
    cast(length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) as bigint) as n_upper,
    cast(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as bigint) as n_stutter
  from d left join covered using (r)
), f as (
  select *, cast((n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int
    + 4 * (100 * n_symbols > 20 * n_words)::int + 8 * (100 * n_upper > 50 * word_chars)::int
    + 16 * (100 * n_dup_lines > 50 * n_lines)::int + 32 * (100 * n_stutter > 30 * n_words)::int
    + 64 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::int as bigint) as failed_rules
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_rules & 3) <> 0 as base_failed, failed_rules = 0 as kept, failed_rules, n_lines, n_upper, n_stutter
from f
"""

ORACLE["op8_line_dedup"] = """
with d as (
  select row_number() over () as r, doc_id, text, string_split(coalesce(text, ''), chr(10)) as a from documents
), l as (
  select r, doc_id, a, list_filter(range(1, len(a) + 1), lambda i: regexp_matches(a[i], '[^\\x20\\x09-\\x0D]')) as idx from d
), w as (
  select r, doc_id, j, [a[idx[j]], a[idx[j + 1]], a[idx[j + 2]]] as g, [idx[j], idx[j + 1], idx[j + 2]] as p
  from (select *, unnest(range(1, len(idx) - 1)) as j from l)
), later as (
  select r, p from (select *, row_number() over (partition by g order by doc_id, j) as k from w) where k > 1
), gone as (
  select r, list(distinct i) as gone from (select r, unnest(p) as i from later) group by r
)
select d.doc_id, cast(len(idx) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  case when gone is null then d.text else coalesce(array_to_string(
    list_transform(list_filter(range(1, len(d.a) + 1), lambda i: not list_contains(gone, i)), lambda i: d.a[i]), chr(10)), '') end as text
from d join l using (r) left join gone using (r)
"""

TARGETS = """
sized as (select doc_id, source, cast(len({words}) as bigint) as size from {documents}),
by_source as (
  select *, (5 - 3 * (place % 3 = 1)::int - 4 * (place % 3 = 2)::int)::bigint as weight, 2 * source_size as lim
  from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
        from sized group by source)
),
levels as (
  select *, (3 * sum(source_size) over () - 2 * coalesce(sum(lim) over (l rows between unbounded preceding and 1 preceding), 0))::double * weight
      > lim::double * 2 * sum(weight) over (l rows between current row and unbounded following) as is_full
  from by_source window l as (order by source_size / weight, source nulls last)
),
targets as (
  select source, source_size, case when is_full then lim::double else
    (weight * (3 * sum(source_size) over () - 2 * sum(case when is_full then lim else 0 end) over ()))::double
    / (2 * sum(case when is_full then 0 else weight end) over ())::double end as target
  from levels
),
rates as (
  select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    cast('0x' || substr(md5('mix-1:' || coalesce(cast(s.doc_id as varchar), '')), 1, 13) as bigint)::double / 4503599627370496.0 as u
  from sized s join targets t on s.source is not distinct from t.source
)
"""

ORACLE["op2_source_mixing"] = f"""
with {TARGETS.format(words=_WORDS, documents="documents")}
select doc_id, size, source_size, target,
  cast(size * (floor(rate) + (u < rate - floor(rate))::int) as bigint) as taken
from rates
"""

ORACLE["op12_exact_dedup"] = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

_ITEM = "coalesce(cast(octet_length(encode(cast({0} as varchar))) as varchar) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_ITEM.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
# the usual CRC-32, bit by bit: a byte is mixed in, then eight shifts
_CRC32 = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as ubigint), flatten(list_transform(
    range(1, length(cast(doc_id as varchar)) + 1), lambda i: [cast(ascii(substr(cast(doc_id as varchar), i, 1)) as ubigint), 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda c, x: case when x < 256 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end))"""

ORACLE["op11_merkle_manifest"] = f"""
with recursive leaf as (
  select doc_id, source, {_LEAF.format(text="text")} as h,
    {_LEAF.format(text=f"(case when {_CRC32} % 2 = 0 then replace(text, chr(10), '') else text end)")} as changed
  from documents
), placed as (
  select *, row_number() over (partition by source order by doc_id, h) - 1 as place from leaf
), up(source, l, i, h) as (
  select source, 0, place, h from placed
  union all
  select source, l + 1, i // 3, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over (partition by source) as c from up) where c > 1 group by source, l, i // 3
), subroot as (
  select source, max(l) as top, max_by(h, l) as h, row_number() over (order by source nulls first) - 1 as place from up group by source
), over_up(l, i, h) as (
  select 0, place, h from subroot
  union all
  select l + 1, i // 3, sha256(string_agg(h, '' order by i)) from over_up where (select count(*) from over_up) > 1 group by l, i // 3
), root as (
  select max(l) as top, max_by(h, l) as h from over_up
), siblings as (
  select p.doc_id, p.h as leaf, 0 as part, u.l, u.i, u.h
  from placed p join up u on u.source is not distinct from p.source
    and u.i // 3 = p.place // cast(pow(3, u.l + 1) as bigint) and u.i <> p.place // cast(pow(3, u.l) as bigint)
  union all
  select p.doc_id, p.h, 1, u.l, u.i, u.h
  from placed p join subroot s on s.source is not distinct from p.source
  join over_up u on u.i // 3 = s.place // cast(pow(3, u.l + 1) as bigint) and u.i <> s.place // cast(pow(3, u.l) as bigint)
), proof as (
  select doc_id, leaf, sha256(string_agg(h, '' order by part, l, i)) as p from siblings group by 1, 2
), fold(doc_id, leaf, source, l, i, h) as (
  select doc_id, h, source, 0, place, changed from placed
  union all
  select f.doc_id, f.leaf, f.source, f.l + 1, f.i // 3, sha256(string_agg(case when u.i = f.i then f.h else u.h end, '' order by u.i))
  from fold f join subroot s on s.source is not distinct from f.source and f.l < s.top
  join up u on u.source is not distinct from f.source and u.l = f.l and u.i // 3 = f.i // 3
  group by f.doc_id, f.leaf, f.source, f.l, f.i
), over_fold(doc_id, leaf, l, i, h) as (
  select f.doc_id, f.leaf, 0, s.place, f.h from fold f join subroot s on s.source is not distinct from f.source and f.l = s.top
  union all
  select f.doc_id, f.leaf, f.l + 1, f.i // 3, sha256(string_agg(case when u.i = f.i then f.h else u.h end, '' order by u.i))
  from over_fold f join root r on f.l < r.top join over_up u on u.l = f.l and u.i // 3 = f.i // 3
  group by f.doc_id, f.leaf, f.l, f.i
)
select p.doc_id, p.h as leaf, s.h as subroot, r.h as root, coalesce(q.p, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from placed p join subroot s on s.source is not distinct from p.source cross join root r
left join proof q on q.doc_id is not distinct from p.doc_id and q.leaf = p.h
join over_fold f on f.l = r.top and f.doc_id is not distinct from p.doc_id and f.leaf = p.h
"""

ORACLE["op13_hard_negatives"] = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0
), p as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as k
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
)
select anchor_id, positive_id, cast(k as integer) as rank, negative_id, positive_score, negative_score from n where k <= 5
"""

ORACLE["quality_ablation"] = f"""
with rows as ({ORACLE["op6_quality_rules"]}),
cases as (
  select * from (values ('base', 3), ('v1', 15), ('v2', 127)) as p(policy, mask),
    (values ('few_words', 1), ('repeated_words', 2), ('many_symbols', 4), ('shouting', 8), ('repeated_lines', 16), ('stutter', 32), ('odd_word_length', 64)) as r(rule, bit)
  where mask & bit <> 0
)
select policy, rule, cast(count_if(failed_rules & bit <> 0) as bigint) as n_failed,
  cast(count_if(failed_rules & mask = bit) as bigint) as n_only, cast(count_if(failed_rules & mask <> 0) as bigint) as n_rejected
from rows, cases group by policy, rule
"""
