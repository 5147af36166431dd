"""DuckDB SQL for the queries that SQL can express."""

from . import licenses

OP4 = r"""
with vectors as (
  select row_number() over () as number, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.number, q.vec_id as query_id, r.vec_id, list_dot_product(q.v, r.v)::bigint as score
  from vectors q join vectors r on q.number <> r.number and len(q.v) = len(r.v) where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by number order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 5
"""

OP5 = r"""
with words as (
  select doc_id, w, pos from (
    select doc_id, unnest(x) as w, generate_subscripts(x, 1) as pos
    from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as x from documents)
  )
),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as x from benchmark
),
windows as (
  select distinct item_id, array_to_string(x[k:k + 9], ' ') as phrase, least(len(x), 10) as n
  from (select item_id, x, unnest(range(1, greatest(len(x) - 9, 1) + 1)) as k from items where len(x) > 0)
),
lists as (select doc_id, list(w order by pos) as x from words group by doc_id),
spots as (
  select doc_id, k, n, array_to_string(x[k:k + n - 1], ' ') as phrase
  from (select doc_id, x, n, unnest(range(1, len(x) - n + 2)) as k from lists, (select distinct n from windows) where len(x) >= n)
),
found as (select doc_id, k, spots.n, item_id from spots join windows on spots.phrase = windows.phrase and spots.n = windows.n),
hits as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(k, k + n)) as pos from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from found) group by doc_id),
sizes as (select doc_id, count(*) as n_words from words group by doc_id),
-- proximity: of a window of ten words, nine stand within two words of their places
whole as (select row_number() over () as number, phrase, string_split(phrase, ' ') as x from (select distinct phrase from windows where n = 10)),
spread as (select number, j - 1 as j, x[j] as w from (select number, x, unnest(range(1, 11)) as j from whole)),
often as (select w, count(*) as n from words group by w),
rarest as (
  select number, j, w from spread left join often using (w)
  qualify row_number() over (partition by number order by coalesce(n, 0), j) <= 2
),
starts as (select distinct number, doc_id, pos - 1 - j + d as start from rarest join words using (w), (select unnest([-2, -1, 0, 1, 2]) as d)),
close as (
  select number, doc_id, start from starts join spread using (number)
  join words using (doc_id, w) where pos - 1 between start + j - 2 and start + j + 2
  group by number, doc_id, start having count(distinct j) >= 9
),
nears as (
  select distinct doc_id, greatest(start, 0) as first, least(start + 10, n_words) as past from close join sizes using (doc_id)
  union select doc_id, k - 1, k - 1 + n from found where n < 10
),
near_words as (select doc_id, count(*) as n_near from (select distinct doc_id, unnest(range(first, past)) as pos from nears) group by doc_id),
near_named as (
  select doc_id, string_agg(item, ',' order by item) as near_ids from (
    select doc_id, item_id::varchar as item from close join whole using (number) join windows on whole.phrase = windows.phrase and windows.n = 10
    union select doc_id, item_id::varchar from found where n < 10
  ) group by doc_id
)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(n_near, 0)::bigint as n_near, coalesce(near_ids, '') as near_items
from documents d left join sizes using (doc_id) left join hits using (doc_id) left join named using (doc_id)
  left join near_words using (doc_id) left join near_named using (doc_id)
"""

OP9 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
formatted as (
  select *, '<|im_start|>' || replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') || chr(10)
    || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') || '<|im_end|>' || chr(10) as piece
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  sum(length(piece))::bigint as formatted_chars
from formatted group by conv_id
"""

OP10 = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
),
total as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (
  select *, source_size * 3.0::double as most,
    ([5.0, 2.0, 1.0]::double[])[(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as weight
  from total
),
levels as (
  select *,
    row_number() over (order by source_size / weight, source asc nulls last) as place,
    (sum(source_size) over () - coalesce(sum(most) over (order by source_size / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0))
      / sum(weight) over (order by source_size / weight, source asc nulls last rows between current row and unbounded following) as level
  from weighed
),
settled as (select level from levels where level * weight < most order by place limit 1),
goals as (
  select source, source_size, coalesce(least(most, (select level from settled) * weight), most)::double as target from levels
),
rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
    ('0x' || substring(md5('10:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as u
  from sizes join goals on sizes.source is not distinct from goals.source
)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from rated
"""

ORACLES: dict[str, str] = {
    "op4_exact_topk": OP4,
    "op5_benchmark_decontamination": OP5,
    "op6_license_scan": licenses.oracle(),
    "op9_chat_formatting": OP9,
    "op10_source_mixing": OP10,
}
