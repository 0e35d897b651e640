"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP8 = rf"""
with d as (
  select doc_id, source, cast({_WORDS} as bigint) as size,
         substring(md5(coalesce(cast(doc_id as varchar), '')), 1, 16) as k
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), w as (
  select *, row_number() over (order by source nulls last) as rn from s
), p as (
  select source, source_size, rn, cast(case (rn - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight,
         2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as everything
  from w
), f as (
  select *, sum(cap) over o + cap / weight * (sum(weight) over () - sum(weight) over o) <= everything as sated
  from p window o as (order by cap / weight range between unbounded preceding and current row)
), t as (
  select source, source_size, case when rn % 2 = 1 then 1.5::double else 0.5::double end as r0,
         case when sated then cap
              else (everything - sum(case when sated then cap else 0 end) over ())
                   / sum(case when sated then 0 else weight end) over () * weight end as target
  from f
), l as (
  select d.doc_id, d.size, t.*,
         coalesce(sum(d.size) over (partition by d.source order by d.k, d.size
                                    rows between unbounded preceding and 1 preceding), 0) as u0,
         case when source_size > 0 then floor(target / source_size) else 0 end as passes
  from d join t on d.source is not distinct from t.source
), r as (
  select *, cast(passes * size + greatest(least(floor(target - passes * source_size) - u0, size), 0) as bigint) as taken
  from l
)
select doc_id, size, source_size, target, taken,
       case when taken > 0 then round(coalesce(2 * (u0 / target) / (r0 + sqrt(greatest(r0 * r0 + 2 * (u0 / target) * (2 - 2 * r0), 0))), 0), 9) end as position
from r
"""

OP9 = """
with p as (
  select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as m from pages
)
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest,
       case when strlen(h) >= 1000 and page_id < m then 'revisit' else 'response' end as record_type,
       case when strlen(h) >= 1000 and page_id < m then m end as refers_to
from p
"""

OP2 = """
with v as (
  select vec_id, cast(embedding as double[]) as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x) as score
  from v q, v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from s
)
select query_id, cast(rn as integer) as rank, vec_id, score from r where rn <= 20
"""

ORACLES = {"op2_nearest": OP2, "op8_mixing": OP8, "op9_warc": OP9}
