"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP6 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, payload_bytes, p.payload_digest, case when f.first < page_id or (page_id is null and f.first is not null) then 'revisit' else 'response' end as record_type,
       case when f.first < page_id or page_id is null then f.first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""

OP7 = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings
           where list_sum([case when x is null or isnan(x) or isinf(x) then 1 else 0 end for x in embedding]) = 0 and list_sum([case when x <> 0 then 1 else 0 end for x in embedding]) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20
"""

OP8 = r"""
with d as (select doc_id as id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, sum(case when size > 0 then pow(cast(size as double), 0.75) else 0 end) as tilted from d group by source),
o as (select *, row_number() over (order by source is null, source) as sid from s),
w as (select *, cast((sid - 1) % 3 + 1 as double) as weight, 3 * source_size / cast((sid - 1) % 3 + 1 as double) as fills_at from o),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0.0)) as level
      from w window b as (order by fills_at, sid rows between unbounded preceding and 1 preceding)),
t as (select *, case when fills_at <= level then cast(3 * source_size as double) else weight * (select level from l where fills_at > level order by fills_at, sid limit 1) end as target from l),
c as (select *, least(floor(case when source_size > 0 then target / source_size else 0 end + 1e-12), 3) as certain from t),
k as (select *, greatest(target - certain * source_size, 0) as rest from c),
j as (select d.*, sid, source_size, target, certain, rest, case when tilted > 0 then rest / tilted else 0 end as scale,
             (cast(('0x' || substr(md5('mix-1:' || cast(id as varchar)), 1, 13)) as bigint) + 0.5) / 4503599627370496.0 as u
      from d join k on d.source is not distinct from k.source),
p as (select *, least(greatest(scale * pow(cast(greatest(size, 1) as double), -0.25), 1e-9), 1 - 1e-9) as p from j),
q as (select *, (u / (1 - u)) / (p / (1 - p)) as q from p),
z as (select *, size > 0 and sum(size) over (partition by sid order by q, size, id rows unbounded preceding) <= rest as drawn from q),
g as (select sid, max(rest) - sum(case when drawn then size else 0 end) as gap from z group by sid),
e as (select z.sid, arg_min(id, (abs(gap - size), id)) as pick from z join g on z.sid = g.sid where not drawn and size > 0 and abs(gap - size) < gap group by z.sid)
select id as doc_id, size, source_size, target, cast(case when size > 0 then certain + (case when drawn or e.pick is not null then 1 else 0 end) else 0 end * size as bigint) as taken
from z left join e on z.sid = e.sid and z.id = e.pick
"""
