"""DuckDB SQL for the queries that SQL can express."""

from tessera.llm import urlfilter

_KEY = r"""(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1))"""
_RULE = """case
  when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end"""
_SAID = "case when {r} in ('net/', 'example.com/de/') then 'block' when {r} is not null then 'allow' end"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP7 = rf"""
with recursive found as (
  select url as u, unnest([
    regexp_extract(regexp_extract(html, '{_quoted(urlfilter.CANONICAL)}', 0), '{_quoted(urlfilter.HREF)}', 1),
    regexp_extract(regexp_extract(html, '{_quoted(urlfilter.REFRESH)}', 0), '{_quoted(urlfilter.TARGET)}', 1)]) as t
  from pages where contains(url, '://') and html is not null),
resolved as (
  select u, case
    when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t
    when starts_with(t, '//') then regexp_extract(u, '(?s)^(.*?):', 1) || ':' || t
    when starts_with(t, '/') then regexp_extract(u, '(?s)^.*?://[^/?#]*', 0) || t
    when starts_with(t, '#') then u
    when regexp_matches(u, '(?s)^.*?://[^/?#]*/') then regexp_extract(u, '(?s)^.*?://[^/?#]*(?:[^?#]*/)?', 0) || t
    else regexp_extract(u, '(?s)^.*?://[^/?#]*', 0) || '/' || t end as t
  from found where t <> ''),
one_way as (select {_KEY.format(u="u")} as a, {_KEY.format(u="t")} as b from resolved),
edges as (select a, b from one_way where a <> b union select b, a from one_way where a <> b),
reach(node, other) as (
  select a, a from edges union select r.node, e.b from reach r join edges e on e.a = r.other),
ruled as (
  select node, {_RULE} as rule from (
    select node, regexp_extract(other, '(?s)^[^/?]*', 0) as host, regexp_extract(other, '(?s)^[^/?]*([^?]*)', 1) as path from reach)),
told as (
  select node, case when bool_or({_SAID.format(r="rule")} = 'allow') then 'allow' else 'block' end as alias
  from ruled where rule is not null group by node),
judged as (
  select page_id, url, host, path, {_RULE} as rule from (
    select page_id, url,
      coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages))
select page_id, host, path, rule, coalesce({_SAID.format(r="rule")}, alias, 'allow') as verdict
from judged left join told on rule is null and contains(url, '://') and node = {_KEY.format(u="url")}
"""

OP10 = """
with best as (select doc_id, max(quality) as q from labels where doc_id is not null group by doc_id),
drawn as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    -ln((('0x' || substr(md5('mix' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / case when b.q = 1 then 2.0::double when b.q = 0 then 0.5::double else 1.0::double end as k
  from documents d left join best b on b.doc_id = d.doc_id),
sizes as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from drawn group by source),
levels as (
  select *, 3.0::double * source_size as cap,
    (sum(source_size) over () - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by 3.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from sizes),
aimed as (
  select source, source_size, round(case when cap > w * level then w * max(case when cap > w * level then level end) over () else cap end, 6) as target from levels),
split as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from aimed),
ranked as (
  select d.doc_id, d.size, s.source_size, s.target, s.epochs, s.target - s.epochs * s.source_size as rest,
    sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls last rows between unbounded preceding and current row) as upto
  from drawn d join split s on d.source is not distinct from s.source)
select doc_id, size, source_size, target::double as target,
  (size * (epochs + case when upto - size / 2.0 < rest then 1 else 0 end))::bigint as taken
from ranked
"""

OP1 = """
with v as (
  select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (
  select q.n, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, row_number() over (partition by n order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP6 = """
with p as (
  select page_id, url, encode(coalesce(html, '')) as body from pages),
d as (
  select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and first > page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and first > page_id then first end as refers_to
from m
"""

ORACLES = {"op1_topk": OP1, "op6_warc": OP6, "op7_urlfilter": OP7, "op10_mixing": OP10}
