"""DuckDB statements of what the corpus queries return, where SQL can say it on whole tables."""

from __future__ import annotations

from riverloom.llm import hosts, licenses

#: Words as ``common.split_words`` cuts them.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Smallest id that each row reaches over a table ``link`` (a, b) in both directions, as table ``reach`` (id, root).
COMPONENTS = """
walk as (select a as id, b as root from link union select walk.id, link.b from walk join link on walk.root = link.a),
reach as (select id, min(root) as root from walk group by id)"""


#: Rounds after which less than 1e-10 of the rank can still move.
HOST_ROUNDS = 142


def hosts_sql(rounds: int = HOST_ROUNDS, damping: float = hosts.DAMPING) -> str:
    cases = "\n".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}|{r.action}'"
        for r in sorted(hosts.RULES, key=lambda r: -len(r.text))
    )
    host = lambda c: f"translate(regexp_extract({c}, '://([^/?#]*)', 1), '{hosts.UPPER}', '{hosts.LOWER}')"
    return f"""
with recursive p as (select page_id, html, coalesce({host("url")}, '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
j as (select page_id, html, host, path, case {cases} end as fit from p),
links as (select host as src, translate(regexp_extract(x, '//([^/?#]*)', 1), '{hosts.UPPER}', '{hosts.LOWER}') as dst
  from (select host, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']?\\s*((?:https?:)?//[^\\s"''<>]+)', 1, 'i')) as x from p) t),
edge as (select src, dst, count(*)::double as w from links where src <> '' and dst <> '' and src <> dst group by src, dst),
both_ways as (select 'trust' as kind, src, dst, w from edge union all select 'distrust', dst, src, w from edge),
step as materialized (select kind, src, dst, w / sum(w) over (partition by kind, src) as p from both_ways),
linking as materialized (select distinct kind, src as host from step),
seed as (select case when ends_with(fit, '|allow') then 'trust' else 'distrust' end as kind, host, count(*)::double as w from j where fit is not null group by 1, 2),
r0 as materialized (select kind, host, w / sum(w) over (partition by kind) as score from seed),
r as (select 0 as k, kind, host, score from r0 union all
  select k, kind, host, sum(score) as score from (
    select r.k + 1 as k, r.kind, s.dst as host, r.score * s.p * {damping} as score from r join step s on s.kind = r.kind and s.src = r.host where r.k < {rounds}
    union all
    select m.k + 1, r0.kind, r0.host, r0.score * (1 - {damping} + {damping} * m.ends) from r0 join (
      select r.k, r.kind, sum(case when l.host is null then r.score else 0 end) as ends from r left join linking l on l.kind = r.kind and l.host = r.host
      where r.k < {rounds} group by r.k, r.kind) m on m.kind = r0.kind) group by k, kind, host),
score as (select host, coalesce(sum(score) filter (where kind = 'trust'), 0) as trust, coalesce(sum(score) filter (where kind = 'distrust'), 0) as distrust
  from r where k = {rounds} group by host)
select page_id, j.host, path, nullif(split_part(fit, '|', 1), '') as rule,
  case when fit is not null then split_part(fit, '|', 2) when distrust > {hosts.THRESHOLD} * (trust + distrust) then 'block' else 'allow' end as verdict,
  round(coalesce(trust, 0), 5) as trust, round(coalesce(distrust, 0), 5) as distrust
from j left join score on j.host = score.host"""


VECTORS = f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
good as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select x.vec_id as a, y.vec_id as b from good x join good y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.98),
{COMPONENTS.strip()}
select v.vec_id, (select count(*) from link where link.a = v.vec_id) as n_links, least(v.vec_id, coalesce(root, v.vec_id)) as component_id,
  coalesce(root, v.vec_id) >= v.vec_id as kept from v left join reach on reach.id = v.vec_id"""

CONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
i as (select cast(item_id as varchar) as item_id, {WORDS} as w from benchmark),
phrase as (select item_id, list_slice(w, s, s + 9) as p from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as s from i where len(w) > 0)),
size as (select distinct len(p) as n from phrase),
piece as (select r, s, n, list_slice(w, s, s + n - 1) as p from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, size)),
hit as (select r, s, n, item_id from piece join phrase using (p)),
place as (select r, count(distinct word) as n_hit from (select r, unnest(range(s, s + n)) as word from hit) group by r),
item as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct r, item_id from hit where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join place using (r) left join item using (r)"""

_BITS = ",".join(f"{k:05b}" for k in range(32))
_NIBBLES = ",".join(f"{k:04b}" for k in range(16))

ARCHIVES = f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h),
b as (select h, array_to_string(list_transform(range(40), lambda k: split_part('{_NIBBLES}', ',', instr('0123456789abcdef', substr(h, k + 1, 1)))), '') as bits from f)
select page_id, strlen(body)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (instr('{_BITS}', substr(bits, 5 * k + 1, 5)) - 1) // 6 + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from p join f using (h) join b using (h)"""

NEAR = f"""
with recursive d as (select row_number() over () as r, doc_id, {WORDS} as w from documents where doc_id is not null),
run as (select r, array_to_string(list_slice(w, s, s + 4), ' ') as g from (select r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as s from d where len(w) > 0)),
c as (select r, g, count(*) as n from run group by r, g),
total as (select r, sum(n) as t from c group by r),
pair as (select x.r as a, y.r as b, sum(least(x.n, y.n)) as m from c x join c y on x.g = y.g and x.r <> y.r group by 1, 2),
link as (select a, b from pair join total u on u.r = a join total v on v.r = b where m >= 0.8 * (u.t + v.t - m)
  union select x.r, y.r from d x join d y on x.doc_id = y.doc_id and x.r <> y.r),
{COMPONENTS.strip()},
placed as (select doc_id, coalesce(root, r) as root from d left join reach on reach.id = r),
least as (select root, min(doc_id) as class_id from placed group by root)
select doc_id, min(class_id) as class_id from placed join least using (root) group by doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_hosts": hosts_sql(),
        "op3_near_vectors": VECTORS,
        "op4_decontaminate": CONTAMINATION,
        "op7_warc": ARCHIVES,
        "op8_licenses": licenses.scan_sql(),
        "op9_near_duplicates": NEAR,
    }
