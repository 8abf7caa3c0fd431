"""DuckDB SQL that computes results of the registered queries another way."""

from kinweave.llm import laesa_codes, lemp_search, license_scan, mixing

#: sha1 of the whole payload; the largest page of equal payloads of 1000 bytes or more is stored.
_WARC = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages
), g as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as stored from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < stored then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < stored then stored end as refers_to,
  cast(null as varchar) as problem
from g
"""

#: Every pair by its cosine; components by spreading along the links.
_NEAR_VECTORS = """
with recursive v as (
  select row_number() over (order by vec_id) as k, vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
),
n as (select k, vec_id, e, sqrt(list_inner_product(e, e)) as norm from v),
l as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.k <> b.k and list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
),
r(a, b) as (select vec_id, vec_id from v union select r.a, l.b from r join l on r.b = l.a)
select v.vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join (select a, min(b) as component_id from r group by a) c on c.a = v.vec_id
"""

ORACLES: dict[str, str] = {
    "op1_warc": _WARC,
    "op2_licenses": license_scan.oracle(),
    "op5_near_vectors": _NEAR_VECTORS,
    "op11_lexical": lemp_search.oracle(),
    "op12_vector_codes": laesa_codes.oracle(),
    "op13_mixing": mixing.oracle(),
}
