"""Registered queries of sharding, manifest and source audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import divergence, merkle, sharding
from tablewarden.llm.common import read
from tablewarden.llm.registry import query

SHARDS = 24
#: The reversed polynomial of CRC-32 (fixed value).
_CRC = 3988292384

OP11_SQL = f"""
with recursive bits(i, c, k) as (
  select range, range::bigint, 0 from range(256)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, {_CRC}) else c >> 1 end, k + 1 from bits where k < 8
), crc as (
  select list(c order by i) as tab from bits where k = 8
), d as (
  select row_number() over () as r, doc_id, coalesce(doc_id::varchar, '') as k, encode(coalesce(text, '')) as b from documents
), drawn as (
  select r, s, -ln((('0x' || substr(md5(k || ':' || s), 1, {sharding.DIGITS}))::bigint::double + 0.5) / {16**sharding.DIGITS}.0::double) as t
  from d, (select unnest(range({SHARDS + 1})) as s)
), first as (
  select r, arg_min(s, t) filter (where s < {SHARDS}) as shard, arg_min(s, t) as grown from drawn group by r
), summed as (
  select r, doc_id, octet_length(b) + 8 as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::bigint)),
             lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) as crc
  from d, crc
)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'key' as law, shard::int as shard,
       row_number() over (partition by shard order by doc_id nulls first, crc, size) - 1 as slot, grown::int as grown_shard
from summed join first using (r)"""


@query("op11_rendezvous_sharding", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.place(docs, "doc_id", [1.0] * SHARDS, further=1.0, order=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


CELLS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sql_leaf(n_chars: str) -> str:
    plain = [f"({n_chars if c == 'n_chars' else c})::varchar" for c in CELLS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in plain) + ")"


def _sql_tree(name: str, start: str) -> str:
    """Recursive table (g, l, i, h, n): node i of the n nodes of level l."""
    return f"""{name}(g, l, i, h, n) as (
  {start}
  union all
  select g, l + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from {name} where n > 1 group by g, l, i // 2, n
)"""


OP12_SQL = f"""
with recursive bits(i, c, k) as (
  select range, range::bigint, 0 from range(256)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, {_CRC}) else c >> 1 end, k + 1 from bits where k < 8
), crc as (
  select list(c order by i) as tab from bits where k = 8
), leaves as (
  select doc_id, lang as g, {_sql_leaf('n_chars')} as leaf, {_sql_leaf('n_chars + 1')} as changed,
         coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda x: ('0x' || x)::bigint)),
             lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0, false) as tampered
  from documents, crc
), placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from leaves
), {_sql_tree('tree', 'select g, 0, i, leaf, n from placed')},
tops as (
  select g, h, row_number() over (order by g nulls first) - 1 as i, count(*) over () as n from tree where n = 1
), {_sql_tree('upper', 'select 0, 0, i, h, n from tops')},
steps as (
  select p.g, p.i, 0 as part, t.l, t.h, t.i % 2 as is_right
  from placed p join tree t on p.g is not distinct from t.g and t.i = xor(p.i >> t.l, 1)
  union all
  select p.g, p.i, 1, u.l, u.h, u.i % 2
  from placed p join tops s on p.g is not distinct from s.g join upper u on u.i = xor(s.i >> u.l, 1)
), proofs as (
  select g, i, string_agg(h, '' order by part, l) as proof from steps group by g, i
), walk as (
  select p.g, p.i, w.part, w.l, row_number() over (partition by p.g, p.i order by w.part, w.l) as k, st.h, st.is_right
  from placed p join tops s on p.g is not distinct from s.g
  join (select distinct g, 0 as part, l from tree where n > 1 union all select s2.g, 1, u.l from tops s2, (select distinct l from upper where n > 1) u) w
    on p.g is not distinct from w.g
  left join steps st on st.g is not distinct from p.g and st.i = p.i and st.part = w.part and st.l = w.l
), folded(g, i, k, h) as (
  select g, i, 0, case when tampered then coalesce(changed, leaf) else leaf end from placed
  union all
  select f.g, f.i, f.k + 1, case when w.h is null then sha256(f.h) when w.is_right = 1 then sha256(f.h || w.h) else sha256(w.h || f.h) end
  from folded f join walk w on f.g is not distinct from w.g and f.i = w.i and w.k = f.k + 1
), ends as (
  select g, i, arg_max(h, k) as folded_root from folded group by g, i
), root as (
  select h from upper where n = 1
)
select p.doc_id, p.leaf, s.h as subroot, root.h as root, sha256(coalesce(q.proof, '')) as proof_sha256, e.folded_root, e.folded_root = root.h as verified
from placed p join tops s on p.g is not distinct from s.g join ends e on p.g is not distinct from e.g and p.i = e.i
left join proofs q on p.g is not distinct from q.g and p.i = q.i, root"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*CELLS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # One more in decimals, which can not overflow.
    changed = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in CELLS]
    out = merkle.audit(docs, F.when(tampered, merkle.leaf(changed)), CELLS, "lang", "doc_id")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


#: Restates the contract; ``[^...]+`` is the class of characters of a term.
OP13_SQL = f"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as found, row_number() over () as r
  from documents
), tokens as (
  select lang, source, r, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d
), kept as (
  select lang, term from tokens group by all having count(distinct r) >= {divergence.LEAST_DOCS}
), counted as (
  select lang, source, term, count(*)::hugeint as c from tokens semi join kept using (lang, term) group by all
), sources as (
  select distinct lang, source from d
), sized as (
  select s.lang, s.source, coalesce(sum(c), 0)::hugeint as n, (select count(*) from kept k where k.lang = s.lang)::hugeint as v
  from sources s left join counted using (lang, source) group by all
), dense as (
  select s.lang, s.source, k.term, coalesce(c, 0) as c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (n + 2 * v) as p
  from sized s join kept k using (lang) left join counted using (lang, source, term)
), whole as (
  select lang, term, 1 + (1000000000 * (sum(c) + 2)) // (any_value(n) + 2 * any_value(v)) as q
  from dense join (select lang, sum(n) as n, any_value(v) as v from sized group by lang) using (lang) group by lang, term
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value
  from sources a join sources b on a.lang = b.lang and a.source != b.source
  left join dense x on x.lang = a.lang and x.source = a.source
  left join dense y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all
), terms as (
  select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from dense join whole using (lang, term) where c > 0 and p > q
), rows as (
  select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms
)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from rows qualify part = 'pair' or rank <= {divergence.TOP}"""


@query("op13_segment_tree_divergence", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))
