"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, bestfit, bm25, embeddings, langid, lines, minhash, mixing, packing, sharding, suffix, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.filter("doc_id % 100 = 0"), k=10).select("query_id", "rank", "doc_id", "score")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op5_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, path = warc.write_warc(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_warc(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    out = langid.identify(docs.select("doc_id", "text"), learn.select("text", "lang"))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.erase_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.grafted(table(spark, sf_dir, "conversations")))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bestfit.best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_bm25_topk, op3_source_mix, op4_embedding_dedup, op5_length_packing, op6_external_shuffle, op7_warc_index, op8_minhash_dedup, op9_language_id, op10_suffix_dedup, op11_conversation_trie, op12_best_fit_packing, op13_ranked_search)}


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = f"""
with l as (
  select doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), {AZ}) as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
f as (select k, max(doc_id) as keeper from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where keeper is not null and doc_id <> keeper)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where keeper is null or doc_id = keeper), '')) as kept_sha256
from l left join f using (k) group by doc_id
"""

OP2_SQL = f"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
dl as (select doc_id, sum(tf) as dl from tf group by doc_id),
g as (select (select count(*) from documents) as n, (select sum(tf) from tf) / (select count(*) from documents) as mean),
df as (select term, count(*) as df from tf group by term),
s as (
  select q.doc_id as query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
  from tf q join tf d using (term) join df using (term) join dl on dl.doc_id = d.doc_id cross join g
  where q.doc_id % 100 = 0 group by all),
r as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select query_id, rank::int as rank, doc_id, score from r where rank <= 10
"""

#: The window searches of these two are SQL by brute force, for small tables such as sf0.01.
OP4_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select r.a, p.b from reach r join p on p.a = r.b)
select vec_id, (select count(*) from p where a = vec_id)::bigint as n_links, c.component_id, vec_id = c.component_id as kept
from v join (select a, min(b) as component_id from reach group by a) c on c.a = vec_id
"""

OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as hex from pages),
f as (select hex, min(page_id) as first from p group by hex),
u as (select page_id, regexp_extract(coalesce(url, ''), '^(?:([a-zA-Z][a-zA-Z0-9_+.-]*)://)?(?:[^/?#@]*@)?([^/:?#]*)(?::([0-9]+))?([^#]*)', ['scheme', 'host', 'port', 'rest']) as m from pages),
h as (
  select page_id, row_number() over (
    partition by regexp_replace(lower(m.host), '^www[0-9]*\\.', ''), case when (m.scheme, m.port) in (('http', '80'), ('https', '443')) then '' else m.port end, lower(case m.rest when '' then '/' else m.rest end)
    order by page_id) as capture from u)
select page_id, octet_length(payload)::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_aggregate(list_transform(range(5), lambda j:
    (((strpos('0123456789abcdef', substr(hex, 1 + (5 * i + j) // 4, 1)) - 1) >> (3 - (5 * i + j) % 4)) & 1) << (4 - j)), 'sum')::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, capture
from p join f using (hex) join h using (page_id)
"""

OP8_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
p as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, p.b from reach r join p on p.a = r.b)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from documents left join n using (doc_id) join (select a, min(b) as component_id from reach group by a) c on c.a = doc_id
"""

#: crc32 of a decimal, bit by bit: there is no such function in this SQL.
OP11_SQL = """
with recursive t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base,
  xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295) % 6 as h
  from (select distinct conv_id from t)),
m as (select c.conv_id, 0 as part, i, role, text from c join t on t.conv_id = c.base where i <= h union all select c.conv_id, 1, i, role, text from c join t using (conv_id) where i > h),
r as (select conv_id, row_number() over w as d, list({'role': role, 'text': text}) over (w rows unbounded preceding) as p, length(text) as words from m window w as (partition by conv_id order by part, i)),
x as (select conv_id, d, p, words from r union all select conv_id, 0, [], 0 from c),
n as (select d, p, max(words) as words, min(conv_id) as conv_id, count(*) as n_convs from x group by all),
e as (select p, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from (select conv_id, arg_max(p, d) as p from x group by conv_id) group by p),
k as (select p[:d - 1] as p, count(*) as n_children from n where d > 0 group by all),
a as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (p)),
u as (select a.*, unnest(range(d + 1)) as level from a),
s as (select p[:level] as p, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * words) as saved_tokens from u group by 1)
select a.conv_id, a.d::bigint as depth, b.conv_id as parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens::bigint as saved_tokens,
  coalesce(ends, sha256('')) as ends_sha256
from a join s using (p) left join e using (p) left join n b on a.d > 0 and b.p = a.p[:a.d - 1]
"""

OP13_SQL = f"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, {AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
dl as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
g as (select count(*) as docs, sum(n)::bigint as words from dl),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from tf cross join g group by term, docs),
q as (select item_id, unnest(regexp_extract_all(translate(text, {AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::bigint as score
  from q join w using (term) join tf using (term) join dl using (doc_id) cross join g group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_bm25_topk": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op7_warc_index": OP7_SQL, "op8_minhash_dedup": OP8_SQL, "op11_conversation_trie": OP11_SQL, "op13_ranked_search": OP13_SQL}
