"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, exact_dedup, language, merkle, near_dedup, packing, quality_rules, resampling, sharding, token_files, toxicity, url_filter, warc
from tidegrid.llm.common import scratch_path, table

#: The rules that op1 applies, block or allow.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(f"('{e}', '{a}')" for e, a in URL_RULES) + " as rules(entry, action)")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are read back after one arrival of small shards has been compacted."""
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"), target_bytes=64 << 20, shard_rows=2000)
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    text = F.col("text").cast("binary")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("text_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_sharding, op5_warc, op8_exact_dedup)}

_GROUPS = ", ".join(f"('0x' || substr(h, {1 + 5 * i}, 5))::bigint" for i in range(8))

ORACLE_SQL = {
    "op1_url_filter": """
with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from u),
rules(rule, rh, rp, action) as (values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
      ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block'))
select p.page_id, p.host, p.path,
       (select max_by(rule, length(rule)) from rules where (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp)) as rule,
       coalesce((select max_by(action, length(rule)) from rules where (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp)), 'allow') as verdict
from p""",
    "op2_sharding": "select doc_id, lang, source, n_chars, octet_length(encode(text)) as text_bytes, sha256(text) as text_sha256 from documents",
    "op5_warc": f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first_id from p),
g as (select *, [{_GROUPS}] as gs from d)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(gs, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31)::bigint, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31)::bigint, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31)::bigint, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31)::bigint, 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from g""",
    "op8_exact_dedup": """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
       doc_id = max(doc_id) over (partition by text) as kept, sha256(text) as text_sha256
from d""",
}


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


QUERIES["op4_near_dedup"] = op4_near_dedup


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op9_toxicity, op10_language)}


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op3_decontaminate"] = op3_decontaminate


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


QUERIES |= {f.__name__: f for f in (op6_token_files, op7_packing)}


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 is divisible by 7 are shown with one more in n_chars than the manifest was made from."""
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(table(spark, sf_dir, "documents"), shown={"n_chars": more})


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {f.__name__: f for f in (op11_resampling, op12_merkle, op13_quality_rules)}

#: crc32 of a text by its table of 256 entries, which is made from the polynomial.
_CRC = """crc_table as (select list(list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as crc_t from range(256) r(b))"""


def _crc(text: str) -> str:
    codes = f"list_transform(range(1, length(hex(encode({text}))) // 2 + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(crc_t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint))"


ORACLE_SQL |= {
    "op11_resampling": rf"""
with {_CRC},
words as (select 'd' as kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
  union all select 'b', null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
codes as (select w, {_crc("w")} % 10000 as bucket from (select distinct w from words), crc_table),
n as (select bucket, count_if(kind = 'd')::double as s, count_if(kind = 'b')::double as t from words join codes using (w) group by bucket),
gain as (select bucket, floor(1000.0 * ln((t + 1) * ((select sum(s) from n) + 10000) / ((s + 1) * ((select sum(t) from n) + 10000))))::bigint as gain from n),
f as (select doc_id, count(*) as n, sum(gain)::double as g from words join codes using (w) join gain using (bucket) where kind = 'd' group by doc_id),
d as (select doc_id, coalesce(n, 0) as n_features, coalesce(floor(g / n), 0)::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint::double as h from documents left join f using (doc_id)),
s as (select *, weight + floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0)))::bigint as score from d),
r as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place from s)
select doc_id, n_features, weight, score, case when place <= (select 10 * count(*) // 100 from s where n_features >= 20) then place end as rank from r""",
    "op12_merkle": f"""
with recursive {_CRC},
d as (select *, {_crc("doc_id::varchar")} % 7 = 0 as tampered from documents, crc_table),
l as (select doc_id, lang, tampered, n_chars, sha256({"||".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')" for c in merkle.FIELDS)}) as leaf,
  sha256({"||".join(f"coalesce(octet_length(encode(({c})::varchar)) || ':' || ({c}), '-')" for c in ["n_chars + tampered::int" if c == "n_chars" else c for c in merkle.FIELDS])}) as shown,
  row_number() over (partition by lang order by doc_id) - 1 as idx, count(*) over (partition by lang) as size from d),
lv as (select lang, 0 as level, idx, leaf as d, size as n from l
  union all select lang, level + 1, idx // 2, sha256(string_agg(d, '' order by idx)), (n + 1) // 2 from lv where n > 1 group by lang, level, idx // 2, n),
tops as (select lang, d, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as size from lv where n = 1),
up as (select 0 as level, idx, d, size as n from tops union all select level + 1, idx // 2, sha256(string_agg(d, '' order by idx)), (n + 1) // 2 from up where n > 1 group by level, idx // 2, n),
nodes as (select lang, false as top, level, idx, d from lv union all select null, true, level, idx, d from up),
sib as (select l.doc_id, 0 as part, s.level, s.d, s.idx < l.idx >> s.level as before from l join lv s on s.lang is not distinct from l.lang and s.idx = xor(l.idx >> s.level, 1) where s.n > 1
  union all select l.doc_id, 1, s.level, s.d, s.idx < t.idx >> s.level from l join tops t on t.lang is not distinct from l.lang join up s on s.idx = xor(t.idx >> s.level, 1) where s.n > 1),
steps as (select l.doc_id, 0 as part, v.level from l join (select distinct lang, level from lv where n > 1) v on v.lang is not distinct from l.lang
  union all select l.doc_id, 1, v.level from l, (select distinct level from up where n > 1) v),
path as (select doc_id, part, level, d, before, row_number() over (partition by doc_id order by part, level) as step from steps left join sib using (doc_id, part, level)),
proof as (select doc_id, sha256(coalesce(string_agg(d, '' order by step), '')) as proof_sha256 from l left join path using (doc_id) group by doc_id),
fold as (select doc_id, 0 as step, case when tampered then shown else leaf end as d from l
  union all select f.doc_id, p.step, sha256(case when p.d is null then f.d when p.before then p.d || f.d else f.d || p.d end) from fold f join path p on p.doc_id = f.doc_id and p.step = f.step + 1),
folded as (select doc_id, arg_max(d, step) as folded_root from fold group by doc_id),
root as (select d as root from up where n = 1)
select l.doc_id, leaf, tops.d as subroot, root, proof_sha256, folded_root, folded_root = root as verified
from l join tops on tops.lang is not distinct from l.lang join proof using (doc_id) join folded using (doc_id), root""",
}
