"""The queries over the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.decontamination import find_contamination
from plumbline.llm.hard_negatives import mine
from plumbline.llm.licenses import scan_licenses
from plumbline.llm.near_duplicates import find_near_duplicates
from plumbline.llm.packing import pack_documents
from plumbline.llm.quality_model import judge_by_model
from plumbline.llm.quality_rules import judge_quality
from plumbline.llm.runtime import table
from plumbline.llm.secrets import scan_secrets
from plumbline.llm.simhash import find_similar
from plumbline.llm.token_counts import count_tokens
from plumbline.llm.url_rules import Rule, judge_urls
from plumbline.llm.warc import archive_round_trip
from plumbline.llm.whitening import whiten


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    spans = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.array_join(spans, ",").alias("spans")
    )


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_by_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_similar(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", scale=64, shift=1_000_000)
    each = rows.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"),
        F.col("value").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_url_rules": op4_url_rules,
    "op5_quality_model": op5_quality_model,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as win
  from (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from iw),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hit as (select dw.doc_id, dw.i, dw.k, iw.item_id from dw join iw using (k, win)),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s
  from (select distinct doc_id, item_id from hit) group by doc_id),
runs as (select doc_id, min(j) as a, max(j) as b from (select doc_id, j, j - row_number() over (partition by doc_id order by j) as g
  from (select distinct doc_id, unnest(range(i, i + k)) as j from hit)) group by doc_id, g),
pieces as (select doc_id, list_transform({_WORDS}, lambda x: length(x)) as n, list_transform(regexp_split_to_array(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: length(x)) as gap
  from documents where doc_id in (select doc_id from hit)),
spans as (select doc_id, string_agg((coalesce(list_sum(n[1:a - 1]), 0) + list_sum(gap[1:a]))::bigint || ':' || (list_sum(n[1:b]) + list_sum(gap[1:b]))::bigint, ',' order by a) as spans
  from runs join pieces using (doc_id) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(spans, '') as spans
from d left join words using (doc_id) left join items using (doc_id) left join spans using (doc_id)
""",
    "op4_url_rules": r"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f as (select page_id, arg_max(h || p, len(h || p)) as rule, arg_max(verdict, len(h || p)) as verdict
  from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join f using (page_id)
""",
    "op6_near_duplicates": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r(id, to_id) as (select doc_id, doc_id from documents union select r.id, e.b from r join e on r.to_id = e.a),
m as (select id, min(to_id) as component_id from r group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join m on m.id = d.doc_id left join n on n.doc_id = d.doc_id
""",
    "op2_warc_round_trip": r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, h, strlen(html)::bigint as payload_bytes, max(page_id) over (partition by h) as newest,
  list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::integer) as v from p)
select page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') as payload_digest,
  case when newest = page_id then 'response' else 'revisit' end as record_type,
  case when newest <> page_id then newest end as refers_to
from d
""",
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other, list_dot_product(a.x, b.x)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.*, other as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
}
