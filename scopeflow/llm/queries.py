"""The thin queries over the driver's tables, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scopeflow.llm import chat, decontaminate, neardup, packing, quality, repeats, secrets, tokens, urls

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048

URL_RULES = [
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return packing.pack_documents(packing.clustered_lengths(documents, BYTE_BPE), documents.count(), CAPACITY)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(_table(spark, sf_dir, "documents"), BYTE_BPE))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.judge_quality(documents, quality.train_crf(documents, _table(spark, sf_dir, "labels")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), WORD_BPE, CAPACITY)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_binary": op2_token_binary,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_chat_perspectives": op4_chat_perspectives,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_repeat_removal": op10_repeat_removal,
    "pipeline": pipeline,
}

_HOST = "case when contains(url, '://') then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end"
_PATH = "case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end"

_SAFE = "replace(replace({}, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')"

ORACLES: dict[str, str] = {
    "op4_chat_perspectives": f"""
with t as (select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), text) - 1 as place from conversations),
p as (select distinct conv_id, role as participant from t),
x as (select t.conv_id, participant, place // 64 as part, place, role = participant as own,
    case when role = participant then '<|im_start|>assistant' || chr(10) else '<|im_start|>user name=' || {_SAFE.format("role")} || chr(10) end as head,
    {_SAFE.format("text")} || '<|im_end|>' as body
  from t join p on t.conv_id is not distinct from p.conv_id),
y as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, participant, part order by place
    rows between unbounded preceding and 1 preceding), 0) + length(head) as a from x)
select conv_id, participant, cast(part as bigint) as part, count(*) as n_turns, count(*) filter (where own) as n_masked,
  string_agg(head || body, chr(10) order by place) as rendered,
  coalesce(string_agg(cast(a as bigint) || ':' || cast(a + length(body) as bigint), ',' order by place) filter (where own), '') as mask
from y group by all""",
    "op3_minhash_dedup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
both_ways as (select x, y from link union select y, x from link),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.y from r join both_ways l on l.x = r.b)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(b) as component_id, doc_id = min(b) as kept
from documents left join n using (doc_id) left join r on r.a = doc_id group by doc_id""",
    "op10_repeat_removal": """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, base, substring(h, 2 * base + 1, 1098) as h from (select doc_id, h, unnest(range(0, len(h) // 2, 500)) as base from t)),
w as (select doc_id, base + j as i, substring(h, 2 * j + 1, 100) as s from (select *, unnest(range(0, least(500, greatest(len(h) // 2 - 49, 0)))) as j from p)),
f as (select s, min(doc_id) as least_id from w group by s having min(doc_id) < max(doc_id)),
g as (select doc_id, i from w join f using (s) where least_id < doc_id),
m as (select doc_id, i, sum(case when i <= before + 50 then 0 else 1 end) over (partition by doc_id order by i rows unbounded preceding) as run
  from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from g)),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from m group by doc_id, run),
kept as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from runs union all select doc_id, max(b), 1000000000000 from runs group by doc_id),
x as (select t.doc_id, any_value(len(h) // 2) as n, sha256(unhex(coalesce(string_agg(substring(h, 2 * kept.a + 1, 2 * (least(kept.b, len(h) // 2) - kept.a)), '' order by kept.a), any_value(h)))) as digest from t left join kept using (doc_id) group by t.doc_id)
select x.doc_id, n as n_bytes, cast(coalesce(sum(b - a), 0) as bigint) as n_removed, count(a) as n_spans, digest as kept_sha256 from x left join runs using (doc_id) group by all""",
    "op6_url_filter": f"""
with u as (select page_id, {_HOST} as host, {_PATH} as path from pages),
r(r_host, r_path, r_verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hit as (select host, path, r_host || r_path as rule, r_verdict, row_number() over (partition by host, path
  order by len(string_split(r_host, '.')) desc, length(r_path) desc) as k
  from (select distinct host, path from u) join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select u.page_id, u.host, u.path, hit.rule, coalesce(hit.r_verdict, 'allow') as verdict
from u left join hit on u.host = hit.host and u.path = hit.path and hit.k = 1""",
}
