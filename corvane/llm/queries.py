"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe_automaton, cotraining, embeddings, exact_dedup, hosts, jaccard, langid, packing, pii, warc
from corvane.llm.arrow import bound_batches

RULES = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.fit(docs.where(third != 1))
    rows = docs.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.classify(*(_table(spark, sf_dir, name) for name in ("documents", "labels", "pages")))
    return scored.withColumn("kept", F.col("score") >= 0.5)


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), hosts.parse_rules(RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality, op3_host_reputation, op4_exact_dedup, op5_bpe, op6_warc, op7_jaccard, op8_embedding_dedup, op9_packing, op10_pii)}

_LEVEL = """
    {name}_m as (select sum(n)::double n, sum(k)::double k, count(*) g, sum(n * n)::double nn, sum(k * k / n::double) kk from {cells} where n > 0),
    {name}_s as (select least(greatest(coalesce(n, 0), 1.0::double), case when n is null or g < 2 or (n - nn / n) * (k / n) * (1 - k / n) <= 0 then 1000.0::double
        else 1 / round(least(greatest((kk - n * (k / n) * (k / n) - (g - 1) * (k / n) * (1 - k / n)) / ((n - nn / n) * (k / n) * (1 - k / n)), 1 / 1001.0::double), 0.5), 6) - 1 end) s from {name}_m)"""

ORACLES = {
    "op3_host_reputation": rf"""
with named as (
    select page_id, coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
        coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') path from pages),
    numbered as (select host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1), '') as bigint) number from named),
    outcome as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end) bad from labels where doc_id is not null group by 1),
    counted as (select host, count(*) n, sum(bad) k from numbered join outcome on number = doc_id where bad is not null group by 1),
    plain as (select host, regexp_extract(host, '^(?:.*@)?(.*?)(?::[0-9]*)?\.?$', 1) bare from (select distinct host from named)),
    parts as (select host, bare, string_split(bare, '.') p, regexp_matches(bare, '{hosts._ADDRESS}') address, regexp_matches(bare, '{hosts._LONG}')::int long from plain),
    cells as (select host, case when address then bare else array_to_string(p[-2 - long:], '.') end dom, case when address then bare else array_to_string(p[-1 - long:], '.') end suf, coalesce(n, 0)::bigint n, coalesce(k, 0)::bigint k
        from parts left join counted using (host)),
    domains as (select suf, dom, sum(n)::bigint n, sum(k)::bigint k from cells group by 1, 2),
    suffixes as (select suf, sum(n)::bigint n, sum(k)::bigint k from domains group by 1),
    total as (select (coalesce(sum(k), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1.0::double) mean from suffixes),
    {_LEVEL.format(name="a", cells="suffixes")}, {_LEVEL.format(name="b", cells="domains")}, {_LEVEL.format(name="c", cells="cells")},
    sr as (select suf, (k + s * mean) / (n + s) r from suffixes, total, a_s),
    dr as (select suf, dom, (k + s * r) / (n + s) r from domains join sr using (suf), b_s),
    post as (select host, n + s size, (k + s * r) / (n + s) rate from cells join dr using (suf, dom), c_s),
    ruled as (select *, case
        when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
        when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end rule from named)
select page_id, host, path, rule, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow'
    when rate - 1.645::double * sqrt(rate * (1 - rate) / (size + 1)) > 0.4::double then 'block' else 'allow' end verdict
from ruled left join post using (host)""",
    "op4_exact_dedup": """
with norm as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size, doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256 from norm""",
}
