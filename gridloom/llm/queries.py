"""The queries opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lm_scoring, near_dedup, pieces, quality, sharding, suffix_dedup, urls, warc
from ._shared import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dups(table(spark, sf_dir, "documents"))


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)


def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs are those of the pages whose page_id is divisible by 100."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, pages.where("page_id % 100 = 0")).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_near_dedup, op3_importance, op4_jump_shards, op5_lattice_score, op6_multi_index, op7_sampled_pieces, op8_warc,
                                      op9_latent_leaks, op10_url_filter)}


_OP10_SQL = r"""
with parts as (
  select page_id,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged as (
  select page_id, host, path,
    (select arg_max(h || p, length(h || p)) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as rule,
    (select arg_max(v, length(h || p)) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as v,
    case when host <> '' then regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(path, '/+$', '') end as k
  from split),
listed as (select distinct k from judged where page_id % 100 = 0 and k is not null)
select page_id, host, path, rule, coalesce(v, case when k in (select k from listed) then 'block' else 'allow' end) as verdict from judged
"""


_OP8_SQL = r"""
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when f.first <> page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> page_id then f.first end as refers_to
from p left join f on p.d = f.d
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": _OP8_SQL, "op10_url_filter": _OP10_SQL}
