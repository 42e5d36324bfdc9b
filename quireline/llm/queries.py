"""The registered queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.llm import bpe, hash_tree, host_quality, language, packing, pii, secrets, simhash, topk, toxicity
from quireline.llm.scratch import spread

SHARDS = 8
#: Of each shard, the one after growth included.
WEIGHTS = [1.0] * (SHARDS + 1)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.host_quality(_documents(spark, sf_dir), ["doc_id"])
    return judged.select("doc.doc_id", *host_quality.BASE, "base_failed", "kept")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(_documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_context")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard(_documents(spark, sf_dir), WEIGHTS, SHARDS)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


_QUALITY_SQL = r"""
WITH cut AS (
  SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM {documents}
), grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM cut WHERE len(w) >= 3)
), starts AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), repeats AS (
  SELECT r, sum(CASE WHEN p IS NULL THEN 3 ELSE least(3, i - p) END)::BIGINT AS n_repeat_words
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM starts) GROUP BY r
), lines AS (
  SELECT r, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM cut)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT rule, source, count(*) AS n, count(*) FILTER (WHERE failed) AS f
  FROM (SELECT source, x.rule AS rule, x.failed AS failed FROM (SELECT source, unnest([{rules}]) AS x FROM judged)) GROUP BY rule, source
), sums AS (
  SELECT rule, count(*) AS h, sum(n) AS docs, sum(n * n)::DOUBLE AS nn, sum(f) / sum(n) AS m, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread FROM hosts GROUP BY rule
), moments AS (
  SELECT rule, m, CASE WHEN docs - nn / docs > h - 1 THEN (spread - (h - 1) * m * (1 - m)) / (docs - nn / docs - (h - 1)) ELSE 0 END AS v FROM sums
), prior AS (
  SELECT rule, m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 100.0 END AS k FROM moments
), verdicts AS (
  SELECT source, bool_or((f + m * k) / (n + k) > 0.5) AS host_failed FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


def quality_sql(documents: str = "documents") -> str:
    """SQL for ``host_quality``."""
    rules = ", ".join(f"{{'rule': '{name}', 'failed': {rule}}}" for name, rule in host_quality.RULES.items())
    return _QUALITY_SQL.format(documents=documents, rules=rules)


_MD5 = "('0x' || substr(md5({key} || '/' || {path}), 1, {digits}))::BIGINT"


def _least_child(key: str, prefix: str, weights: str) -> str:
    """SQL for the number (from 0) of the child of least draw; ``weights``: a list."""
    unit = _MD5.format(key=key, path=f"{prefix} || i", digits=13)
    draws = f"list_transform(range(len({weights})), lambda i: -ln(({unit} + 1) / 4503599627370496.0) / ({weights})[i + 1])"
    return f"(list_position({draws}, list_min({draws})) - 1)"


def descent_sql(name: str, weights: list[float], source: str) -> str:
    """Tables that give each row r of ``source`` (r, key) its shard ``name``, a level at a time."""
    tree = hash_tree.tree_of(weights)
    regions, racks = [sum(map(sum, g)) for g in tree], [[sum(r) for r in g] for g in tree]
    shards = f"{tree}[region + 1][rack + 1]"
    return f"""
{name}_regions AS (SELECT r, key, {_least_child("key", "''", str(regions))} AS region FROM {source}),
{name}_racks AS (SELECT *, {_least_child("key", "region || '.'", f"{racks}[region + 1]")} AS rack FROM {name}_regions),
{name}_leaves AS (SELECT r, ((region * {hash_tree.RACKS} + rack) * {hash_tree.SHARDS} + {_least_child("key", "region || '.' || rack || '.'", shards)})::INTEGER AS {name} FROM {name}_racks)"""


#: CRC-32 of bytes, by the reflected polynomial 0xEDB88320.
_CRC_TABLE = """
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c FROM range(256) t(b)
  )
"""


def shard_sql(weights: list[float], shards: int, documents: str = "documents") -> str:
    """SQL for ``hash_tree.shard``."""
    part = _MD5.format(key="concat_ws('/', key, size, text_crc32)", path="'part'", digits=8)
    return f"""
WITH crc AS ({_CRC_TABLE}), keyed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h
  FROM {documents}
), summed AS (
  SELECT keyed.*, xor(4294967295, list_reduce(
           list_transform(h, lambda x: ('0x' || x)::BIGINT),
           lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM keyed, crc
), {descent_sql("shard", weights[:shards], "keyed")}, {descent_sql("grown_shard", weights, "keyed")}
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY {part} % {hash_tree.PARTS}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM summed JOIN shard_leaves USING (r) JOIN grown_shard_leaves USING (r)
"""


TOPK_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
) WHERE rank <= 20
"""

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_quality": op2_quality,
        "op3_bpe": op3_bpe,
        "op4_simhash": op4_simhash,
        "op5_pii": op5_pii,
        "op6_topk": op6_topk,
        "op7_toxicity": op7_toxicity,
        "op8_shard": op8_shard,
        "op9_secrets": op9_secrets,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": quality_sql(), "op6_topk": TOPK_SQL, "op8_shard": shard_sql(WEIGHTS, SHARDS)}
