"""Registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .html import page_text
from .langid import language_ids
from .pii import digest, personal_data
from .quality import quality_scores
from .simhash import near_duplicates
from .substring import passages
from .toolcalls import exchanges, linked


def vocabulary_path() -> str:
    """The byte-level vocabulary file: $TIDEMARK_BPE, or the installed public one."""
    if own := os.environ.get("TIDEMARK_BPE"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(*exchanges(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.withColumn("errors", F.array_join("errors", ";"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents")).drop("ambiguous")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_decontaminate, op3_quality, op4_exact_dedup, op5_html_text, op6_simhash, op7_tool_calls, op8_substring, op9_bpe, op10_language_id)
}

ORACLE: dict[str, str] = {
    "op2_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS passage
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM dw, sizes, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS t(i) WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.i, a.n, win.item_id FROM windows a JOIN win USING (n, passage)),
words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(0, n)) AS u(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words h USING (doc_id) LEFT JOIN items x USING (doc_id)""",
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    "op7_tool_calls": r"""
WITH rows AS (
  SELECT conv_id, turn, lower(trim(coalesce(role, ''))) AS role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (
  SELECT conv_id, 'c' || turn AS call_id, turn, CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'instruct' ELSE role END AS name, text,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'c' || (turn - 2) WHEN role = 'system' THEN 'c' || (turn + 1) END AS depends FROM rows WHERE role <> 'assistant'),
results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, turn AS result_turn, text AS result FROM rows WHERE role = 'assistant'),
joined AS (
  SELECT conv_id, call_id, c.turn, r.result_turn, coalesce(name = 'instruct' AND EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.call_id = c.depends), false) AS moved, name, text, depends, result, c.conv_id IS NOT NULL AS is_call, r.conv_id IS NOT NULL AS has_result,
    CASE WHEN c.conv_id IS NULL THEN '' ELSE concat_ws(';',
      CASE WHEN depends IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.call_id = c.depends) THEN depends || ': no such call' END,
      CASE WHEN text IS NULL THEN 'prompt: missing' WHEN length(text) < 1 THEN 'prompt: bad length' END,
      CASE WHEN name NOT IN ('reply', 'instruct') THEN 'unknown tool' END) END AS errors
  FROM calls c FULL JOIN results r USING (conv_id, call_id)),
final AS (
  SELECT *, CASE WHEN NOT is_call THEN 'orphan_result' WHEN errors <> '' THEN 'invalid' WHEN NOT has_result THEN 'no_result' ELSE 'ok' END AS status FROM joined)
SELECT conv_id, call_id, coalesce(turn, result_turn) AS turn, coalesce(turn, result_turn) + CASE WHEN moved THEN 1 ELSE 0 END AS order_turn, CAST(moved AS BIGINT) AS order_hops, name, status, errors,
  CAST(is_call AS BIGINT) AS n_calls, CAST(has_result AS BIGINT) AS n_results,
  '{"arguments":' || CASE WHEN NOT is_call THEN 'null' ELSE '{' || coalesce('"prompt":' || to_json(text) || ',', '') || '"turn":' || turn || '}' END
  || ',"call_id":' || to_json(call_id) || ',"conv_id":' || conv_id
  || ',"depends_on":' || CASE WHEN NOT is_call THEN 'null' WHEN depends IS NULL THEN '[]' ELSE '[' || to_json(depends) || ']' END
  || ',"errors":' || CASE WHEN errors = '' THEN '[]' ELSE to_json(string_split(errors, ';')) END
  || ',"name":' || coalesce(to_json(name), 'null') || ',"result":' || coalesce(to_json(result), 'null') || ',"status":' || to_json(status) || '}' AS json
FROM final""",
}
