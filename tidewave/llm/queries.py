"""Queries that apply the operators of this subpackage to whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm import chat, decontamination, langid, language_model, line_dedup, mixing, neighbours, ngram_join, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "op1_ngram_jaccard_join": lambda s, d: ngram_join.op1(t(s, d, "documents")),
        "op2_language_id": lambda s, d: langid.op2(t(s, d, "documents")),
        "op3_line_dedup": lambda s, d: line_dedup.op3(t(s, d, "documents")),
        "op4_mixing": lambda s, d: mixing.op4(t(s, d, "documents")),
        "op5_nearest_neighbours": lambda s, d: neighbours.op5(t(s, d, "embeddings")),
        "op6_toxicity": lambda s, d: toxicity.op6(t(s, d, "documents"), t(s, d, "labels")),
        "op7_sharding": lambda s, d: sharding.op7(t(s, d, "documents")),
        "op8_decontamination": lambda s, d: decontamination.op8(t(s, d, "documents"), t(s, d, "benchmark")),
        "op9_pitman_yor": lambda s, d: language_model.op9(t(s, d, "documents")),
        "op10_preference_chat": lambda s, d: chat.op10(t(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL}


#: All pairs that share a shingle, by brute force, and the closure of their links.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
         ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) END AS sh
  FROM w),
classes AS (SELECT list_sort(sh) AS sh, min(doc_id) AS low, len(any_value(sh)) AS n, row_number() OVER () AS cid FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
e AS (SELECT cid, n, unnest(sh) AS g FROM classes),
common AS (SELECT a.cid AS a, b.cid AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.cid < b.cid AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT cid AS x, cid AS y FROM classes UNION SELECT r.x, b.b FROM reach r JOIN twoway b ON r.y = b.a),
least AS (SELECT r.x, min(c.low) AS component_id FROM reach r JOIN classes c ON r.y = c.cid GROUP BY r.x),
named AS (SELECT c.sh, l.component_id FROM classes c JOIN least l ON l.x = c.cid)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN named m ON list_sort(s.sh) = m.sh
"""
