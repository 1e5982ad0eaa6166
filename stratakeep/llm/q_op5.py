"""Query op5: repeated 100-byte strings of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bytespans as B
from ._common import table


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)


QUERIES = {"op5_suffix_array": op5_suffix_array}
ORACLE = {
    "op5_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
        win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM b, LATERAL (SELECT unnest(range(0, b.n - 99)) AS i)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5_number(s) ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
        runs AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS gap FROM later),
        edge AS (SELECT doc_id, i, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM runs),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM edge GROUP BY doc_id, r),
        cut AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends, sum(z - a) AS k, count(*) AS spans FROM span GROUP BY doc_id),
        kept AS (SELECT b.doc_id, n, k, spans, CASE WHEN k IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 2), lambda x: substr(h, 2 * CASE WHEN x = 1 THEN 0 ELSE ends[x - 1] END + 1, 2 * ((CASE WHEN x > len(starts) THEN n ELSE starts[x] END) - CASE WHEN x = 1 THEN 0 ELSE ends[x - 1] END))), '') END AS left_over FROM b LEFT JOIN cut USING (doc_id))
        SELECT doc_id, n AS n_bytes, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM kept
"""
}
