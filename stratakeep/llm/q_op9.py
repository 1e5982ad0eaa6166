"""Query op9: repeated 35-word windows of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import substrings as S
from ._common import table


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


QUERIES = {"op9_substrings": op9_substrings}
ORACLE = {
    "op9_substrings": """
        WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
        n AS (SELECT doc_id, w, len(w) AS n FROM d),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM n, LATERAL (SELECT unnest(range(1, n.n - 33)) AS i)),
        rep AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) r USING (s)),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(35) t(j)),
        lost AS (SELECT doc_id, list(p) AS ps, count(*) AS k FROM gone GROUP BY doc_id)
        SELECT doc_id, n AS n_words, coalesce(k, 0) AS n_removed,
               sha256(array_to_string(CASE WHEN k IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM n LEFT JOIN lost USING (doc_id)
"""
}
