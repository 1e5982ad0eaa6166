"""Query op10: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import minhash as M
from ._common import table


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


QUERIES = {"op10_minhash": op10_minhash}
ORACLE = {
    "op10_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 4], ' ')) AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(d.w) - 3, CASE WHEN len(d.w) > 0 THEN 2 ELSE 1 END))) AS i)),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM both_ JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, side.b FROM reach JOIN side ON side.a = reach.b)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.m AS component_id, r.m = d.doc_id AS kept
        FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
}
