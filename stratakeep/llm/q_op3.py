"""Query op3: all pages written to archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warc as W
from ._common import table


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = W.write(W.plan_records(table(spark, sf_dir, "pages")), W.archive_folder(spark))
    return W.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLE = {
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """
}
