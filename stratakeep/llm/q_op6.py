"""Query op6: every document as a stored image, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media as M
from ._common import discard, materialise, table


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = M.store(docs, M.media_folder(spark))
    # digests are joined as bytes; what was read back has the digest that it was stored under
    described = M.features(M.metadata(stored)).withColumns({"digest": F.unhex("digest"), "media_sha256": F.unhex("media_sha256")}).drop("payload_sha256", "depth", "colour")
    described = materialise(described, "described")
    discard(stored)
    hexed = lambda name: F.lower(F.hex(name))
    columns = ["doc_id", "n_bytes", "payload_bytes", hexed("digest").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), hexed("media_sha256").alias("media_sha256"), "feature", "width", "height", "shard", "offset"]
    return M.addressed(docs).withColumn("digest", F.unhex("digest")).join(described, "digest").select(*columns)


QUERIES = {"op6_media": op6_media}
ORACLE: dict[str, str] = {}
