"""Query op4: toxicity of all documents, learnt from two thirds of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity as X
from ._common import table

HELD_OUT = "pmod(crc32(cast(doc_id as string)), 3) = 1"
THRESHOLD = 0.7


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = X.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), f"NOT ({HELD_OUT})")
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
