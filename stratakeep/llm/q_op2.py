"""Query op2: digests of the encoding and decoding of every document, and the byte span of every id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepiece as S
from ._common import table


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *[c for c in ("begin", "end") if c in encoded.columns],
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(S.encode(docs, model_path(), outputs=("ids", "begin", "end", "decoded"), keep=["doc_id"]))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE: dict[str, str] = {}
