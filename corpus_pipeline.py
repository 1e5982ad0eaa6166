"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the
next one's docs; all but the last return the columns of ``documents``.  What a stage decides takes
effect: toxic documents go, of each near-duplicate class the smallest id stays, repeated passages
are cut out of the texts, rows are repeated as their rates say, texts are encoded.  Clean documents
stay as they are: a text without a repeated passage keeps its bytes, and the mixing stage takes
rates of at least 1, so it repeats documents and never drops one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakeep.llm import minhash, mixing, sentencepiece, substrings, toxicity
from stratakeep.llm._common import materialise, scratch, table
from stratakeep.llm.q_op2 import model_path
from stratakeep.llm.q_op4 import HELD_OUT, THRESHOLD

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least similarity of near duplicates on five-word shingles, in percent.
NEAR_PERCENT = 80
#: Wanted shares of the tokens by language.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Rows go by their text, so every copy of a toxic text goes, with or without an id, and other
    texts under the same id stay.
    """
    with scratch(spark) as keep:
        scored = toxicity.score(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), f"NOT ({HELD_OUT})")
        toxic = keep(materialise(scored.where(F.col("score") >= THRESHOLD).select("content").distinct(), "toxic"))
    content = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.select(*COLUMNS).withColumn("content", content).join(toxic, "content", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate class; rows with a null id stay."""
    classes = minhash.near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT)
    copies = materialise(classes.where("NOT kept").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a document of which nothing is left stays empty."""
    cut = substrings.remove(docs, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated until expected tokens by language stand in the wanted proportion."""
    labelled = mixing.labelled_table(docs, table(spark, sf_dir, "labels"), "lang")
    return mixing.resample(docs, labelled, TARGETS, least=1.0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and their byte spans, with the digests of ids and decoded text."""
    encoded = sentencepiece.encode(docs, model_path(), outputs=("ids", "begin", "end", "decoded"), keep=["doc_id", "lang", "source"])
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", "lang", "source", "ids", "begin", "end", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("mixing", mix_languages),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The stages on scores and near duplicates are iterative; tests compare them with brute force.
ORACLE_SQL = None
