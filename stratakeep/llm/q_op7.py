"""Query op7: rates that mix all documents to target shares of the languages.

``p_en`` and the like are posteriors of the languages; null where no labelled document has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing as M
from ._common import table

#: Wanted shares of all tokens.
TARGETS = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = M.labelled_table(docs, table(spark, sf_dir, "labels"), "lang")
    mixed, said = M.mix(docs.select("doc_id", "text"), labelled, TARGETS)
    at = {name: i for i, name in enumerate(said["domains"])}
    own = lambda name: F.get("posteriors", F.lit(at[name])) if name in at else F.lit(None).cast("double")
    return mixed.select("doc_id", "n_tokens", "domain", "rate", *[own(name).alias(f"p_{name}") for name in TARGETS])


QUERIES = {"op7_mixing": op7_mixing}
ORACLE: dict[str, str] = {}
