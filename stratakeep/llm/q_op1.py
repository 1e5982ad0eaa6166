"""Query op1: five nearest of every fiftieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neighbours as N
from ._common import table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


QUERIES = {"op1_neighbours": op1_neighbours}
ORACLE: dict[str, str] = {}
