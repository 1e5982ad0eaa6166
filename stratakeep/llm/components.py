"""Connected components of an edge table by hooking and pointer jumping, all in DataFrames.

Every node hooks onto its least smaller neighbour, the resulting forest is flattened by pointer
jumping, edges are relabelled with the roots, and so on until no edge joins two roots.  Each step
is one or two exchanges on narrow rows with map-side aggregation, written to the shared folder;
nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between roots, each once, smaller end first."""
    to = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
    a, b = F.coalesce("a_root", "a"), F.coalesce("b_root", "b")
    return moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def _flatten(hooks: DataFrame) -> DataFrame:
    """Follow ``root`` until it is not itself a node."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialise(hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jump")
        discard(hooks)
        hooks = jumped
        if not hooks.where("moved").limit(1).count():
            return _kept(hooks)


def _kept(hooks: DataFrame) -> DataFrame:
    out = hooks.select("node", "root")
    out._stratakeep_path = hooks._stratakeep_path
    return out


def merge(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (node, root) for every node that isn't the least of its component.

    ``edges`` has columns a and b (long).  ``known`` is an earlier result to extend.
    Nulls in either end make no edge; loops and repeated edges change nothing.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    if known is not None:
        edges = _relabel(edges, known)
    edges = materialise(edges, "edges")
    total = known
    while edges.limit(1).count():
        hooks = _flatten(materialise(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks"))
        if total is None:
            total = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = total.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            total = materialise(moved.unionByName(hooks), "roots")
        further = materialise(_relabel(edges, hooks), "edges")
        discard(edges)
        edges = further
    if total is None:
        total = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    return total
