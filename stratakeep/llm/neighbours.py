"""Approximate nearest neighbours by learned partitions.

1. A bounded sample (``sample``) gives a neighbour graph, which is cut into balanced partitions:
   grown from seeds under a capacity, then refined by moves and swaps that cut fewer edges.
2. A small classifier (one hidden layer) learns from a vector the partitions of its neighbours.
3. Every row goes to its most probable partition.  A query goes to its ``probes`` most probable
   partitions and is compared exactly, in double precision, with every row of them.

``probes`` is set on held-out vectors of the sample so that their true neighbours are found with
``target`` probability.  There are ``LEAST_PARTITIONS`` at any size, and one for every
``rows_per_partition`` rows.  Where one sample can't teach so many (``VECTORS_PER_PARTITION`` each),
every partition of the first router is cut again by a router of its own, learnt from a sample of
the partition, in executors; a query goes to the leaves whose product of both probabilities is
largest.  Two levels of the default sample make up to 250 x 250 leaves, which the default size of
a leaf fills with 128 million different vectors; beyond that leaves grow, or ``sample`` must.
Partitions are worked off in blocks of rows, so no task holds a whole one.

Equal vectors are one entry that keeps its k + 1 smallest ids, which is exact because ties go to
the smaller id: a vector that a third of all rows share costs one comparison.

Edge cases: null vectors, zero vectors and vectors with null or non-finite components take no part,
and so do vectors whose length isn't the most frequent one (smallest on ties) and rows with a null
id; rows that repeat an id count once for each different vector; with fewer than k candidates all
are returned; without queries the result is empty.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, released, ship

SAMPLE = 4000
HELD_OUT = 500
DEGREE = 10
ROWS_PER_PARTITION = 2048
LEAST_PARTITIONS = 8
#: Sample vectors that a partition is learnt from, at least.
VECTORS_PER_PARTITION = 16
HIDDEN = 64
TARGET = 0.97
BLOCK = 4096
#: Vectors whose probabilities of all leaves are held at a time.
ROUTED = 128


#: What the last search fitted: partitions, partitions asked, different vectors.
_FITTED: dict[str, int] = {}


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the ``degree`` nearest other rows of each unit vector."""
    out = np.empty((len(x), degree), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_partition(graph: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Cut a neighbour graph into ``parts`` of at most ceil(n / parts * slack) nodes each."""
    n = len(graph)
    capacity = int(np.ceil(n / parts * slack))
    rng = np.random.default_rng(seed)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    adjacent = [np.array([*row, *back[i]], np.int64) for i, row in enumerate(graph)]
    label = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    # grow each part breadth first to its share
    order = iter(rng.permutation(n))
    for p in range(parts):
        share = n // parts + (p < n % parts)
        queue: list[int] = []
        head = 0
        while size[p] < share:
            while head < len(queue) and label[queue[head]] >= 0:
                head += 1
            if head == len(queue):
                start = next(i for i in order if label[i] < 0)
                queue.append(start)
            node = queue[head]
            label[node] = p
            size[p] += 1
            queue.extend(j for j in adjacent[node] if label[j] < 0)
    for _ in range(rounds):
        moved = 0
        wish: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i in rng.permutation(n):
            votes = np.bincount(label[adjacent[i]], minlength=parts)
            own = label[i]
            best = int(votes.argmax())
            gain = int(votes[best] - votes[own])
            if gain <= 0:
                continue
            if size[best] < capacity:
                size[own] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
                continue
            other = wish.get((best, own))  # someone there who wants to come here
            if other:
                j, _ = other.pop()
                if label[j] == best:
                    label[i], label[j] = best, own
                    moved += 2
                    continue
            wish.setdefault((own, best), []).append((int(i), gain))
        if moved < n // 200:
            break
    return label


class Router:
    """Softmax over partitions after one hidden layer; trained by Adam on soft targets."""

    def __init__(self, dim: int, parts: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w1 = rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN))
        self.b1 = np.zeros(HIDDEN)
        self.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts))
        self.b2 = np.zeros(parts)
        self.scale = np.sqrt(dim)
        self.parts = parts

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                inp = x[i] * self.scale
                hidden = np.maximum(inp @ self.w1 + self.b1, 0)
                z = hidden @ self.w2 + self.b2
                z = np.exp(z - z.max(axis=1, keepdims=True))
                g = (z / z.sum(axis=1, keepdims=True) - target[i]) / len(i)
                gh = (g @ self.w2.T) * (hidden > 0)
                grads = [inp.T @ gh, gh.sum(0), hidden.T @ g, g.sum(0)]
                step += 1
                now = rate * (1 - epoch / epochs)
                for p, d, mi, vi in zip(params, grads, m, v, strict=True):
                    d = d + decay * p
                    mi += 0.1 * (d - mi)
                    vi += 0.001 * (d * d - vi)
                    p -= now * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)


def fit_router(sample: np.ndarray, parts: int, target: float = TARGET, k: int = 5) -> tuple[Router, int]:
    """The classifier and how many partitions a query needs, from sample vectors of any length."""
    train, test = _held_out(sample)
    router = Router(sample.shape[1], parts)
    if len(train) <= max(DEGREE, 2 * parts):  # too few to learn from: every partition is asked
        return router, parts
    graph = neighbour_graph(train, min(DEGREE, len(train) - 1))
    label = balanced_partition(graph, parts)
    soft = np.zeros((len(train), parts))
    np.add.at(soft, (np.repeat(np.arange(len(train)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    soft[np.arange(len(train)), label] += 0.5
    router.fit(train, soft)
    return router, probes_needed(Tree(router), train, test, target, k)


def _held_out(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors to learn from, and those that are kept back."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    held = min(HELD_OUT, len(x) // 5)
    return x[held:], x[:held]


def probes_needed(tree: Tree, train: np.ndarray, test: np.ndarray, target: float, k: int) -> int:
    """How many leaves to ask so that a neighbour of a held-out vector is among them with ``target`` probability."""
    near, home, needed = np.argsort(-(test @ train.T), axis=1)[:, :k], tree.home(train), []
    for a in range(0, len(test), ROUTED):
        s = tree.scores(test[a : a + ROUTED])
        theirs = np.take_along_axis(s, home[near[a : a + ROUTED]], axis=1)
        needed += [1 + (s > theirs[:, j : j + 1]).sum(axis=1) for j in range(theirs.shape[1])]
    ranks = np.sort(np.concatenate(needed)) if needed else np.array([])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) if len(ranks) else tree.leaves


class Tree:
    """A router, and below some of its partitions (by number) one more each; leaves are numbered through."""

    def __init__(self, top: Router, below: dict[int, Router] | None = None):
        self.top, self.below = top, below or {}
        self.first = np.cumsum([0] + [self.below[p].parts if p in self.below else 1 for p in range(top.parts)])
        self.leaves = int(self.first[-1])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that unit vectors live in."""
        part = self.top.scores(x).argmax(axis=1)
        leaf = self.first[part]
        for p in np.unique(part):
            if p in self.below:
                leaf[part == p] += self.below[p].scores(x[part == p]).argmax(axis=1)
        return leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of every leaf's probability."""
        s = _log_softmax(self.top.scores(x))
        if not self.below:
            return s
        out = np.repeat(s, np.diff(self.first), axis=1)
        for p, router in self.below.items():
            out[:, self.first[p] : self.first[p + 1]] += _log_softmax(router.scores(x))
        return out

    def best(self, x: np.ndarray, count: int) -> np.ndarray:
        """The most probable leaves of unit vectors, a few vectors at a time."""
        few = [np.argsort(-self.scores(x[a : a + ROUTED]), axis=1, kind="stable")[:, :count] for a in range(0, len(x), ROUTED)]
        return np.concatenate(few)


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def fit_tree(entries: DataFrame, total: int, sample: int, target: float, k: int, rows_per_partition: int) -> tuple[Tree, int]:
    """Routers for ``total`` entries (key, v), and how many leaves a query needs."""
    if not total:
        return Tree(Router(1, 1)), 1
    drawn = np.array([r.v for r in entries.orderBy(F.xxhash64("key"), "key").limit(sample).collect()])
    wanted, taught = max(LEAST_PARTITIONS, round(total / rows_per_partition)), max(LEAST_PARTITIONS, len(drawn) // VECTORS_PER_PARTITION)
    if wanted <= taught:
        top, probes = fit_router(drawn, wanted, target, k)
        return Tree(top), probes
    top, _ = fit_router(drawn, min(taught, int(np.ceil(np.sqrt(wanted)))), target, k)
    shared = entries.sparkSession.sparkContext.broadcast(top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if len(x):
                part = shared.value.scores(x / np.linalg.norm(x, axis=1, keepdims=True)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["key", "v", "part"])

    placed = materialise(entries.select("key", "v").mapInArrow(released(place), "key string, v array<double>, part int"), "first-level")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    # twice the share that gives a sample, by a hash of the key, then its first ones
    turn = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = placed.join(F.broadcast(sizes), "part").withColumn("turn", turn).where(F.col("turn") * F.col("size") < F.lit(2 * sample))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "key"]).head(sample)
        parts = min(round(rows["size"].iat[0] / rows_per_partition), len(rows) // VECTORS_PER_PARTITION)
        fitted = [pickle.dumps(fit_router(np.stack(rows["v"].to_list()), parts, target, k)[0])] if parts > 1 else []
        return pd.DataFrame({"part": [rows["part"].iat[0]] * len(fitted), "router": fitted})

    # as many rows as the first router has partitions, each of the size of a router
    below = {r.part: pickle.loads(r.router) for r in some.groupBy("part").applyInPandas(learn, "part int, router binary").collect()}
    tree = Tree(top, below)
    train, test = _held_out(drawn)
    return tree, probes_needed(tree, train, test, target, k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (id, v) that can take part, v as array<double>."""
    v = F.col(f"`{embedding}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), fine.alias("fine")).where("id IS NOT NULL AND v IS NOT NULL AND fine AND exists(v, x -> x <> 0)")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (common[0].d if common else 0)).select("id", "v")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row a distinct vector: key, v, ids (its ``keep`` smallest), collapsed in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = _matrix(batch.column(1)) + 0.0  # one zero
            groups: dict[bytes, list[int]] = {}
            for i, row in enumerate(x):
                groups.setdefault(hashlib.md5(row.tobytes()).digest(), []).append(i)
            first = [g[0] for g in groups.values()]
            least = [sorted({int(ids[i]) for i in g})[:keep] for g in groups.values()]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k.hex() for k in groups], pa.string()), batch.column(1).take(pa.array(first, pa.int64())), pa.array(least, kind)], names=["key", "v", "ids"])

    local = rows.mapInArrow(released(run), "key string, v array<double>, ids array<long>")
    return local.groupBy("key").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def keyed(rows: DataFrame) -> DataFrame:
    """id and key of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(row.tobytes()).hexdigest() for row in x], pa.string())], names=["id", "key"])

    return rows.mapInArrow(released(run), "id long, key string")


def search(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, target: float = TARGET, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The k nearest found of every row for which ``is_query`` (a column over ``id``) holds.

    Rows: query_id, rank (from 1), vec_id, score (cosine in double precision), nearest first, ties
    to the smaller vec_id; a query is no candidate of its own.
    """
    spark = df.sparkSession
    ship(spark)
    rows = usable(df, vec_id, embedding)
    entries = materialise(distinct_vectors(rows, k + 1), "vectors")
    total = entries.count()
    tree, probes = fit_tree(entries, total, sample, target, k, rows_per_partition)
    _FITTED.update(parts=tree.leaves, probes=probes, vectors=total)
    shared = spark.sparkContext.broadcast(tree)

    queries = keyed(rows.where(is_query))
    asked = entries.join(queries.select("key").distinct(), "key", "left_semi")

    def route(count: int):
        """Batches with the ``count`` most probable leaves of every vector, or with its home for 0."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                if not len(x):
                    continue
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                best = (shared.value.best(unit, count) if count else shared.value.home(unit)[:, None]).astype(np.int32)
                offsets = pa.array(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(batch.columns + [pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))], names=["key", "v", "ids", "parts"])

        return run

    schema = "key string, v array<double>, ids array<long>, parts array<int>"
    placed = materialise(entries.select("key", "v", "ids").mapInArrow(released(route(0)), schema).select("key", "v", "ids", F.col("parts")[0].alias("part")), "placed")
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    grouped = placed.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    routed = materialise(asked.select("key", "v", "ids").mapInArrow(released(route(probes)), schema).select("key", "v", F.explode("parts").alias("part")), "routed")
    load = routed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares"))
    # blocks of rows meet blocks of queries: both sides of a group are bounded
    left = grouped.join(F.broadcast(load), "part").select("part", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "key", "v", "ids")
    right = routed.join(F.broadcast(load), "part").join(F.broadcast(sizes), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("shares")).cast("int").alias("share"), "key", "v")

    def compare(rows_: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "score": [], "ids": []}
        if len(rows_) and len(asks):
            x, y = np.stack(rows_["v"].to_list()), np.stack(asks["v"].to_list())
            first = np.array([i[0] for i in rows_["ids"]])
            nx = np.sqrt((x * x).sum(axis=1))
            for a in range(0, len(y), 256):
                part = y[a : a + 256]
                s = (part @ x.T) / (np.sqrt((part * part).sum(axis=1))[:, None] * nx[None, :])
                for i, row in enumerate(s):
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1]) if len(row) > k + 1 else np.arange(len(row))
                    near = near[np.lexsort((first[near], -row[near]))][: k + 1]
                    out["query"] += [asks["key"].iat[a + i]] * len(near)
                    out["score"] += row[near].tolist()
                    out["ids"] += [rows_["ids"].iat[j] for j in near]
        return pd.DataFrame(out)

    found = left.groupBy("part", "block", "share").cogroup(right.groupBy("part", "block", "share")).applyInPandas(compare, "query string, score double, ids array<long>")
    pairs = found.select("query", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id")))).alias("x"))
    best = materialise(pairs.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k + 1).alias("best")), "best")
    answers = queries.join(best.withColumnRenamed("query", "key"), "key").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    listed = answers.select("query_id", F.posexplode("best").alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
