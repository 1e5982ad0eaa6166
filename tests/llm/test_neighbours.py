import numpy as np
from pyspark.sql import functions as F

from stratakeep.llm import neighbours as N


def brute(ids, x, queries, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(queries):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(40, size=9000)] + rng.normal(size=(9000, 32))
    x[1000:1800] = x[7]  # many copies of one vector
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, id int")
    got = {}
    for r in N.search(rows, F.col("id") % 50 == 0, k=5, sample=3000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.arange(9000)
    want = brute(ids, x.astype(np.float32).astype(float), ids % 50 == 0, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({v for _, v, _ in got[q]} & set(want[q])) for q in want if not 1000 <= q < 1800)
    assert hits >= 0.9 * 5 * sum(not 1000 <= q < 1800 for q in want)
    assert [v for _, v, _ in sorted(got[1000])] == [7, 1001, 1002, 1003, 1004]  # ties to the smaller id


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    label = N.balanced_partition(N.neighbour_graph(x / np.linalg.norm(x, axis=1, keepdims=True), 10), 7)
    assert np.bincount(label, minlength=7).max() <= np.ceil(1000 / 7 * 1.05) and label.min() == 0


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (100, None), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (350, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in N.search(frame, F.col("id") % 50 == 0).distinct().collect())
    assert got == [(0, 1, 7, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 7, 0.0)]
    assert N.search(frame.limit(0), F.col("id") % 50 == 0).count() == 0


def test_probes_are_set_for_97_of_100_neighbours():
    x = np.random.default_rng(2).normal(size=(2000, 16))
    assert N.fit_router(x, 20)[1] == N.fit_router(x, 20, 0.97)[1] > N.fit_router(x, 20, 0.9)[1]


def test_routers_below_a_router(spark):
    """More partitions than one sample can teach: recall holds, and few of the leaves are asked."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(60, size=8000)] + 0.6 * rng.normal(size=(8000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in N.search(rows, F.col("id") % 50 == 0, k=5, sample=800, rows_per_partition=80).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(8000), x.astype(np.float32).astype(float), np.arange(8000) % 50 == 0, 5)
    hits = sum(len(got[q] & set(want[q])) for q in want)
    assert N._FITTED["parts"] > 800 // N.VECTORS_PER_PARTITION and N._FITTED["probes"] < N._FITTED["parts"] / 2
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)


def test_leaves_are_numbered_through_and_their_probabilities_add_up():
    x = np.random.default_rng(3).normal(size=(50, 6))
    tree = N.Tree(N.Router(6, 3), {0: N.Router(6, 4, 1), 2: N.Router(6, 2, 2)})
    assert tree.leaves == 7 and list(tree.first) == [0, 4, 5, 7]
    s = tree.scores(x)
    assert np.allclose(np.exp(s).sum(axis=1), 1) and (np.sort(tree.best(x, 7), axis=1) == np.arange(7)).all()
    assert (tree.home(x) < 7).all() and (tree.best(x, 1)[:, 0] == s.argmax(axis=1)).all()
