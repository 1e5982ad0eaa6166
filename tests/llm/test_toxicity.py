import random
import zlib

import numpy as np
import pytest

from stratakeep.llm import toxicity as X


def corpus(n=600, seed=5):
    rnd = random.Random(seed)
    plain = [f"wort{chr(97 + i % 26)}{i}" for i in range(400)]
    plain = ["".join(rnd.choice("abcdefghijklmnoprstuv") for _ in range(rnd.randrange(2, 9))) for _ in range(500)]
    bad = ["scoundrel", "villainous", "vermin", "rotten"]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 60))]
        if toxic:
            words += rnd.sample(bad, 2) + [rnd.choice(bad) + rnd.choice(["s", "ly", ""])]
        elif rnd.random() < 0.03:
            words.append("rotten")
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def exact_nearest(vectors, query, k, without=-1):
    scores = []
    q = dict(zip(*query, strict=True))
    for i, (t, w) in enumerate(vectors):
        s = sum(x * q.get(a, 0.0) for a, x in zip(t, w, strict=True))
        if s > 0 and i != without:
            scores.append((-s, i))
    return [(i, -s) for s, i in sorted(scores)][:k]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_block_max_index_is_exact(monkeypatch, seed):
    monkeypatch.setattr(X, "BLOCK", 4)
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(150):
        t = np.sort(rng.choice(30, int(rng.integers(1, 8)), replace=False))
        w = rng.random(len(t)) ** 4 + 0.01
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = X.BlockMaxIndex(vectors, 30)
    for i, (t, w) in enumerate(vectors[:60]):
        for without in (-1, i):
            got, similarity = index.nearest(t, w, 7, without)
            want = exact_nearest(vectors, (t, w), 7, without)
            assert np.allclose(sorted(similarity), sorted(s for _, s in want))
            bound = min((s for _, s in want), default=0)
            assert {g for g, s in zip(got, similarity, strict=True) if s > bound + 1e-9} == {g for g, s in want if s > bound + 1e-9}


def test_blocks_out_of_reach_are_not_read():
    rng = np.random.default_rng(7)
    vectors = []
    for i in range(6000):  # a common term, and two of a group's own terms
        t = np.array([0, *sorted(1 + 20 * (i % 40) + rng.choice(20, 2, replace=False))])
        w = np.array([0.3, *(1 + rng.random(2))])
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = X.BlockMaxIndex(vectors, 801)
    for i in rng.choice(6000, 50, replace=False):
        got, similarity = index.nearest(*vectors[i], 16)
        want = exact_nearest(vectors, vectors[i], 16)
        assert np.allclose(similarity, [s for _, s in want])
    assert index.listed > 50 * 6000 and index.read < 0.2 * index.listed


def test_held_out_accuracy_evidence_and_no_leak(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    where = "pmod(crc32(cast(doc_id as string)), 3) <> 1"
    got = {r.doc_id: r for r in X.score(docs, marks, where).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    truth = dict(labels)
    wrong = sum((got[i].score >= 0.7) != truth[i] for i in held)
    assert wrong / len(held) < 0.05
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not {e.doc_id for r in got.values() for e in r.evidence} & held
    assert all(e.label == truth[e.doc_id] and 0 < e.similarity <= 1 + 1e-9 for r in got.values() for e in r.evidence)
    # held-out labels change nothing
    turned = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in X.score(docs, turned, where).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_counts_of_kept_terms():
    vocabulary = X.Vocabulary(["villain", "vill*", "vill* 2", "rotten 2", "rotten %", "villa*"])
    text = "Villain villainous ROTTEN rotten " + "x " * 300
    assert vocabulary.count(text) == {0: 1, 1: 2, 2: 1, 3: 1, 5: 2}
    assert {"villain", "vill*", "rotten 2", "vill* 2"} <= X.terms(text) and "rotten %" not in X.terms(text)
    assert {vocabulary.index[t] for t in X.terms(text) & set(vocabulary.index)} == set(vocabulary.count(text))


def test_edge_cases(spark):
    rows, labels = corpus(300)
    extra = [(None, "vermin rotten villainous scoundrel"), (1000, None), (1001, ""), (1002, "!!! 123"), (3, rows[3][1]), (1003, "vermin " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows + extra], "doc_id long, text string, toxic int, score double")
    marks = spark.createDataFrame([*labels, (4, 1), (None, 1), (5, None), (77_777, 1)], "doc_id long, toxic int")
    got = X.score(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] == by[1002] < 0.5 and by[1003] > 0.5 and by[None] > 0.7
    assert {r.score for r in X.score(docs, marks.limit(0)).collect()} == {0.0}
    assert X.score(docs.limit(0), marks).count() == 0
    assert X.score(docs, marks.where("toxic = 1")).count() == len(got)


def test_rare_and_mixed_terms_are_kept(spark):
    # in 7 of 800 toxic and no clean example; in 80 toxic and 120 of 3,200 clean ones
    rows = [("vile " * (i < 7) + "bad " * (i < 80) + "x", 1) for i in range(800)] + [("bad " * (i < 120) + "x", 0) for i in range(3200)]
    examples = spark.createDataFrame(rows, "text string, toxic int")
    assert {"vile", "bad"} <= set(X.fit_terms(examples)) and "x" not in X.fit_terms(examples)
