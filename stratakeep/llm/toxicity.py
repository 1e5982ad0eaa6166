"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. Terms are lower-cased words and word beginnings of 4 to 6 letters, and for each the levels of
   frequency that a text reaches.  On a bounded sample of the labelled rows (``max_examples``)
   those that go with the toxic label are kept, all of them: whoever is significant at ``LEAST_Z``
   in ``LEAST_DOCS`` toxic texts.  Vectors over every term of a text, without this choice, find far
   fewer toxic texts (README has the figures): names and rare words drown the few that tell.
2. One pass over all documents notes which kept terms each has and how often; document
   frequencies for the inverse weights are counted over the whole corpus.
3. The sample's vectors form an inverted index over blocks of alike examples with the largest
   weight of each term in each block.  A query opens only blocks whose bound reaches its k-th
   score; the result is exact.
4. Votes weighted by similarity, smoothed by the rate among examples without any kept term, are
   calibrated by a logistic fit on leave-one-out votes.  The nearest examples are the evidence.

Copies of one text are one example (the smallest id, the largest label): they are no further
evidence that a word goes with the label.

Edge cases: null and empty texts, and texts without a kept term, get the rate of such examples;
without labelled rows every score is 0; rows with a null doc_id are scored and never trained on;
repeated label rows of a document count as its largest label, null labels count for nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, released, ship

MAX_EXAMPLES = 20_000
LEAST_Z = 5.0
LEAST_DOCS = 4
NEIGHBOURS = 16
BLOCK = 64
#: Blocks of largest bounds that give a query its first k-th score.
FIRST_BLOCKS = 8
#: Rows that one task scores.
ROWS_OF_A_TASK = 8192
SMOOTHING = 0.5
#: Texts whose terms one task holds together, and scores that it remembers.
ROWS_AT_ONCE = 128
KNOWN = 2000
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


#: How often a term stands in a text is told by further terms: so many times, and a share of words.
LEVELS = (2, 4)
DENSE = 0.01


def term_counts(text: str) -> tuple[dict[str, int], int]:
    """Words and beginnings of longer words (marked by a star) with their counts; words in all."""
    words = Counter(_WORD.findall(text.lower()))
    out: dict[str, int] = dict(words)
    for w, c in words.items():
        for n in PREFIXES:
            if len(w) > n:
                key = w[:n] + "*"
                out[key] = out.get(key, 0) + c
    return out, sum(words.values())


def levels(count: int, words: int) -> list[str]:
    """Marks of the levels that a count reaches."""
    return [f" {n}" for n in LEVELS if count >= n] + ([" %"] if count >= DENSE * words else [])


def terms(text: str) -> set[str]:
    """All terms of a text, with their levels."""
    counts, words = term_counts(text)
    return set(counts) | {t + mark for t, c in counts.items() for mark in levels(c, words)}


class Vocabulary:
    """Counts kept terms in texts."""

    def __init__(self, kept: list[str]):
        self.index = {t: i for i, t in enumerate(kept)}
        base = {t.split(" ")[0] for t in kept}
        self.words = {t for t in base if not t.endswith("*")}
        self.starts = {t[:-1]: t for t in base if t.endswith("*")}
        self.least = {s[: PREFIXES[0]] for s in self.starts}

    def count(self, text: str) -> dict[int, int]:
        counts = Counter(_WORD.findall(text.lower()))
        base: dict[str, int] = {w: counts[w] for w in counts.keys() & self.words}
        least, starts = self.least, self.starts
        for word in [w for w in counts if w[:4] in least]:
            for n in PREFIXES:
                term = starts.get(word[:n]) if len(word) > n else None
                if term is not None:
                    base[term] = base.get(term, 0) + counts[word]
        out: dict[int, int] = {}
        words = sum(counts.values())
        for term, c in base.items():
            if term in self.index:
                out[self.index[term]] = c
            for mark in levels(c, words):
                if term + mark in self.index:
                    out[self.index[term + mark]] = 1
        return out


class BlockMaxIndex:
    """Inverted index of unit vectors over blocks of rows.

    Rows are laid out by their heaviest terms, so that a block's rows are alike, and ``BLOCK``
    neighbours form a block.  A term's postings are cut where the block changes, and each cut keeps
    its largest weight.  The products of a query's weights and these maxima, summed by block, bound
    every score in a block.  The ``FIRST_BLOCKS`` of largest bounds are opened first and give a k-th
    score; then those of the others that can reach it.  Postings of closed blocks are never read:
    ``read`` and ``listed`` count the postings that queries opened and that their terms have.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        self.read = self.listed = 0
        heaviest = [tuple(t[np.argsort(-w, kind="stable")]) for t, w in vectors]
        self.row = np.array(sorted(range(self.size), key=lambda i: (heaviest[i], i)), np.int64)  # of each place
        place = np.empty(self.size, np.int64)
        place[self.row] = np.arange(self.size)
        none = np.zeros(0)
        term = np.concatenate([v[0] for v in vectors]) if vectors else none.astype(np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else none
        at = place[np.repeat(np.arange(self.size), [len(v[0]) for v in vectors])] if vectors else none.astype(np.int64)
        order = np.lexsort((at, term))
        term, self.places, self.weights = term[order], at[order], weight[order]
        block = self.places // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.cut = np.append(first, len(term))  # postings of each cut
        self.cut_block = block[first]
        self.cut_max = np.maximum.reduceat(self.weights, first) if len(first) else none
        self.start = np.searchsorted(term[first], np.arange(n_terms + 1))  # cuts of each term

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest positive dot product (ties to smaller rows), and the products."""
        cuts, owner = _ranges(self.start[term], self.start[term + 1])
        weights, blocks = weight[owner], self.cut_block[cuts]
        self.listed += int((self.cut[cuts + 1] - self.cut[cuts]).sum())
        bound = np.bincount(blocks, weights * self.cut_max[cuts], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        first, rest = order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]
        found = [self._open(first, cuts, weights, blocks, without)]
        floor = _least_of(found[0][1], k)
        rest = rest[bound[rest] >= floor - 1e-12]
        if len(rest):
            found.append(self._open(rest, cuts, weights, blocks, without))
        row, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        near = np.flatnonzero(score >= _least_of(score, k))
        best = near[np.lexsort((row[near], -score[near]))][:k]
        return row[best], score[best]

    def _open(self, opened: np.ndarray, cuts: np.ndarray, weights: np.ndarray, blocks: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the blocks ``opened`` with positive products, and the products."""
        turn = np.full(self.blocks, -1, np.int64)
        turn[opened] = np.arange(len(opened))
        take = turn[blocks] >= 0
        postings, of = _ranges(self.cut[cuts[take]], self.cut[cuts[take] + 1])
        self.read += len(postings)
        local = turn[blocks[take]][of] * BLOCK + self.places[postings] % BLOCK
        score = np.bincount(local, weights[take][of] * self.weights[postings], len(opened) * BLOCK)
        at = np.flatnonzero(score)
        row = self.row[opened[at // BLOCK] * BLOCK + at % BLOCK]
        return (row, score[at]) if without < 0 else (row[row != without], score[at][row != without])


def _least_of(score: np.ndarray, k: int) -> float:
    """The k-th largest score; 0 where there are fewer."""
    return float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0.0


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, stop) in turn, and which range each is of."""
    size = stop - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size), owner


class Model:
    """Everything that scoring needs; it comes from max_examples labelled rows alone."""

    def __init__(self, kept: list[str], df: np.ndarray, n_docs: int, examples: list[tuple[int, int, dict[int, int]]], bare: tuple[int, int], k: int = NEIGHBOURS):
        self.idf = np.log((n_docs + 1) / (df + 1)) + 1 if len(kept) else np.zeros(0)
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], float)
        self.k = k
        vectors = [self.vector(e[2]) for e in examples]
        self.index = BlockMaxIndex(vectors, len(kept))
        n, toxic = bare
        self.rate = (toxic + 0.5 * (n == 0 and len(examples) > 0)) / max(1, n)
        self.a, self.b = 1.0, 0.0
        if len(set(self.labels)) == 2:
            raw = np.array([self._vote(*self.index.nearest(t, w, k, without=i)) for i, (t, w) in enumerate(vectors)])
            self.a, self.b = _platt(_logit(raw), self.labels)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        term = np.array(sorted(counts), np.int64)
        weight = (1 + np.log([counts[t] for t in term])) * self.idf[term]
        return term, weight / np.sqrt((weight**2).sum())

    def _vote(self, rows: np.ndarray, similarity: np.ndarray) -> float:
        weight = similarity**2
        return float((weight @ self.labels[rows] + SMOOTHING * self.rate) / (weight.sum() + SMOOTHING))

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[int, int, float]]]:
        if not counts or not self.index.size:
            return min(1.0, self.rate), []
        rows, similarity = self.index.nearest(*self.vector(counts), self.k)
        if not len(rows):
            return min(1.0, self.rate), []
        raw = _logit(np.array([self._vote(rows, similarity)]))[0]
        evidence = [(int(self.ids[r]), int(self.labels[r]), float(s)) for r, s in zip(rows[:3], similarity[:3], strict=True)]
        return float(1 / (1 + math.exp(-(self.a * raw + self.b)))), evidence


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on one value; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        s = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 1e-3 * (a - 1), (p - y).sum()])
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = max(0.1, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def sample_labels(labels: DataFrame, where: str | None, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """At most ``max_examples`` labelled rows (doc_id, toxic), the first by a hash of doc_id."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    rows = rows.where(where) if where else rows
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)


def fit_terms(examples: DataFrame) -> list[str]:
    """Terms that go with the toxic label in ``examples`` (text, toxic): largest z first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                toxic, all_ = Counter(), Counter()
                for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    found = terms(text.as_py() or "")
                    all_.update(found)
                    if label:
                        toxic.update(found)
                keys = list(all_)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([all_[t] for t in keys], pa.int64()), pa.array([toxic[t] for t in keys], pa.int64())], names=["term", "docs", "toxic"])

    sizes = examples.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = sizes.n, sizes.t or 0
    if not t or t == n:
        return []
    counts = examples.select("text", "toxic").mapInArrow(released(run), "term string, docs long, toxic long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    rate = F.col("docs") / n
    z = (F.col("toxic") / t - (F.col("docs") - F.col("toxic")) / (n - t)) / F.sqrt(rate * (1 - rate) * (1 / t + 1 / (n - t)))
    enough = (F.col("toxic") >= LEAST_DOCS) & (F.col("docs") < n)
    best = counts.where(enough).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    return [r.term for r in best.orderBy(F.desc("z"), "term").collect()]


def score(docs: DataFrame, labels: DataFrame, train_where: str | None = None, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, content (SHA-256 of the text), score and evidence for every row of ``docs``
    (doc_id, text).  A score depends on the text alone, so rows of equal content have equal ones.

    ``labels`` has doc_id and toxic (0/1); ``train_where`` restricts the rows that are learnt from.
    Labels and ids never enter a vector.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = materialise(sample_labels(labels, train_where, max_examples), "examples")
    named = docs.join(chosen, "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    alike = named.groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    examples = materialise(alike.select("doc_id", "toxic", "text"), "example-texts")
    kept = fit_terms(examples)
    shared_terms = spark.sparkContext.broadcast(kept)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared_terms.value)
        kind = pa.list_(pa.int32())
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = [sorted(vocabulary.count(t.as_py() or "").items()) for t in batch.column(1)]
                content = [hashlib.sha256((t.as_py() or "").encode()).digest() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array([[i for i, _ in f] for f in found], kind), pa.array([[c for _, c in f] for f in found], kind)], names=["doc_id", "content", "term", "tf"])

    counted = materialise(docs.mapInArrow(released(hits), "doc_id long, content binary, term array<int>, tf array<int>"), "term-counts")
    frequency = np.zeros(len(kept))
    for row in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        frequency[row.term] = row["count"]
    rows = examples.select("doc_id", "toxic").join(counted, "doc_id").dropDuplicates(["doc_id"])
    bare = rows.where("size(term) = 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    full = rows.where("size(term) > 0").orderBy("doc_id").collect()
    n_docs = counted.count()
    model = Model(kept, frequency, n_docs, [(r.doc_id, r.toxic, dict(zip(r.term, r.tf, strict=True))) for r in full], (bare.n, bare.t))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for t, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                key = (*t, -1, *c)
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = shared.value.score(dict(zip(t, c, strict=True)))
                out.append(known[key])
            evidence = [[{"doc_id": i, "label": y, "similarity": s} for i, y, s in e] for _, e in out]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "content", "score", "evidence"])

    dealt = counted.repartition(max(1, -(-n_docs // ROWS_OF_A_TASK)))
    return dealt.mapInArrow(released(run), "doc_id long, content binary, score double, evidence array<struct<doc_id: long, label: int, similarity: double>>")
