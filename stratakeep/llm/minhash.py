"""Near-duplicate classes by min-max hashing, confirmed on full shingle sets.

Each permutation gives two signature values, the least and the greatest image of the set, so 64
permutations make 128 values for half the hash evaluations.  32 bands of 4 values name buckets: a
pair of Jaccard similarity 0.85 shares none of them with probability 6e-11.

1. Equal sets collapse to one representative (the smallest doc_id) before anything is paired.
2. Each member of a bucket is paired with the bucket's smallest member; for every document the
   pair of highest estimate is confirmed on the full sets, components are formed, then all its
   other pairs that still join two components are confirmed.
3. What a star can't show: members of buckets that still hold several components.  Shingles that
   no other such document has bound what a document can share: one with more than the threshold
   allows is linked with nothing and leaves, which is exact and ends families of copies that
   drifted too far.  The others are compared on full sets, block by block, and a pair of blocks
   gives no more links than join its components.

Hot groups therefore give one pair a member; no cap or sample is applied anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._common import materialise, released, scratch, ship, spread_join
from .components import merge

PERMUTATIONS = 64
BANDS = 32
ROWS = 2 * PERMUTATIONS // BANDS
SHINGLE = 5
#: Pairs whose signatures agree in a share smaller than the threshold by more can't reach it: it is
#: five standard deviations of 128 values at least.
MARGIN = 0.2
#: Members of a family, and shingles of them, in one block; a task compares two blocks.
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Shingles whose occurrences are multiplied at a time.
COLUMNS = 4096

_rng = np.random.default_rng(1985)
_XOR = _rng.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64) * G.U64(2) + G.U64(1)
_MUL = _rng.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64) * G.U64(2) + G.U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, concatenated, and their offsets.

    They are fingerprints, or with ``exact`` numbers that only equal word sequences of these
    documents share.  A-Z count as a-z.  With fewer words than ``size`` the whole sequence is the one
    shingle; without words there is none.
    """
    words = G.Words(data, offsets, lower=True)
    counts = np.diff(words.doc_start)
    at = G.valid_starts(words.doc_start, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if exact:
        names = words.names()
        value = G.gram_names(names, size)[at]
        whole = np.zeros(len(short), np.int64)
        for k in range(1, size):  # sequences of k words: below zero, k modulo size
            own = counts[short] == k
            if own.any():
                whole[own] = -(G.gram_names(names, k)[words.doc_start[short[own]]] * size + k)
    else:
        prints = words.fingerprints()
        value = G.FIRST.grams(prints, size)[at]
        whole = G.FIRST.spans(G.FIRST.runs(prints, 1), 1, words.doc_start[short], words.doc_start[short + 1])
    doc, value = np.concatenate((words.doc[at], short)), np.concatenate((value, whole))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(words.n_docs + 1))


def contents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digest of each document's words (two numbers): equal for equal word sequences."""
    words = G.Words(data, offsets, lower=True)
    size = words.end - words.start + 1
    stop = np.cumsum(size)
    at = np.repeat(words.start - (stop - size), size) + np.arange(int(size.sum()))
    plain = np.append(words.data, np.uint8(32))[at]
    plain[stop - 1] = 32
    bound = np.concatenate(([0], stop))[words.doc_start]
    digests = [hashlib.blake2b(plain[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bound[:-1], bound[1:], strict=True)]
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Min-max signatures of non-empty sets, one row of 2 * PERMUTATIONS values each."""
    out = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), np.uint64)
    for j in range(PERMUTATIONS):
        image = (values ^ _XOR[j]) * _MUL[j]
        image ^= image >> G.U64(29)
        out[:, 2 * j] = np.minimum.reduceat(image, offsets[:-1])
        out[:, 2 * j + 1] = np.maximum.reduceat(image, offsets[:-1])
    return out


_SKETCH = "doc_id long, n_shingles long, words_a long, words_b long, bands array<long>, sig binary"


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: size of its set, digest of its words, bucket names, a 16-bit signature."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = G.utf8(batch.column(1))
            for i, j in G.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                values, at = shingles(part, offsets[i : j + 1] - offsets[i])
                n = np.diff(at)
                full = np.flatnonzero(n)
                bands = np.zeros((j - i, BANDS), np.int64)
                sig = np.zeros((j - i, 2 * PERMUTATIONS), np.uint16)
                digest = contents(part, offsets[i : j + 1] - offsets[i])
                if len(full):
                    tight = np.append(at[full], len(values))
                    s = signatures(values, tight)
                    grouped = s.reshape(len(full), BANDS, ROWS)
                    name = np.full((len(full), BANDS), 7, np.uint64)
                    for r in range(ROWS):
                        name = G.mix(name * G.U64(0x9E3779B97F4A7C15) + grouped[:, :, r])
                    bands[full] = G.signed(name)
                    sig[full] = (G.mix(s) >> G.U64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "words_a", "words_b", "bands", "sig"],
                )

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(released(run), _SKETCH)


def _estimated(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the share of signature values on which they agree, if it is large enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(len(batch), -1) for k in (2, 3))
                share = (left == right).mean(axis=1)
                near = pa.array(np.flatnonzero(share >= percent / 100 - MARGIN))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near), pa.array(share).take(near)], names=["a", "b", "estimate"])

    of = lambda side: sigs.select(F.col("rep").alias(side), F.col("sig").alias(f"{side}_sig"))
    joined = spread_join(pairs.join(of("b"), "b"), of("a"), ["a"], "b").select("a", "b", "a_sig", "b_sig")
    return joined.mapInArrow(released(run), "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union.

    Whole texts of the documents concerned meet their pairs; sets are formed in the last step, for
    a bounded stretch of pairs at a time.
    """
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialise(docs.join(ends, "doc_id", "left_semi"), "pair-texts")
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text"))
    joined = spread_join(pairs.select("a", "b").join(of("b"), "b"), of("a"), ["a"], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [G.utf8(batch.column(k)) for k in (2, 3)]
            for i, j in G.slices(sides[0][1] + sides[1][1]):
                n = j - i
                data = np.concatenate([d[at[i] : at[j]] for d, at in sides])
                half = sides[0][1][j] - sides[0][1][i]
                both_at = np.concatenate([sides[0][1][i : j + 1] - sides[0][1][i], half + sides[1][1][i + 1 : j + 1] - sides[1][1][i]])
                value, at = shingles(data, both_at, exact=True)
                l_size, r_size = np.diff(at)[:n], np.diff(at)[n:]
                row = np.concatenate((np.repeat(np.arange(n), l_size), np.repeat(np.arange(n), r_size)))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
                both = np.bincount(row[same], minlength=n)
                good = (both > 0) & (100 * both >= percent * (l_size + r_size - both))
                keep = pa.array(i + np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return joined.select("a", "b", "a_text", "b_text").mapInArrow(released(run), "a long, b long")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends still lie in different components."""
    to = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    joined = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left")
    return joined.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).drop("a_root", "b_root")


def _shared_shingles(docs: DataFrame, members: DataFrame) -> DataFrame:
    """For each document of ``members`` (rep, least, most: sizes of its sets): least, and how many
    of its shingles another member has (never too few)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = G.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in G.slices(offsets):
                values, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array(G.signed(values)), pa.array(np.repeat(ids[i:j], np.diff(at)))], names=["shingle", "doc"])

    texts = docs.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    owners = texts.mapInArrow(released(run), "shingle long, doc long").groupBy("shingle").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    alone = owners.where("lo = hi").groupBy(F.col("lo").alias("rep")).agg(F.count("*").alias("alone"))
    return members.join(alone, "rep", "left").select("rep", F.col("least").alias("size"), (F.col("most") - F.coalesce("alone", F.lit(0))).alias("common"))


def _across(buckets: DataFrame, reps: DataFrame, docs: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links across components among the members of buckets that still hold several of them.

    Buckets that share members form families; a family is cut in blocks of bounded size, and each
    pair of blocks is compared on full sets in one task, which returns no more links than it needs
    to join what belongs together.
    """
    placed = materialise(
        buckets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "bucket", "rep", F.coalesce("root", "rep").alias("root")), "placed"
    )
    several = lambda rows: rows.groupBy("band", "bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("rep").alias("first")).where("lo < hi").select("band", "bucket", "first")
    rows = materialise(placed.join(several(placed).drop("first"), ["band", "bucket"]), "mixed-rows")
    sizes = reps.groupBy("rep").agg(F.min("n_shingles").alias("least"), F.sum("n_shingles").alias("most"))
    members = materialise(sizes.join(rows.select("rep").distinct(), "rep"), "members")
    able = materialise(_shared_shingles(docs, members).where(F.col("common") * 100 >= F.col("size") * percent).select("rep"), "able")
    rows = materialise(rows.join(able, "rep"), "able-rows")
    mixed = rows.join(several(rows), ["band", "bucket"]).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    family = merge(mixed.distinct())
    heads = family.select(F.col("root").alias("rep")).distinct().select("rep", F.col("rep").alias("family"))
    inside = heads.unionByName(family.select(F.col("node").alias("rep"), F.col("root").alias("family")))
    inside = materialise(inside.join(sizes, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "family", "most", F.coalesce("root", "rep").alias("root")), "families")
    # the largest component has blocks of its own, which needn't meet one another
    counts = inside.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("most").alias("m"))
    of_family = counts.groupBy("family").agg(F.max_by(F.struct("root", "n", "m"), F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    blocks = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_SHINGLES)).cast("int")
    of_family = of_family.where(F.col("n") > F.col("main.n")).select(
        "family", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.m")).alias("ahead"), blocks(F.col("n") - F.col("main.n"), F.col("m") - F.col("main.m")).alias("behind")
    )
    is_main, pick = F.col("root") == F.col("main"), F.xxhash64("rep")
    own = F.when(is_main, F.pmod(pick, F.col("ahead").cast("long"))).otherwise(F.col("ahead") + F.pmod(pick, F.col("behind").cast("long"))).cast("int")
    inside = materialise(inside.join(of_family, "family").select("rep", "family", "root", own.alias("own"), F.when(is_main, F.col("ahead")).otherwise(0).alias("from"), (F.col("ahead") + F.col("behind")).alias("blocks")), "blocks")
    texts = materialise(docs.select(F.col("doc_id").alias("rep"), "text").join(inside, "rep"), "family-texts")
    # any other two blocks meet once, and a block meets itself: rows go to (own, j) and (j, own)
    rows = texts.withColumn("other", F.explode(F.sequence(F.col("from"), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "root", "text")
    return rows.groupBy("family", "x", "y").applyInArrow(lambda key, table: _links(key, table, percent), "a long, b long")


def _links(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between rows of block x and rows of block y, from their texts."""
    own, rep, root = (table.column(c).to_numpy() for c in ("own", "rep", "root"))
    values, at = shingles(*G.utf8(table.column("text")), exact=True)
    return _forest(own, rep, root, values, np.diff(at), key[1].as_py(), key[2].as_py(), percent)


def _forest(own: np.ndarray, rep: np.ndarray, root: np.ndarray, values: np.ndarray, size: np.ndarray, x: int, y: int, percent: int) -> pa.Table:
    """Links between rows of block x and of block y that join components, as a forest over them.

    Intersections come from products of 0/1 matrices over the shingles that several rows have,
    some columns at a time; sums stay below 2**24, so single precision is exact.
    """
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    row = np.repeat(np.arange(len(own)), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    take = shared[column]
    row, column = row[take], (np.cumsum(shared) - 1)[column[take]]
    both = np.zeros((len(left), len(right)), np.float32)
    n_columns = int(shared.sum())
    bound = np.searchsorted(column, np.arange(0, n_columns + COLUMNS, COLUMNS))
    for k in range(len(bound) - 1):
        part = slice(bound[k], bound[k + 1])
        has = np.zeros((len(own), min(COLUMNS, n_columns - k * COLUMNS)), np.float32)
        has[row[part], column[part] - k * COLUMNS] = 1
        both += has[left] @ has[right].T
    linked = (both > 0) & (100.0 * both >= percent * (size[left][:, None] + size[right][None, :] - both.astype(np.float64)))
    linked &= root[left][:, None] != root[right][None, :]
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while r in above:
            above[r] = above.get(above[r], above[r])
            r = above[r]
        return r

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(int(root[left[i]])), top(int(root[right[j]]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((int(rep[left[i]]), int(rep[right[j]])))
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets of 5-word
    shingles; ``component_id`` is the smallest doc_id reachable.  A null or wordless text has an
    empty set and is its own component.  Rows that repeat a doc_id repeat its component; where
    their texts differ, each text links for that id.  A null doc_id takes no part: its
    component is null and it is kept.  Other columns are ignored.  ``percent`` below 80 would need
    more bands and is refused.
    """
    if percent < 80:
        raise ValueError("percent below 80 isn't served by these bands")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with scratch(docs.sparkSession) as keep:
        return keep(materialise(_classes(docs, percent), "near-duplicates"))


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    sketches = materialise(sketch(docs), "sketch")
    usable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(usable.groupBy("words_a", "words_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    same = usable.select("words_a", "words_b", F.col("doc_id").alias("b")).join(classes.where("n > 1"), ["words_a", "words_b"]).select(F.col("rep").alias("a"), "b")
    # several texts under one id: each has a row of its own here
    reps = materialise(usable.join(classes.select("words_a", "words_b", F.col("rep").alias("doc_id")), ["doc_id", "words_a", "words_b"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig"), "reps")
    roots = merge(same)

    named = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    least = materialise(named.groupBy("band", "bucket").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"), "buckets")
    keys = ["band", "bucket"]
    shared = materialise(spread_join(named, least.drop("n"), keys, "rep", least.drop("a")).select(*keys, "rep", "a"), "shared")
    star = shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    sigs = reps.select("rep", "sig")
    pairs = materialise(_estimated(star, sigs, percent).groupBy("a", "b").agg(F.max("estimate").alias("estimate")), "pairs")
    best = pairs.groupBy("b").agg(F.max_by("a", "estimate").alias("a"))
    roots = merge(_confirmed(materialise(best.select("a", "b"), "best"), docs, percent), roots)
    rest = materialise(_rooted(pairs.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti"), roots), "rest")
    roots = merge(_confirmed(rest, docs, percent), roots)
    roots = merge(_across(shared.select("band", "bucket", "rep"), reps, docs, roots, percent), roots)

    out = sketches.select("doc_id", "n_shingles").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
