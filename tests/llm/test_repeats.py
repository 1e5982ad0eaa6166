import hashlib
import random
import re
from collections import Counter

import pytest

from stratakeep.llm import minhash, relative, substrings


def brute_words(rows, window):
    """Word windows that occur anywhere else, by counting all of them."""
    docs = dict(rows)
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in docs.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def texts(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "Ünï", "%%", "The", "the"]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [line(rnd.randrange(30, 80)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            parts.append(rnd.choice(shared) if rnd.random() < 0.5 else line(rnd.randrange(1, 60)))
        out.append(rnd.choice([" ", "\n", "\t "]).join(parts))
    out += [out[0]] * 7 + [out[3] + " tail", "x " * 90, "x " * 36, "", None, "   ", "one", "a b c d", "a b c d e", "A B c d e"]
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(relative, "STRETCHES", 256 if seed == 1 else 2)  # with 2, anchors are split
    rows = texts(seed)
    line = " ".join(f"h{i}" for i in range(33))  # a frequent line, always in other surroundings
    rows += [(1000 + i, f"p{i} q{i} {line} r{i} s{i} " + "c d " * (i % 3)) for i in range(40)]
    rows += [(2000 + i, f"{line} r{i} s{i}\n{line}\ttt{i}") for i in range(6)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_words(rows, 35)


def brute_near(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def near_texts(seed):
    rnd = random.Random(seed)
    out = [t for _, t in texts(seed, 30)]
    base = [[f"v{rnd.randrange(2000)}" for _ in range(150)] for _ in range(4)]
    for b in base:
        now = list(b)
        for _ in range(12):  # a chain that drifts: its ends aren't similar
            now = list(now)
            now[rnd.randrange(150)] = f"v{rnd.randrange(2000)}"
            out.append(" ".join(now))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, rep long, n int")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert substrings.remove(frame).count() == 5
    empty = frame.limit(0)
    assert minhash.near_duplicates(empty).count() == 0 and substrings.remove(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_dense_family_is_compared_block_by_block(spark, monkeypatch, percent):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rnd = random.Random(percent)
    base = [f"v{rnd.randrange(500)}" for _ in range(100)]
    out = []
    for _ in range(60):  # about at the threshold from one another
        now = list(base)
        for _ in range(rnd.randrange(0, 4)):
            now[rnd.randrange(100)] = f"x{rnd.randrange(3000)}"
        out.append(" ".join(now))
    rows = list(enumerate(out))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute_near(rows, percent)


def test_links_join_all_components_of_two_blocks():
    import numpy as np

    rnd = random.Random(5)
    sets = [sorted(set(range(100)) - {rnd.randrange(100) for _ in range(12)} | {1000 + 7 * i for _ in range(3)}) for i in range(40)]
    sets[5] = list(range(5000, 5020))
    own, each = np.arange(40) % 2, np.arange(40)
    values, size = np.concatenate([np.array(x) for x in sets]), np.array([len(x) for x in sets])
    for x, y in ((0, 0), (0, 1), (1, 1)):
        pairs = minhash._forest(own, each, each, values, size, x, y, 80).to_pylist()
        ok = [(a, b) for a in range(40) for b in range(40) if a % 2 == x and b % 2 == y and a != b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]

        def classes(edges):
            root = list(range(40))
            for _ in range(40):
                for a, b in edges:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        assert {(p["a"], p["b"]) for p in pairs} <= set(ok)
        assert classes([(p["a"], p["b"]) for p in pairs]) == classes(ok)
        assert len(pairs) < 40


def thue_morse(n):
    """Two words that sums of bytes times powers of an odd base modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_built_to_collide_stay_different(spark):
    from stratakeep.llm import bytespans

    from .test_bytespans import brute

    texts_ = [w for n in (64, 1024, 4096) for w in thue_morse(n)]
    line = [f"w{i}" for i in range(40)]
    texts_ += [" ".join([*line[:20], w, *line[20:]]) for w in thue_morse(1024)]
    texts_ += [" ".join(w) for w in thue_morse(1024)]  # words for letters
    rows = list(enumerate(texts_))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute_near(rows) and [got[i][1] for i in range(8)] == list(range(8))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(frame).collect()}
    assert got == brute_words(rows, 35) and got[6][1] == got[7][1] == 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bytespans.remove(frame).collect()}
    assert got == brute(rows, 100)


def test_fingerprints_and_names_follow_content():
    import numpy as np

    from stratakeep.llm import _grams as G

    rng = np.random.default_rng(0)
    data = np.tile(rng.integers(97, 100, 700, dtype=np.uint8), 2)
    for k in (1, 3, 7, 8, 12, 24, 63, 64, 100):
        found = {data[i : i + k].tobytes() for i in range(len(data) - k + 1)}
        prints = G.FIRST.byte_grams(data, k)
        assert len(prints) == len(data) - k + 1 and len(np.unique(prints)) == len(found) and (prints[: 701 - k] == prints[700 : 1401 - k]).all()
        for values in (G.SECOND.grams(data.astype(np.uint64), k), G.gram_names(data.astype(np.int64), k)):
            assert len(values) == len(prints) and len(np.unique(values)) == len(found)
    words = ["a", "b" * 8, "b" * 9, "c" * 63, "c" * 64, "c" * 65, "d" * 500, "ab", "a"]
    raw = " ".join(words + words).encode()
    w = G.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    for values in (w.fingerprints(), w.names()):
        assert len(np.unique(values)) == 8 and (values[:9] == values[9:]).all()
    start = np.array([0, 5, 700, 3, 703])
    end = np.array([130, 9, 830, 500, 1200])
    spans = G.FIRST.spans(G.FIRST.byte_grams(data, 4), 4, start, end)
    assert spans[0] == spans[2] and spans[3] == spans[4] and len(set(spans.tolist())) == 3


@pytest.mark.parametrize("seed", range(20))
def test_greedy_factors_of_a_reference_block(seed):
    rnd = random.Random(seed)
    words = [[rnd.choice("abc") for _ in range(rnd.randrange(0, 40))] for _ in range(rnd.randrange(1, 12))]
    block = relative.block_of([" ".join(w) for w in words])
    places = lambda run: [(k, i) for k, w in enumerate(words) for i in range(len(w) - len(run) + 1) if w[i : i + len(run)] == run]
    for k, w in enumerate(words):
        at = 0
        for f in block.factors(k):
            run = w[f.start : f.start + f.length]
            assert f.start == at and len(run) == f.length >= 1
            if f.stretch >= 0:  # it stands at its source, which is elsewhere
                assert (f.stretch, f.offset) in places(run) and (f.stretch, f.offset) != (k, f.start)
            else:
                assert f.length == 1 and len(places(run)) == 1
            longer = w[f.start : f.start + (f.length + 1 if f.stretch >= 0 else 1)]
            assert len(longer) == f.length and f.stretch >= 0 or len(places(longer)) == 1  # none longer stands elsewhere
            at += f.length
        assert at == len(w)
    for window in (3, 5, 8):
        want = {(k, i) for k, w in enumerate(words) for i in range(len(w) - window + 1) if len(places(w[i : i + window])) > 1}
        assert set(zip(*(x.tolist() for x in block.repeated(window)), strict=True)) == want


def test_factors_show_where_words_come_from():
    block = relative.block_of(["a b c d e x", "y a b c d e", "z q"])
    assert block.factors(0) == [relative.Factor(0, 5, 1, 1), relative.Factor(5, 1, -1, -1)]
    assert block.factors(1)[1:] == [relative.Factor(1, 5, 0, 0)] and block.factors(1)[0] == relative.Factor(0, 1, -1, -1)
    # greedy factors end inside "c d e f", which only the lookup across their boundary finds
    block = relative.block_of(["a b c d e f", "a b c d", "c d e f"])
    assert [f.length for f in block.factors(0)] == [4, 2]
    stretch, offset = block.repeated(4)
    assert (0, 2) in set(zip(stretch.tolist(), offset.tolist(), strict=True))
