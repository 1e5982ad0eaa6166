import hashlib
import random

import pytest

from stratakeep.llm import bytespans


def brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(part)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rnd = random.Random(seed)
    line = lambda n: "".join(rnd.choice("abcdefghé ") for _ in range(n))
    shared = [line(rnd.randrange(90, 400)) for _ in range(5)]
    out = []
    for _ in range(50):
        out.append("".join(rnd.choice(shared)[rnd.randrange(40) :] if rnd.random() < 0.6 else line(rnd.randrange(1, 300)) for _ in range(rnd.randrange(1, 6))))
    base = line(1500)
    for _ in range(8):  # copies with small changes
        now = list(base)
        for _ in range(rnd.randrange(0, 8)):
            now[rnd.randrange(len(now))] = "X"
        out.append("".join(now))
    out += [base, base, "ab" * 400, "z" * 350, "z" * 101, "z" * 100, "z" * 99, "", None, shared[0][:100], shared[0][:99]]
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = texts(seed)
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, at int, n int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bytespans.remove(frame).collect()}
    assert got == brute(rows, 100)


def test_edges(spark):
    frame = spark.createDataFrame([(1, "q" * 120), (1, "q" * 120), (None, "q" * 120), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in bytespans.remove(frame).collect())
    assert got == [(0, 0), (1, 119), (1, 119), (2, 0)]
    assert bytespans.remove(frame.limit(0)).count() == 0


@pytest.mark.parametrize("length", [30, 100])
def test_both_methods_find_the_same(spark, length):
    rows = [r for r in texts(7) if r[1] is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    both = [{r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in bytespans.remove(frame, length, method=m).collect()} for m in ("anchors", "difference cover")]
    assert both[0] == both[1]
    assert {d: x[1:] for d, x in brute(rows, length).items()} == both[0]
