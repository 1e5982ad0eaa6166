import random

import pytest

from stratakeep.llm import suffixarray as S


def brute(rows, length):
    seen, out = set(), set()
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                out.add((d, i))
            seen.add(b[i : i + length])
    return out


@pytest.mark.parametrize("length", [12, 20, 41, 100, 131])
def test_against_brute_force(spark, length):
    rnd = random.Random(length)
    shared = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(10, 200))) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "a" * 350), (3, "ab" * 90), (4, "x" * (length - 1)), (5, "x" * length), (6, "x" * length)]
    for i in range(7, 40):
        rows.append((i, "".join(rnd.choice(shared) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh ü") for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(1, 5)))))
    got = S.repeated(spark.createDataFrame(rows, "doc long, text string"), length).collect()
    assert {(r.doc, r.at) for r in got} == brute(rows, length) and len(got) == len({(r.doc, r.at) for r in got})


def test_nothing_repeats(spark):
    rows = [(i, f"{i:05d}" * 3 + "-" + str(i * 7919)) for i in range(5)]
    assert S.repeated(spark.createDataFrame(rows, "doc long, text string"), 30).count() == 0
    assert S.repeated(spark.createDataFrame([], "doc long, text string"), 30).count() == 0
