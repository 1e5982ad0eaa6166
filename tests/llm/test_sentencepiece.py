import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from stratakeep.llm import sentencepiece as S
from stratakeep.llm.q_op2 import digests, model_path, op2_sentencepiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


TEXTS = ["", " ", "  ", "a", " a", "a ", "Hello world", "  two  spaces   here ", "tab\there\nline\r\n\x0b\x0c", "naïve café Ünï", "日本語 テキスト", "emoji 😀👩‍👩‍👧", "▁already ▁ ▁▁ x", "\x00\x01\x02", "ﬁ ½ Ａ", "x" * 3000, "a b " * 500, "</s> <s> <unk> <0x41>", " nbsp　wide", "é combining"]


def test_ids_are_the_librarys(library):
    rnd = random.Random(2)
    alphabet = "abcdeé  ▁日\n\t.,XYZ0123"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(300)]
    model = S.Encoder(model_path())
    for _ in range(2):  # the second time from the cache
        assert model.encode_ids(texts) == [library.encode(t) for t in texts]
    assert model.decode(model.encode_ids(texts)) == [library.decode(library.encode(t)) for t in texts]


def test_spans_lie_in_order_and_spell_the_text(library):
    model = S.Encoder(model_path())
    for text in TEXTS:
        raw = text.encode()
        ids = model.encode_ids([text])[0]
        begin, end = model.spans(text, ids)
        assert len(begin) == len(end) == len(ids)
        assert all(a <= b for a, b in zip(begin, end)) and begin == sorted(begin) and end == sorted(end)
        if ids:
            assert begin[0] == 0 and end[-1] == len(raw) and all(e == b for e, b in zip(end, begin[1:]))
        for k, (i, a, b) in enumerate(zip(ids, begin, end)):
            if model.kinds[i] == 6:
                assert b - a == 1 and model.pieces[i] == f"<0x{raw[a]:02X}>"
            else:  # the first piece begins with the prefix that is put before the text
                assert "▁" * (k == 0) + raw[a:b].decode().replace(" ", "▁") == model.pieces[i]


def charsmap(rules):
    """A compiled character map: a double-array trie over the keys, and the replacements."""
    pool, trie = b"", {}
    for key, value in sorted(rules.items()):
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[None] = len(pool)
        pool += value.encode() + b"\0"
    units, taken, bases = {}, {0}, set()

    def place(node, at):
        base = next(b for b in range(256, 1 << 16) if b not in bases and not any((b ^ (0 if k is None else k)) in taken for k in node))
        bases.add(base)
        units[at] = units.get(at, 0) | (at ^ base) << 10
        for k in node:
            taken.add(base ^ (0 if k is None else k))
        for k, below in node.items():
            if k is None:
                units[at] |= 1 << 8
                units[base] = 1 << 31 | below
            else:
                units[base ^ k] = k
        for k, below in node.items():
            if k is not None:
                place(below, base ^ k)

    place(trie, 0)
    size = max(units) + 1
    return struct.pack("<I", 4 * size) + b"".join(struct.pack("<I", units.get(i, 0xFF)) for i in range(size)) + pool


def test_longest_prefix_normalisation_keeps_the_alignment():
    rules = {"ﬁ": "fi", "½": "1/2", "á": "á", "a": "A", "　": " ", "\t": " ", "x": "", "ab": "[ab]", "abc": "[abc]"}
    spec = S.NormalizerSpec(charsmap(rules), add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    normalizer = S.Normalizer(spec, protected=("<p>",))

    def by_hand(text):
        """Pairs (output, source offset) by trying prefixes from the longest."""
        raw, at, out = text.encode(), 0, []
        while at < len(raw):
            for size in range(min(12, len(raw) - at), 0, -1):
                try:
                    key = raw[at : at + size].decode()
                except UnicodeDecodeError:
                    continue
                if key == "<p>" or key in rules or len(key) == 1:
                    out += [(c, at) for c in (key if key == "<p>" else rules.get(key, key))]
                    at += size
                    break
        # no space at the ends, one between
        kept = []
        for c, where in out:
            if c == " " and (not kept or kept[-1][0] == " "):
                continue
            kept.append((c, where))
        while kept and kept[-1][0] == " ":
            kept.pop()
        return kept

    for text in ["ﬁne", "áb ab abc abcd", "  x a\t\t½　", "a x b", "<p>ab<p>", "日ﬁ", "ab", ""]:
        out, align = normalizer.normalize(text.encode())
        want = by_hand(text)
        assert out.decode() == ("▁" + "".join(c for c, _ in want).replace(" ", "▁") if want else "")
        if want:
            flat = [where for c, where in want for _ in range(len(c.replace(" ", "▁").encode()))]
            assert align[3:-1] == flat and align[-1] <= len(text.encode())
    assert normalizer.map.longest("abcx".encode(), 0)[0] == 3 and normalizer.map.longest("zz".encode(), 0) == (0, -1)
    assert S.Normalizer(spec).normalize(b"a\xff")[0].decode() == "▁A�"


def test_frames(spark, library):
    rows = [(i, t, f"col{i}", i) for i, t in enumerate([*TEXTS, None, TEXTS[6]])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, t string, ids int")
    got = {r.doc_id: r for r in S.encode(frame, model_path(), outputs=("ids", "begin", "end", "decoded")).collect()}
    assert len(got) == len(rows)
    for i, t, name, _ in rows:
        ids = library.encode(t or "")
        assert got[i].ids == ids and got[i].t == name and len(got[i].begin) == len(got[i].end) == len(ids) and got[i].decoded == library.decode(ids)
    d = {r.doc_id: r for r in digests(S.encode(frame, model_path(), outputs=("ids", "decoded"), keep=["doc_id"])).collect()}
    for i, t, _, _ in rows:
        ids = library.encode(t or "")
        assert (d[i].n_tokens, d[i].ids_sha256, d[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    back = S.decode(S.encode(frame, model_path()).withColumn("ids", F.when(F.col("doc_id") > 1, F.col("ids"))), model_path())
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: library.decode(library.encode(t or "")) if i > 1 else "" for i, t, _, _ in rows}
    assert S.encode(frame.limit(0), model_path()).count() == 0


def test_spans_of_a_batch_are_those_of_each_text():
    rnd = random.Random(3)
    alphabet = "abcdeé  ▁日😀\t\n.,XYZ0123"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(300)]
    model = S.Encoder(model_path())
    ids = model.encode_ids(texts)
    begin, end = model.spans_of(texts, ids)
    assert list(zip(begin.to_pylist(), end.to_pylist(), strict=True)) == [tuple(map(list, model.spans(t, x))) for t, x in zip(texts, ids, strict=True)]
    assert [len(x) for x in model.spans_of([], [])] == [0, 0] and model.spans_of([""], [[]])[0].to_pylist() == [[]]


def test_the_query_gives_a_span_for_every_id(spark):
    sf = "/root/testdata/sf0.001"
    model = S.Encoder(model_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_sentencepiece(spark, sf).collect():
        (ids,) = model.encode_ids([texts[r.doc_id]])
        begin, end = model.spans(texts[r.doc_id], ids)
        assert (r.begin, r.end, r.n_tokens) == (list(begin), list(end), len(ids))
