import re

import pytest

import corpus_pipeline as P
from stratakeep.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs
        docs = P.materialise(stage(spark, docs, SF), f"test-{name}")
        out[name] = (before, docs)
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name][1].columns == P.COLUMNS


def test_toxicity_takes_what_it_scores(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(before.select("doc_id", "text"), labels, f"NOT ({P.HELD_OUT})").collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored if r.score < P.THRESHOLD}


def test_near_duplicates_against_brute_force(stages):
    from .test_repeats import brute_near

    before, after = stages["near_duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    want = {d for d, (_, _, kept) in brute_near(sorted(texts.items()), P.NEAR_PERCENT).items() if kept}
    assert set(rows(after)) == want


def test_passages_against_brute_force(stages):
    from .test_repeats import brute_words

    before, after = stages["substrings"]
    texts, got = {r.doc_id: r.text for r in before.collect()}, rows(after)
    for d, (n, gone, _) in brute_words(sorted(texts.items()), 35).items():
        if not gone:
            assert got[d].text == texts[d]
        else:
            assert len(re.findall(rb"[^\x20\x09-\x0D]+", got[d].text.encode())) == n - gone and got[d].n_chars == len(got[d].text)
    assert set(got) == set(texts)


def test_mixing_keeps_every_document(stages):
    before, after = stages["mixing"]
    assert {(r.doc_id, r.text) for r in before.collect()} == {(r.doc_id, r.text) for r in after.collect()}
    assert after.count() >= before.count()


def test_encoding_against_the_library(stages):
    import sentencepiece

    before, after = stages["sentencepiece"]
    model = sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    got = rows(after)
    for d, r in rows(before).items():
        assert got[d].ids == model.encode(r.text or "") and got[d].n_tokens == len(got[d].ids)


def test_null_rows_pass(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, str(tmp_path)), f"null-{name}")
    assert {r.doc_id for r in docs.collect()} == {None, 1, 2}


def test_encoding_keeps_the_span_of_every_id(stages):
    from stratakeep.llm import sentencepiece

    before, after = stages["sentencepiece"]
    model, got = sentencepiece.Encoder(P.model_path()), rows(after)
    for d, r in rows(before).items():
        begin, end = model.spans(r.text or "", got[d].ids)
        assert (got[d].begin, got[d].end) == (list(begin), list(end))
