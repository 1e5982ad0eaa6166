"""All ten queries and the pipeline on small tables with nulls, repeats and columns of other names."""

import pytest

from stratakeep.llm import queries as Q

TOXIC = "you worthless scum idiot loser vermin"


def _tables(spark, folder, full=True):
    rnd = [f"w{i % 37}x{i % 11}" for i in range(400)]
    line = lambda i: " ".join(rnd[i : i + 45])
    docs = [(i, line(i) + (f" {TOXIC}" if i % 5 == 0 else ""), ("en", "de")[i % 2], "s", 1) for i in range(60)]
    docs += [(60, None, None, None, None), (61, "", "en", "s", 0), (62, line(3), "de", "s", 1), (62, line(3), "de", "s", 1), (None, f"{TOXIC} {TOXIC} {line(9)}", "en", "s", 1), (None, None, None, None, None), (63, "one", "en", "s", 3)]
    docs = docs if full else []
    spark.createDataFrame([(*d, i, 0) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, id int, rep int").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (999, 1, 1)]
    spark.createDataFrame(labels if full else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)], 1) for i in range(120)] + [(None, [1.0, 0.0, 0.0], 1), (200, None, 1), (201, [0.0, 0.0, 0.0], 1), (50, [1.0, 2.0, 3.0], 1)]
    spark.createDataFrame(vectors if full else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, f"http://x/{i}", f"<html><body><article><h1>Head</h1><p>{line(i)}.</p></article></body></html>") for i in range(10)]
    pages += [(None, None, None), (3, "http://x/3", None), (11, "http://x/11", ""), (12, "http://x/12", pages[0][2])]
    spark.createDataFrame(pages if full else [], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return {"documents": len(docs), "pages": len(pages) if full else 0}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    return folder, _tables(spark, folder)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_nulls_repeats_and_other_columns(spark, small, name):
    folder, sizes = small
    rows = Q.queries()[name](spark, folder).collect()
    if name.startswith("op1_"):
        assert {r.query_id for r in rows} == {0, 50, 100} and all(1 <= r["rank"] <= 5 for r in rows)
        return
    assert len(rows) == sizes["pages" if name.split("_")[0] in ("op3", "op8") else "documents"]
    if name.startswith("op7_"):  # two of the four languages have labelled documents
        assert all(r.p_fr is None and r.p_es is None and abs(r.p_en + r.p_de - 1) < 1e-9 for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, tmp_path, name):
    _tables(spark, str(tmp_path), full=False)
    assert Q.queries()[name](spark, str(tmp_path)).collect() == []


def test_pipeline_rejects_toxic_rows_without_an_id(spark, small):
    import corpus_pipeline as P

    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.reject_toxic(spark, docs, folder)
    assert kept.columns == P.COLUMNS
    rows = kept.collect()
    assert not any(TOXIC in (r.text or "") for r in rows)
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 62 for r in rows) == 2
