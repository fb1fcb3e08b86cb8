"""Ids that stand beside nulls, repeat, or are texts come back as they went in."""

import json

import pytest

from mechpairs.llm import embed_dedup, mil_quality, packing, toxicity, url_filter

BIG = [2**60 + 1, 2**60 + 3, None, 5, 5, -(2**60) - 1]
TEXT = "you are a fool and nobody likes it. " * 9


def documents(spark, ids, kind):
    rows = [(i, TEXT + str(k) if k % 5 else None, 0.5, "x") for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, toxic_score double, quality_score string").coalesce(1)


def labels(spark, kind):
    ids = [3, 4, 6, 7, 5, 2**60 + 1] if kind == "long" else ["a", "b", "c", "d"]
    return spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(ids)] + [(None, 1, 1)], f"doc_id {kind}, quality int, toxic int")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_documents(spark, kind):
    ids = BIG if kind == "long" else ["a", "b", None, "c", "c", "ü"]
    docs = documents(spark, ids, kind)
    want = sorted(map(str, ids))
    for run, column in ((toxicity, "toxic_score"), (mil_quality, "quality_score")):
        got = run.score(docs, run.fit(docs, labels(spark, kind)))
        assert sorted(str(r.doc_id) for r in got.collect()) == want and dict(got.dtypes)[column] == "double"
    assert {str(r.doc_id) for r in packing.pack(docs).collect()} == set(want)
    pages = docs.selectExpr("doc_id AS page_id", "text AS url")
    assert sorted(str(r.page_id) for r in url_filter.judge(pages).collect()) == want


def test_vectors(spark):
    e = [1.0, 2.0, 3.0, 4.0]
    rows = [(2**60 + 1, e, 1), (2**60 + 3, [1.0, 2.0, 3.0, 4.01], 1), (None, e, 1), (None, None, 1), (7, [-4.0, 3.0, -2.0, 1.0], 1), (2**60 + 5, e, None)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)).collect()}
    a, b, c = 2**60 + 1, 2**60 + 3, 2**60 + 5
    assert got == {(a, 1, a, True), (b, 1, a, False), (None, 0, None, True), (7, 0, 7, True), (c, 0, c, True)}


def test_models_learn_from_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(4, f"text {k} of many words", 1) for k in range(50)] + [(3, "other words here", 1)], "doc_id long, text string, y int")
    first, again = (mil_quality.fit(docs.repartition(n), labels(spark, "long")) for n in (1, 4))
    scores = [[round(r.quality_score, 9) for r in mil_quality.score(docs, m).orderBy("doc_id", "text").collect()] for m in (first, again)]
    assert scores[0] == scores[1]


def test_another_split_pattern_is_refused(tmp_path):
    spec = json.load(open(packing.default_tokenizer_path(), encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        packing.ByteBpe(str(path))
