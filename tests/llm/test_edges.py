"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with names the operators use."""

import pytest

import corpus_pipeline
from pgq.llm import registry

LONG = "lorem ipsum dolor sit amet " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, kept_text string, toxicity_score double, row int, copy int, key double, size string, fp long, n int, `a.b` string"
ROWS = [(0, "one two three four five six seven", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "de", "b"), (4, LONG, "fr", "b"), (5, "é ü 漢字 \U0001f600 &amp; <b>", None, "c"), (5, "é ü 漢字 \U0001f600 &amp; <b>", None, "c"), (None, "no id here at all", "en", "a"), (None, None, None, None), (9, "x", "en", None), (100, "you stupid idiot!", "en", "a"), (101, "One two three four five six seven", "en", "d")]
OWN = (7, "k", 1.0, 2, 3, 4.0, "s", 8, 9, "d")
NAMES = list(registry.QUERIES)


def write(spark, path, rows):
    spark.createDataFrame([(*r, len(r[1] or ""), *OWN) for r in rows], DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    more = bool(rows)
    spark.createDataFrame([(0, 1, 0, "x"), (100, 0, 1, "x"), (100, 0, 1, "y"), (5, None, None, None), (None, 1, 1, "z"), (77, 1, 1, "z")] if more else [], "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (40, [0.0, 1.0]), (2, None), (3, []), (60, [0.0, 0.0]), (80, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [2.0])] if more else [], "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "'q' as query", "0 as bucket").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(0, "u", "<p>Hello, world. Text &amp; more.</p>"), (1, None, None), (2, "v", ""), (None, "w", "<div><p>No id"), (2, "v", ""), (3, "x", "<div>" * 3000 + "deep"), (4, "y", "a < b &lt; c")] if more else [], "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_chars").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("odd")), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), [])


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    got = registry.QUERIES[name](spark, odd).collect()
    if name == "op3_cross_polytope":
        assert [(r.query_id, r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(0, 6, 2.0), (0, 1, 1.0), (0, 20, 1.0), (0, 40, 0.0), (20, 6, 2.0), (20, 0, 1.0), (20, 1, 1.0), (20, 40, 0.0), (40, 0, 0.0), (40, 1, 0.0), (40, 6, 0.0), (40, 20, 0.0)]
    elif name == "op5_html_main_text":
        assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (1, 2)] == [""] * 3
    elif name == "op9_packing":
        assert {r.doc_id for r in got} == {r[0] for r in ROWS} and sum(r.piece == 0 for r in got) == len(ROWS)
    else:
        assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted((-1 if r[0] is None else r[0]) for r in ROWS)
    if name in ("op4_toxicity", "op6_quality"):
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    for path in (odd, empty):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        out = stage(spark, docs, path)
        rows = out.collect()
        if name != "pack":
            assert out.dtypes == docs.dtypes
            assert all(tuple(r)[5:] == OWN for r in rows)
        assert bool(rows) == (path == odd)


def test_stage_results_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    near = [r.doc_id for r in stage["near_dedup"](spark, docs, odd).collect()]
    assert sorted((-1 if i is None else i) for i in near) == [-1, -1, 0, 1, 4, 5, 9, 100]  # 2 and 3 go with 1, 101 with 0, a repeat of 5
    cut = {r.doc_id: r.text for r in stage["suffix_dedup"](spark, docs, odd).where("doc_id is not null").collect()}
    assert cut[4] == LONG and cut[1] == "" and cut[0] == ROWS[0][1]
    assert sorted(r.doc_id for r in stage["mix"](spark, docs, odd).where("doc_id in (2, 3)").collect()) == [2, 3]
