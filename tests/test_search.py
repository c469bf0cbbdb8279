import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.api import staged_reranker
from sextant.functions import text as T
from sextant.functions import vectors as V
from sextant.operators import search
from sextant.operators.index import SearchIndex
from sextant.operators.search import SearchFilter
from sextant.sources.store import SnapshotStore


def ids(df):
    return [r["id"] for r in df.collect()]


def test_keyword_search_finds_a_document(make_chunks):
    rows = make_chunks({"id": "id1", "text": "document one", "domain": "KNOWLEDGE"}, {"id": "id2", "text": None}, {"id": "id3", "text": ""})
    assert ids(search.bm25(rows, "document", 10)) == ["id1"]
    assert search.bm25(rows, "", 10).count() == 0
    assert search.bm25(rows, "!!!", 10).count() == 0
    assert search.bm25(rows.limit(0), "document", 10).count() == 0


def test_scores_follow_the_formula_and_ties_the_sequence(make_chunks):
    rows = make_chunks({"id": "a", "text": "x y"}, {"id": "b", "text": "x y"}, {"id": "c", "text": "z z z z"})
    got = search.bm25(rows, "x", 10).select("id", "score").collect()
    average, idf = 8 / 3, math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    want = idf * 1 / (1 + 1.2 * (0.25 + 0.75 * 2 / average))
    assert [r["id"] for r in got] == ["a", "b"]
    assert got[0]["score"] == pytest.approx(want)


def test_filters_do_not_change_the_statistics(make_chunks):
    rows = make_chunks({"id": "a", "text": "x y", "repo": "one"}, {"id": "b", "text": "x", "repo": "two"})
    everywhere = {r["id"]: r["score"] for r in search.bm25(rows, "x", 10).collect()}
    only = search.bm25(rows, "x", 10, SearchFilter(repo="one")).collect()
    assert [r["id"] for r in only] == ["a"]
    assert only[0]["score"] == pytest.approx(everywhere["a"])


def test_capital_operators_are_plain_terms(make_chunks):
    rows = make_chunks({"id": "a", "text": "this and that"}, {"id": "b", "text": "neither"})
    assert ids(search.bm25(rows, "AND", 5)) == ["a"]


@pytest.fixture
def indexed(spark, tmp_path):
    return lambda rows, **given: SearchIndex.build(rows, SnapshotStore(spark, f"file://{tmp_path}/s"), **{"mode": "simple"} | given)


def test_index_gives_the_scores_of_the_texts(make_chunks, indexed):
    texts = [" ".join(["x"] * (i % 3) + ["y"] * (i % 5) + ["z"]) for i in range(20)] + [None, "", "..."]
    rows = make_chunks(*[{"id": f"d{i}", "text": t, "repo": "ab"[i % 2]} for i, t in enumerate(texts)])
    index = indexed(rows, dim=16)

    def scores(df):
        return [(r["seq"], round(r["score"], 9)) for r in df.select("seq", "score").collect()]

    for where in (SearchFilter(), SearchFilter(repo="a"), SearchFilter(repo="none")):
        for query in ("x y x", "z", "unknown", "", None):
            assert scores(index.lexical(query, 30, where)) == scores(search.bm25(rows, query, 30, where))
            assert scores(index.semantic(query, 30, where)) == scores(search.knn_hashed(rows, query, 30, where, 16))
        both = [(r["seq"], r["rank"], round(r["rrf_score"], 12), r["text"]) for r in index.hybrid("x y", 10, where, 15).collect()]
        assert both == [(r["seq"], r["rank"], round(r["rrf_score"], 12), r["text"]) for r in search.hybrid(rows, "x y", 10, where, 15, 16).orderBy("rank").collect()]
    assert ids(index.bm25("x", 3)) == ids(search.bm25(rows, "x", 3))
    again = SearchIndex.open(rows, SnapshotStore(index.spark, index.postings.inputFiles()[0].split("/search_postings")[0]))
    assert again.documents == 23 and scores(again.lexical("y", 5)) == scores(index.lexical("y", 5))
    plan = index.postings.filter("term = 'x'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,x)" in plan


def test_index_of_an_empty_table_and_of_dotted_names(make_chunks, indexed):
    empty = indexed(make_chunks({"id": "a"}).limit(0))
    assert empty.lexical("x").count() == empty.semantic("x").count() == empty.hybrid("x").count() == 0
    index = indexed(make_chunks({"id": "a", "text": "com.shop.Foo costs 1,234.5"}, {"id": "b", "text": "foo"}), mode="standard")
    assert ids(index.bm25("com.shop.foo")) == ["a"] and ids(index.bm25("Foo")) == ["b"] and ids(index.bm25("1,234.5")) == ["a"]
    assert ids(index.hybrid_rerank("foo", 1, reranker=search.lexical_overlap)) == ["b"]
    with pytest.raises(ValueError):
        index.hybrid("foo", -1)


def test_reranked_texts_and_staged_models(spark, make_chunks, tmp_path):
    rows = make_chunks({"text": "one two"}, {"text": None}, {"text": "two"}, {"text": "one"})
    assert [r["seq"] for r in search.rerank_texts(rows, "one two", search.lexical_overlap, 3).collect()] == [1, 3, 4]
    fit = rows.select("seq", T.fits(F.col("text"), 1).alias("fits")).orderBy("seq").collect()
    assert [r["fits"] for r in fit] == [False, True, True, True]
    vector = rows.filter("seq = 1").select(V.embedder(str(tmp_path), 8)(F.col("text")).alias("v")).first()["v"]  # nothing is staged
    assert vector == pytest.approx(V.embed_text("one two", 8))
    assert V.pooled(np.array([[3.0, 0.0], [5.0, 8.0], [9.0, 9.0]]), np.array([1, 1, 0])) == pytest.approx([0.70710678, 0.70710678])
    assert staged_reranker(str(tmp_path)) is None


def test_vector_search_leaves_out_unusable_vectors(make_chunks):
    rows = make_chunks({"id": "a", "vector": [1.0, 0.0]}, {"id": "b", "vector": [0.0, 2.0]}, {"id": "zero", "vector": [0.0, 0.0]}, {"id": "none"}, {"id": "long", "vector": [1.0, 0.0, 0.0]})
    got = search.knn(rows, [3.0, 0.0], 10).select("id", "score").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 1.0), ("b", 0.5)]
    with pytest.raises(ValueError):
        search.knn(rows, [1.0, 0.0], -1)
    assert search.knn(rows, [1.0, 0.0], 0).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcxyz0189 -_ä", max_size=40), min_size=1, max_size=6), st.text("abcxyz ", min_size=1, max_size=12))
def test_hashed_cosine_equals_the_embedded_one(spark, texts, query):
    q = V.embed_text(query, 32)
    if not any(q):
        return
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = {r["n"]: r["c"] for r in rows.select("n", V.hashed_cosine(F.col("text"), q).alias("c")).collect()}
    for n, t in enumerate(texts):
        v = V.embed_text(t, 32)
        assert got[n] is None if not any(v) else got[n] == pytest.approx(sum(a * b for a, b in zip(v, q)))


def test_fusion_orders_by_ranks_and_keeps_leg_scores(make_chunks):
    rows = make_chunks({"id": "A"}, {"id": "B"}, {"id": "C"})
    lexical = rows.filter("id in ('A', 'B')").withColumn("score", F.when(F.col("id") == "A", 9.0).otherwise(8.0))
    semantic = rows.filter("id in ('B', 'C')").withColumn("score", F.when(F.col("id") == "B", 0.9).otherwise(0.8))
    got = search.fuse(lexical, semantic, 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["B", "A", "C"]
    assert got[0]["score"] == 8.0
    assert got[0]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)


def test_hybrid_prefers_the_matching_text(make_chunks):
    rows = make_chunks({"id": "kafka", "text": "kafka stream processing"}, {"id": "maven", "text": "maven build tool"})
    assert ids(search.hybrid(rows, "kafka stream", 5, dim=32).orderBy("rank"))[0] == "kafka"


def test_reranking_only_orders(make_chunks):
    rows = make_chunks({"id": "a", "text": "kafka kafka kafka"}, {"id": "b", "text": "kafka stream and more words here"})
    plain = search.hybrid_rerank(rows, "kafka stream", 2).orderBy("rank")
    ranked = search.hybrid_rerank(rows, "kafka stream", 2, reranker=search.lexical_overlap).orderBy("rank")
    assert set(ids(plain)) == {"a", "b"}
    assert ids(ranked) == ["b", "a"]
    assert {r["id"]: r["score"] for r in plain.collect()} == {r["id"]: r["score"] for r in ranked.collect()}


def test_symbol_lookups(make_chunks):
    rows = make_chunks(
        {"id": "c1", "fqn": "com.shop.PaymentService", "symbols": ["@Service"]},
        {"id": "m1", "fqn": "com.shop.PaymentService#settle(String)", "type": "METHOD", "text": "line one\n" + "x" * 20},
        {"id": "op1", "fqn": "POST /api/orders", "type": "OPENAPI_OP", "domain": "KNOWLEDGE"},
        {"id": "k1", "domain": "KNOWLEDGE", "type": "MD_SECTION", "title": "Readme"},
    )
    assert ids(search.by_name_fragment(rows, "payments")) == ["c1"]
    assert ids(search.by_name_fragment(rows, "PAYMENT")) == ["c1"]
    assert ids(search.by_name_fragment(rows, "settle", "METHOD")) == ["m1"]
    assert ids(search.by_name_fragment(rows, "settle", "CLASS")) == []
    assert ids(search.by_name_fragment(rows, "orders")) == ["op1"]
    assert ids(search.by_name_fragment(rows, "se?tle")) == ["m1"]
    assert ids(search.by_name_fragment(rows, "com.shop.PaymentService")) == ["c1"]
    assert search.text_by_fqn(rows, "nothing").count() == 0
    assert ids(search.by_type(rows, "OPENAPI_OP", "repo")) == ["op1"]
    assert ids(rows.filter(SearchFilter(symbol="@Service").condition())) == ["c1"]
    assert search.title_by_id(rows, "k1").first()[0] == "Readme"
    assert search.symbol_refs(rows).count() == 3
    assert search.symbol_body(rows, "com.shop.PaymentService#settle(String)", 15).first()["body"] == "line one\n// ... (truncated)"


def test_text_functions(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    long_text = "start " + "longword " * 70 + "end"
    cut = value(T.snippet(F.lit(long_text)))
    assert cut.endswith("longword...") and len(cut) <= 503
    assert value(T.snippet(F.lit(None).cast("string"))) == ""
    assert value(T.snippet(F.lit("x" * 600))) == "x" * 500 + "..."
    assert value(T.snippet(F.lit(" " + "x" * 600))) == " " + "x" * 499 + "..."
    assert value(T.content_hash(F.lit("hello"))) == "2cf24dba5fb0a30e"
    assert [value(T.token_estimate(F.lit(t))) for t in ("", "1234", "12345")] == [0, 1, 2]
    assert len(value(T.truncate_to_fit(F.lit("word1 word2 word3"), 3))) <= 12
    assert value(T.fqn_simple(F.lit("a.B#m(java.lang.String)"))) == "string)"
    assert value(T.simple_name(F.lit("com.shop.Foo#doIt()"))) == "doIt"
    assert [value(T.slug(F.lit(t))) for t in ("Big Section!", " ", "--A--")] == ["big-section", "body", "a"]
    assert value(T.tokens(F.lit("com.shop.Foo costs 1,234.5 don't"), "standard")) == ["com.shop.foo", "costs", "1,234.5", "don't"]
    assert value(T.strip_annotation_value(F.lit('{"/a"}'))) == "/a"
    assert [value(T.looks_like_bean(F.lit(t))) for t in ("PaymentService", "String", "int", "java.util.List<Foo>", "a.b.Store<X>")] == [True, False, False, False, True]


def test_globs_need_a_folder_where_they_say_so(spark):
    rows = spark.createDataFrame([("src/main/Foo.java",), ("target/classes/Foo.java",), ("Foo.java",), ("src\\a\\B.java",), ("x/README.md",)], "path string")
    kept = rows.filter(T.accepted(F.col("path"), ("**/*.java",), ("**/target/**", "target/**")))
    assert [r[0] for r in kept.collect()] == ["src/main/Foo.java", "src\\a\\B.java"]
    assert rows.filter(T.accepted(F.col("path"), (), ())).count() == 5
