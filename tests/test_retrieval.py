from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strataforge.operators import dense, evaluation, fusion, lexical, pipeline
from strataforge.plans import catalogue

CHUNK = "chunk_id string, content string, source_type string"
LIST = "query_id string, channel string, chunk_id string, score double, rank int"


def corpus(spark, data):
    return spark.createDataFrame([(i, t, "markdown") for i, t in data], CHUNK)


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, question string")


def found(index, queries, k=10):
    return [(r["chunk_id"], r["rank"]) for r in lexical.search(index, queries, k).orderBy("query_id", "rank").collect()]


def test_identifier_is_found_and_ties_go_to_the_smaller_id(spark):
    index = lexical.build_index(corpus(spark, [("b", "shared text"), ("a", "shared text"), ("c", "shared text"), ("auth", "calls refreshToken here")]))
    assert found(index, ask(spark, "refreshToken")) == [("auth", 1)]
    assert found(index, ask(spark, "shared"), 2) == [("a", 1), ("b", 2)]
    assert found(index, ask(spark, "nothing known")) == []
    assert found(index, ask(spark, "   ", None)) == []
    assert found(index, ask(spark, "shared"), 0) == []


def test_score_is_bm25_plus_over_distinct_tokens(spark):
    index = lexical.build_index(corpus(spark, [("x", "alpha alpha beta"), ("y", "gamma")]))
    score = lexical.scores(index, ask(spark, "alpha gamma")).where("chunk_id = 'x'").first()["score"]
    texts = {"x": {"alpha", "beta"}, "y": {"gamma"}}  # the source type is not indexed
    average = sum(map(len, texts.values())) / 2
    idf = math.log(3 / 1)
    expected = 2 * idf + idf * 2.5 / (1.5 * (0.25 + 0.75 * len(texts["x"]) / average) + 1)
    assert score == pytest.approx(expected, abs=1e-8)


def test_repeated_chunk_counts_once_and_empty_corpus_finds_nothing(spark):
    twice = corpus(spark, [("x", "alpha"), ("x", "alpha")])
    assert lexical.lengths(twice).count() == 1
    assert found(lexical.build_index(corpus(spark, []) if False else twice.where("false")), ask(spark, "alpha")) == []


def test_fusion_adds_all_occurrences(spark, rows):
    lists = spark.createDataFrame([("q", "a", "x", 1.0, 1), ("q", "b", "x", 9.0, 2), ("q", "a", "y", 0.5, 2), ("q", "a", "y", 0.5, 2), ("q", "a", "n", 0.1, None)], LIST)
    got = rows(fusion.fuse(lists), "chunk_id", "score", "rank")
    assert got == [("x", pytest.approx(1 / 61 + 1 / 62, abs=1e-9), 1), ("y", pytest.approx(2 / 62, abs=1e-9), 2)]
    assert fusion.fuse(lists, top_k=0).count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(lists, 0)


def test_dense_is_exact_and_leaves_out_what_cannot_be_compared(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("l", [1.0, 0.0, 0.0])], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [2.0, 0.1])], "query_id string, embedding array<double>")
    got = [(r["chunk_id"], r["rank"]) for r in dense.search(vectors, queries, 3).orderBy("rank").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3)]
    assert dense.search(vectors, queries, 0).count() == 0
    assert dense.search(vectors.where("false"), queries, 3).count() == 0


def test_store_rewrites(spark, rows):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int")
    assert rows(dense.upsert(store, new)) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(dense.unseen(new, store)) == [("c", 4)]
    with pytest.raises(Exception, match="expected vectors"):
        dense.checked(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2).collect()


def test_reranker_keeps_previous_order_among_equals(spark):
    ranked = spark.createDataFrame([("q", "d", "a", 1.0, 2), ("q", "d", "b", 1.0, 1), ("q", "d", "c", 1.0, 3)], LIST)
    chunks = corpus(spark, [("a", "same"), ("b", "same"), ("c", "wanted words")])
    got = [r["chunk_id"] for r in fusion.rerank(ranked, ask(spark, "wanted words").withColumn("query_id", F.lit("q")), chunks, 3).orderBy("rank").collect()]
    assert got == ["c", "b", "a"]


def test_pipeline_filters_after_the_cut_and_keeps_ranks(spark, rows):
    lists = spark.createDataFrame([("q", "dense", c, 1.0, i) for i, c in enumerate("abcd", 1)], LIST)
    extra = "content_role string, structural_type string, parent_structure string, metadata map<string,string>, provenance struct<section:string,repository:string,path:string>, project string, language string"
    data = [(c, f"prose of {c}", "pdf" if c == "a" else "note", "navigation" if c == "b" else "evidence", None, None, {}, None, None, None) for c in "abcd"]
    chunks = spark.createDataFrame(data, f"{CHUNK}, {extra}")
    stages = pipeline.run(lists, lists.where("false"), chunks, 4, 4, 5, metadata={"source_type": ["NOTE "]})
    assert rows(stages["structural"], "chunk_id", "rank") == [("a", 1), ("c", 3), ("d", 4)]
    assert rows(stages["final"], "chunk_id", "rank") == [("c", 3), ("d", 4)]


def test_graded_measures(spark):
    questions = spark.createDataFrame([("q", "c", True), ("u", "c", False)], "query_id string, category string, answerable boolean")
    gold = spark.createDataFrame([("q", "x", 3), ("q", "x", 1), ("q", "y", 1), ("q", "z", 0)], "query_id string, chunk_id string, grade int")
    results = spark.createDataFrame([("q", "d", "y", 1.0, 1), ("q", "d", "x", 0.5, 2)], LIST)
    got = evaluation.per_query(results, questions, gold).where("query_id = 'q'").first()
    ideal = 7 / math.log2(2) + 1 / math.log2(3)
    assert (got["hit_1"], got["hit_5"], got["mrr"]) == (0.0, 1.0, 0.5)
    assert got["ndcg_5"] == pytest.approx((1 / math.log2(2) + 7 / math.log2(3)) / ideal, abs=1e-8)
    with pytest.raises(ValueError, match="q: x"):
        evaluation.require_gold(gold, corpus(spark, [("y", ""), ("z", "")]))


def test_complementarity_golden_numbers(spark):
    questions = spark.createDataFrame([("q", "c", True)], "query_id string, category string, answerable boolean")
    gold = spark.createDataFrame([("q", "gold-a", 3), ("q", "gold-b", 3)], "query_id string, chunk_id string, grade int")

    def listed(*names):
        return spark.createDataFrame([("q", "x", n, 1.0, i) for i, n in enumerate(names, 1)], LIST)

    got = evaluation.complementarity(listed("shared", "gold-b", "dense-only"), listed("shared", "bm25-only", "gold-a"), listed("shared", "gold-b"), questions, gold).first()
    assert (got["intersection"], got["union_count"], got["jaccard"], got["unique_dense"], got["unique_bm25"]) == (1, 5, 0.2, 2, 2)
    assert (got["dense_gold_rank"], got["bm25_gold_rank"], got["hybrid_gold_rank"], got["classification"]) == (2, 3, 2, "both")


def test_dense_in_blocks_equals_one_block(spark, rows, monkeypatch):
    vectors = spark.createDataFrame([(f"v{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", [float(i), 1.0, 2.0]) for i in range(7)], "query_id string, embedding array<double>")
    want = rows(dense.search(vectors, queries, 4))
    monkeypatch.setattr(dense, "BLOCK", 3)
    assert rows(dense.search(vectors, queries, 4)) == want and len(want) == 28


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_of_all_pairs_are_not_shuffled_and_equal_the_formula_in_any_blocks(spark, rows, monkeypatch):
    texts = {"a": "the red fox", "b": "the dog", "c": "blue refreshToken", "d": "zebra", "e": ""}
    index = lexical.build_index(corpus(spark, [*texts.items(), ("a", "the red fox"), (None, "the")]))
    asked = {1: "the fox", 2: "The REFRESH of the token", 3: "the", 4: "dog or zebra", 5: "unknown", 6: None, 7: "blue fox"}
    queries = spark.createDataFrame([*asked.items(), (None, "the")], "query_id bigint, question string")
    held = {c: set(t.lower().split()) | ({"refresh", "token"} if c == "c" else set()) for c, t in texts.items()}
    average, want = sum(map(len, held.values())) / 5, []
    for q, text in asked.items():
        idf = {t: math.log(6 / n) for t in set((text or "").lower().split()) if (n := sum(t in h for h in held.values()))}
        for c, h in held.items():
            if shared := h & idf.keys():
                part = sum(idf[t] for t in shared) * 2.5 / (1.5 * (0.25 + 0.75 * len(h) / average) + 1)
                want.append((q, c, pytest.approx(part + sum(idf.values()), abs=2e-9)))
    whole = lexical.scores(index, queries)
    assert "Exchange" not in plan(whole)
    assert dict(whole.dtypes) == {"query_id": "bigint", "chunk_id": "string", "score": "double"}
    assert rows(whole) == want and len(want) == 11
    monkeypatch.setattr(lexical, "PAIR_BLOCK", 2)
    monkeypatch.setattr(lexical, "CELLS", 3)
    assert rows(lexical.scores(index, queries)) == want
    assert lexical.scores(index, queries.where("query_id = 5")).count() == 0
    assert all(r["score"] == round(r["score"], 2) for r in lexical.scores(index, queries, digits=2).collect())


def test_candidates_are_counted_without_making_the_pairs(spark, rows, monkeypatch, tmp_path):
    texts = [("a", "the red fox"), ("a", "the red fox"), ("b", "the dog"), ("c", "blue refreshToken"), ("d", "zebra"), (None, "the")]
    questions = ask(spark, "the fox", "the refresh token", "the", "unknown", None, "blue fox")
    corpus(spark, texts).write.parquet(f"{tmp_path}/chunks.parquet")
    questions.write.parquet(f"{tmp_path}/questions.parquet")
    got = catalogue.QUERIES["lexical_candidates"](spark, str(tmp_path))
    assert "query_id" not in plan(got)
    assert rows(got, "candidates", "pairs") == [(3, 9)]
    index = lexical.build_index(corpus(spark, texts))
    assert "Exchange" not in plan(lexical.matches(index, questions))
    assert rows(lexical.matches(index, questions)) == [("a", 4), ("b", 3), ("c", 2)]
    monkeypatch.setattr(lexical, "COUNT_BLOCK", 2)
    assert rows(lexical.matches(index, questions).groupBy("chunk_id").agg(F.sum("queries"))) == [("a", 4), ("b", 3), ("c", 2)]
    questions.where("query_id = 'q3'").write.mode("overwrite").parquet(f"{tmp_path}/questions.parquet")
    assert rows(catalogue.QUERIES["lexical_candidates"](spark, str(tmp_path)), "candidates", "pairs") == [(0, 0)]
