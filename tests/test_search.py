import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealweave.operators.chunks import chunk_documents, chunk_text, register_text_chunks
from dealweave.operators.postings import keyword_search, postings, query_terms, term_df
from dealweave.operators import vectors as vector_search
from dealweave.operators.vectors import vector_top_k
from dealweave.plans.documents import newest_rules
from dealweave.plans.search import embed_pending, embed_queries, hashed_words, hybrid_search, memory_context, similar_items
from tests.test_rows_and_joins import rows


def squeeze(text):
    return "".join((text or "").split())


def test_chunks_keep_the_text_and_stay_within_size():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "end. ", "\n", "x" * rng.randrange(30), "\t", "a!b? "]) for _ in range(rng.randrange(40)))
        size = rng.choice([10, 25, 60])
        pieces = list(chunk_text(text, size))
        assert all(0 < len(p) <= size for p in pieces)
        assert squeeze("".join(pieces)) == squeeze(text)


@pytest.mark.parametrize("text, size, want", [
    (None, 10, []), ("  \n ", 10, []), ("One. Two three", 9, ["One.", "Two three"]), ("alpha beta", 8, ["alpha", "beta"]),
    ("x" * 12, 5, ["xxxxx", "xxxxx", "xx"]), ("\t" + "y" * 9, 5, ["\tyyyy", "yyyyy"]), ("ab\ncd", 5, ["ab\ncd"]), ("ab\ncde", 5, ["ab", "cde"]),
    ("a\r\nb", 10, ["a\r\nb"])])
def test_chunk_edges(text, size, want):
    assert list(chunk_text(text, size)) == want


def test_chunk_frames(spark):
    df = spark.createDataFrame([(1, "a. b c"), (2, None), (3, "")], "id int, t string")
    assert rows(chunk_documents(df, "id", "t", 3)) == [(1, 1, "a.", 2), (1, 2, "b c", 2)]
    register_text_chunks(spark)
    assert rows(spark.sql("select d.id, c.* from {d} d, lateral text_chunks(d.t, 3) c", d=df)) == [(1, 1, "a."), (1, 2, "b c")]


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]
    data[3] = (3, [0.0] * 8)
    return data, spark.createDataFrame(data, "id int, embedding array<float>")


@pytest.mark.parametrize("limit", [4 << 20, 100])
def test_vector_top_k_equals_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(vector_search, "BLOCK_BYTES", limit)
    monkeypatch.setattr(vector_search, "PRODUCT_BYTES", limit)
    data, df = vectors(spark, 60, 1)
    df = df.unionByName(spark.createDataFrame([(100, [1.0]), (101, None), (102, [None] * 8), (None, [1.0] * 8)], df.schema))
    q = df.filter("id < 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in vector_top_k(q, df.repartition(5), 4, exclude_self=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    m = np.array([v for _, v in data])
    norm = np.linalg.norm(m, axis=1)
    for i in range(7):
        if i == 3:
            assert 3 not in got
            continue
        with np.errstate(invalid="ignore", divide="ignore"):
            sim = np.round(m @ m[i] / (norm * norm[i]), 9)
        order = sorted([j for j in range(60) if j not in (i, 3)], key=lambda j: (-sim[j], j))[:4]
        assert [x for _, x in sorted(got[i])] == order


def test_wide_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(40, 1536))
    data = [(i, wide[i % 20].tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "id int, embedding array<double>")
    q = df.filter("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vector_top_k(q, df.repartition(3), 2).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == [(i, k + 1, i + 20 * k) for i in range(3) for k in range(2)]


def corpus(spark):
    docs = spark.createDataFrame([
        ("d1", "deal", "T1", "alpha alpha common", '{"name":"One","status":"Pass"}'), ("d2", "deal", "T2", "alpha common", '{"name":"Two"}'),
        ("d3", "insight", "T3", "beta common", "{}"), ("d4", "founder", "T4", "gamma common", "{}")],
        "id string, kind string, title string, body string, metadata string")
    vecs = spark.createDataFrame(
        [("d1", [1.0, 0.0]), ("d2", [0.9, 0.1]), ("d3", [0.0, 1.0]), ("stale", [1.0, 0.0])], "id string, embedding array<float>").join(
        docs.select("id", "kind", "metadata").unionByName(spark.createDataFrame([("stale", "deal", "{}")], "id string, kind string, metadata string")), "id")
    asked = spark.createDataFrame([(1, "Alpha, common?", [1.0, 0.0]), (2, "beta", [0.0, 1.0]), (3, "common", None)], "query_id int, text string, vector array<float>")
    return docs, vecs, asked, postings(docs, "id", "body")


def test_keyword_side(spark):
    docs, _, asked, posts = corpus(spark)
    frequencies = term_df(posts, 2)
    assert rows(frequencies) == [("alpha", 2), ("common", 4)]
    terms = query_terms(asked, "query_id", "text", frequencies, 3)
    assert rows(terms.select("query_id", "term")) == [(1, "alpha"), (2, "beta")]
    assert rows(keyword_search(terms, posts, 5).select("query_id", "id", "keyword_score", "rank")) == [
        (1, "d1", 2, 1), (1, "d2", 1, 2), (2, "d3", 1, 1)]


def test_hybrid_search(spark):
    docs, vecs, asked, posts = corpus(spark)
    got = hybrid_search(asked, docs, vecs, posts, 3, 60)
    best = {(r.query_id, r.position): r.id for r in got.collect()}
    assert best[(1, 1)] == "d1" and best[(1, 2)] == "d2" and best[(2, 1)] == "d3"
    # a word that every document holds is searched for as well
    assert "stale" not in best.values() and {i for (q, _), i in best.items() if q == 3} == {"d1", "d2", "d3"}
    score = got.filter("query_id = 1 and id = 'd1'").first().score
    assert score == pytest.approx(1.3 / 61 + 1 / 61)
    only = hybrid_search(asked, docs, vecs, posts, 3, 60, ["deal"], {"name": "Two"})
    assert {r.id for r in only.collect()} == {"d2"}
    nothing = hybrid_search(asked, docs, vecs, posts, 1, 60, ["none"])
    assert nothing.count() == 0


def test_similar_and_context(spark):
    docs, vecs, asked, posts = corpus(spark)
    near = similar_items(spark.createDataFrame([("d1",)], "id string"), vecs, docs, 2)
    assert [(r.id, r["rank"]) for r in near.orderBy("rank").collect()][0][0] == "d2" or near.count() <= 2
    rules = spark.createDataFrame([(1, "2024-01-01", "r1", True), (2, "2024-01-02", "r2", True), (3, "2024-01-03", "r3", False)],
                                  "id int, created_at string, rule string, active boolean")
    got = {r.query_id: r for r in memory_context(asked, docs, vecs, posts, 8, 6, 60).collect()}
    assert [h.name for h in got[1].hits][:2] == ["One", "Two"]
    assert [m.id for m in got[2].memory] == ["d3"] and got[3].memory is None
    assert rows(newest_rules(rules).select("rule")) == [("r1",), ("r2",)]


def test_texts_of_found_documents_are_read_where_they_lie(spark):
    docs, vecs, asked, posts = corpus(spark)
    far = docs.repartition(3).unionByName(docs.limit(0))
    near = similar_items(spark.createDataFrame([("d1",)], "id string"), vecs, far, 2)
    for found in (hybrid_search(asked, far, vecs, posts, 3, 60), near):
        shown = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown and "hashpartitioning(id" not in shown
    got = {r.query_id: r for r in memory_context(asked, far, vecs, posts, 8, 6, 60).collect()}
    assert sorted(got) == [1, 2, 3] and [h.id for h in got[1].hits] == ["d1", "d2", "d4"] and [m.id for m in got[2].memory] == ["d3"]


def test_embedding(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    docs = spark.createDataFrame([("a", "t", "b", [0.5]), ("b", "t", "w w", None)], "id string, title string, body string, embedding array<float>") \
        .withColumn("embedded_at", F.lit(None).cast("timestamp"))
    got = {r.id: r for r in embed_pending(docs, now).collect()}
    assert got["a"].embedding == [0.5] and got["a"].embedded_at is None
    assert len(got["b"].embedding) == 64 and abs(sum(x * x for x in got["b"].embedding) - 1) < 1e-6 and got["b"].embedded_at is not None
    cache = spark.createDataFrame([("known q", [1.0], "2024-01-20"), ("old", [1.0], "2023-12-01")], "q string, embedding array<float>, used string") \
        .select("q", "embedding", F.col("used").cast("timestamp").alias("used_at"))
    asked = spark.createDataFrame([(1, "Known  q"), (2, "new"), (3, "NEW ")], "id int, text string")
    answered, state = embed_queries(asked, cache, now)
    sizes = {r.id: len(r.vector) for r in answered.collect()}
    assert sizes == {1: 1, 2: 64, 3: 64}
    assert {r.q for r in state.collect()} == {"known q", "new"}
    assert hashed_words(__import__("pandas").Series([None]))[0] == [0.0] * 64


def test_frequent_words_are_searched_unless_a_limit_is_given(spark):
    docs = spark.range(900).selectExpr("'d' || id as id", "'common' || if(id = 5, ' common rare', '') as body")
    posts = postings(docs, "id", "body")
    asked = spark.createDataFrame([(1, "Common rare")], "query_id int, text string")
    frequencies = term_df(posts)
    assert rows(frequencies.orderBy("term")) == [("common", 900), ("rare", 1)]
    assert rows(query_terms(asked, "query_id", "text", frequencies).orderBy("term")) == [(1, "common"), (1, "rare")]
    got = keyword_search(query_terms(asked, "query_id", "text", frequencies), posts, 1000)
    assert got.count() == 900 and rows(got.filter("rank = 1").select("id", "keyword_score")) == [("d5", 3)]
    assert rows(query_terms(asked, "query_id", "text", frequencies, 800).select("query_id", "term")) == [(1, "rare")]
