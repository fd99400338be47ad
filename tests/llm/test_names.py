"""Columns of the input whose names clash with those an operator adds or uses, in upper or lower case."""

from __future__ import annotations

import pytest

from dealweave.llm import byte_bpe, decontaminate, line_runs, quality, simhash, token_counts, url_filter

TEXT = "some words of a text\nand a second line"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(1, TEXT, "x", "y", "en", 2, 3, 4, "z", "w")],
        "doc_id bigint, text string, N_TOKENS string, __text string, lang string, N_Lines int, fp int, c1 int, `a.b` string, N_Words string")


def check(frame, replaced, added):
    row = frame.collect()[0].asDict()
    assert row["text"] == TEXT and row["__text"] == "y" and row["a.b"] == "z" and row["c1"] == 4
    assert not set(replaced) & set(row) and set(added) <= set(row)


def test_texts(spark, docs):
    bench = spark.createDataFrame([(1, "quite another text")], "item_id bigint, text string")
    check(byte_bpe.encode_texts(docs), ["N_TOKENS"], ["n_tokens", "N_Words"])
    check(token_counts.count_tokens(docs), ["N_TOKENS", "N_Words"], ["n_tokens"])
    check(decontaminate.matches(docs, bench), ["N_Words"], ["n_words", "N_TOKENS"])
    check(quality.measures(docs), ["N_Words"], ["n_words", "N_Lines"])
    check(simhash.fingerprints(docs), [], ["fp"])
    check(line_runs.drop_common_lines(docs), ["N_Lines"], ["n_lines", "kept_text"])
    assert quality.accepted(docs).columns == decontaminate.clean(docs, bench).columns == docs.columns
    assert byte_bpe.encode_texts(docs).where("n_tokens > 2").count() == 1


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", 2, 3)], "page_id int, url string, Host int, given int")
    got = url_filter.judge(pages, [], spark.createDataFrame([("x",)], "key string"))
    assert got.columns == ["page_id", "url", "given", "host", "path", "rule", "verdict"]
    assert got.collect()[0][:5] == (1, "http://a.b/c", 3, "a.b", "/c")


def test_very_many_lines(spark):
    many = "\n".join(f"line {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, many + f"\nown {i}") for i in range(10)], "doc_id int, text string")
    got = line_runs.drop_common_lines(docs).collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got] == [(20_001, 20_000, f"own {r.doc_id}") for r in got]
