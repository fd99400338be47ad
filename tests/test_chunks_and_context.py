"""Chunks taken from a task's texts a few at a time, and the rules that go with every question."""

import datetime as dt

from dealweave.catalog.base import QUERIES
from dealweave.operators import chunks


def test_chunks_hold_a_few_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(chunks, "TEXTS_AT_ONCE", 2)
    rows = [(i, f"Line {i}.\nA longer line of {i} words.") for i in range(7)] + [(None, "no id"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "id bigint, body string").coalesce(1)
    cut = chunks.chunk_documents(docs, "id", "body", 12)
    assert "MapInArrow" in cut._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, text in rows:
        pieces = list(chunks.chunk_text(text, 12))
        want += [(i, n, piece, len(pieces)) for n, piece in enumerate(pieces, 1)]
    assert [tuple(r) for r in cut.collect()] == want


def test_memory_context_has_every_active_rule_once(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    day = dt.datetime(2024, 1, 1)
    table("documents", [(i, f"red ring {i}", "en", f"src{i}") for i in range(5)], "doc_id bigint, text string, lang string, source string")
    table("embeddings", [(i, [1.0, float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>")
    table("benchmark", [(1, "red"), (2, "ring")], "item_id bigint, text string")
    table("events", [(1, 1, "click", day, 10.0, "a"), (2, 1, "click", day, 10.0, "a"), (3, 1, "click", day, 70.0, "b"), (4, 1, "view", day, 1.0, "c")],
          "event_id bigint, user_id bigint, event_type string, ts timestamp, value double, props string")
    got = QUERIES["memory_context"](spark, str(tmp_path)).collect()
    assert sorted(r.query_id for r in got if r.rule_id is None) == [1, 2]
    assert sorted((r.rule_id, r.rule, r.rule_created_at) for r in got if r.query_id is None) == [
        (1, "Rule for a", "2024-01-01 00:00:00"), (2, "Rule for a", "2024-01-01 00:00:00")]
