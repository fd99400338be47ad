import datetime as dt

from pyspark.sql import functions as F

from dealweave.plans import usage
from dealweave.streaming import jobs
from tests.test_rows_and_joins import rows


def at(text):
    return dt.datetime.fromisoformat(text)


def as_of():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


def log(spark):
    data = [(1, at("2024-01-31T11:00:00"), "a", None, 1, 10, None), (2, at("2024-01-30T12:00:00"), "a", None, None, 20, None), (3, at("2024-01-30T12:00:01"), None, None, -1, 30, None),
            (4, at("2024-01-31T10:00:00"), "b", "rate   limit", None, 99, None), (5, at("2023-12-01T00:00:00"), "b", None, -1, 40, "approved")]
    return spark.createDataFrame(
        [(i, t, u, e, r, ms, s, f"question {i}", "c", "ans", "corr", 100, 10) for i, t, u, e, r, ms, s in data],
        "id bigint, created_at timestamp, user_email string, error string, rating int, ms int, correction_status string, question string, client_id string, answer string, "
        "correction string, tokens_in int, tokens_out int")


def test_quota_and_kpis(spark):
    got = {r.client: (r.used, r.team_used, r.remaining) for r in usage.usage_quota(log(spark), as_of(), usage.Limits(1, 3)).collect()}
    assert got == {"a": (1, 2, 0), "b": (0, 2, 1)}
    k = usage.usage_kpis(log(spark), as_of(), 7, usage.Prices(1.0, 10.0)).first()
    assert (k.total, k.answered, k.failed, k.up, k.down, k.unrated, k.people, k.avg_ms, k.tokens_in) == (4, 3, 1, 1, 1, 1, 2, 20, 400)
    assert usage.period(8) == 8


def test_series_are_gap_free(spark):
    days = usage.daily_series(log(spark), as_of(), 365).collect()
    assert len(days) == 365 and sum(r.answered + r.failed for r in days) == 5
    weeks = usage.weekly_learning(
        spark.createDataFrame([(1, at("2024-01-29T00:00:00"))], "rating int, created_at timestamp"),
        spark.createDataFrame([(at("2023-01-01T00:00:00"),)], "created_at timestamp"), log(spark), as_of()).collect()
    assert len(weeks) == 12 and {r.week: r.examples for r in weeks}["2024-01-29"] == 1 and sum(r.rules for r in weeks) == 0
    assert sum(r.downvotes for r in weeks) == 2


def test_people_failures_queue(spark):
    users = spark.createDataFrame([("a", "Ann"), ("z", "Zed")], "email string, name string")
    people = {r.email: (r.name, r.asked) for r in usage.people_table(log(spark), users, as_of(), 7).collect()}
    assert people == {"a": ("Ann", 2), "b": (None, 1), "(before login)": (None, 1)}
    assert {r.email: (r.today, r.total) for r in usage.user_totals(log(spark), users, as_of()).collect()} == {"a": (1, 2), "z": (0, 0)}
    assert rows(usage.failure_reasons(log(spark), as_of(), 7).select("reason", "n", "error_class")) == [("rate limit", 1, "busy")]
    assert [(r.id, r.status, r.who) for r in usage.review_queue(log(spark)).collect()] == [(3, "pending", "c"), (5, "approved", "b")]


def test_log_search(spark):
    got = usage.log_search(log(spark), before=5, limit=10, text="QUESTION", status="unrated")
    assert [(r.id, r.truncated) for r in got.collect()] == [(2, False)]
    assert [r.id for r in usage.log_search(log(spark), user="A").orderBy("id").collect()] == [1, 2]


def files(spark, folder, *batches):
    schema = "id bigint, created_at timestamp, user_email string, error string, rating int, question string"
    for i, batch in enumerate(batches):
        df = spark.createDataFrame([(n, at(t), "u", None, None, q) for n, t, q in batch], schema).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/in-{i}")
    return schema


def stream(spark, folder, schema):
    return jobs.file_stream(spark, f"{folder}/in-*", spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_late_rows_and_closed_windows(spark, tmp_path):
    schema = files(spark, tmp_path, [(1, "2024-01-01T10:00:00", "a")], [(2, "2024-01-03T10:00:00", "b")], [(5, "2024-01-03T11:00:00", "b")], [(3, "2024-01-01T11:00:00", "late")], [(4, "2024-01-05T00:00:00", "c")])
    for _ in range(2):  # a second run on the folder changes nothing
        updated = jobs.updated_result(jobs.daily_kpis(stream(spark, tmp_path, schema)), f"{tmp_path}/update", ["day"])
        assert {str(r.day)[:10]: r.answered for r in updated.collect()} == {"2024-01-01": 1, "2024-01-03": 2, "2024-01-05": 1}
    appended = jobs.appended_result(jobs.daily_kpis(stream(spark, tmp_path, schema)), f"{tmp_path}/append")
    got = {str(r.day)[:10]: r.answered for r in appended.collect()}
    assert got == {"2024-01-01": 1, "2024-01-03": 2}  # the late row is dropped, the last window stays open


def test_queries_are_deduplicated_across_batches(spark, tmp_path):
    schema = files(spark, tmp_path, [(1, "2024-01-01T10:00:00", "What  now")], [(2, "2024-01-02T10:00:00", "what now"), (3, "2024-01-02T10:00:00", "other")])
    got = jobs.appended_result(jobs.distinct_queries(stream(spark, tmp_path, schema)).select("q"), f"{tmp_path}/dedupe")
    assert rows(got) == [("other",), ("what now",)]


def test_document_stream_over_several_batches(spark, tmp_path):
    from dealweave.operators.merge import finish_documents

    def docs(items):
        return spark.createDataFrame(items, "id string, kind string, title string, body string, metadata string")

    for i, batch in enumerate(([("a", "k", "t", "new", "{}")], [("b", "k", "t", "b", "{}"), ("a", "k", "t", "newer", "{}")])):
        docs(batch).coalesce(1).write.parquet(f"{tmp_path}/in-{i}")
    moment = F.lit("2024-01-01").cast("timestamp")
    stored = finish_documents(docs([("a", "k", "t", "old", "{}"), ("c", "k", "t", "c", "{}")])).withColumn(
        "embedding", F.array(F.lit(1.0).cast("float"))).withColumn("updated_at", moment).withColumn("embedded_at", moment)
    arriving = jobs.file_stream(spark, f"{tmp_path}/in-*", docs([]).schema, files_per_batch=1)
    got = {r.id: (r.body, r.embedding is not None) for r in jobs.stream_merge(arriving, stored, f"{tmp_path}/out", as_of()).collect()}
    assert got == {"a": ("newer", False), "b": ("b", False), "c": ("c", True)}
    docs([("d", "k", "t", "d", "{}")]).coalesce(1).write.parquet(f"{tmp_path}/in-2")
    for _ in range(2):  # restarted with another file, then with nothing new: every row stays
        state = jobs.stream_merge(arriving, stored, f"{tmp_path}/out", as_of())
        assert {r.id: r.body for r in state.collect()} == {"a": "newer", "b": "b", "c": "c", "d": "d"}


def test_tables_in_one_file_or_many_and_without_rows(spark, tmp_path):
    from dealweave.catalog.base import QUERIES

    docs = spark.createDataFrame(
        [(i, f"text {i}", "en", f"src{i}", 6) for i in range(6)], "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.limit(0).coalesce(1).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for folder, n in (("many", 6), ("one", 6), ("none", 0)):
        done = QUERIES["stream_embed_pending"](spark, f"{tmp_path}/{folder}")
        assert {(r.id, r.dimensions) for r in done.collect()} == {(f"doc{i}", 64) for i in range(n)}
    merged = QUERIES["stream_doc_merge"](spark, f"{tmp_path}/many")
    assert {r.id: r.has_vector for r in merged.collect()} == {
        "doc0": True, "doc1": False, "doc2": False, "doc3": False, "doc4": True, "doc5": True}
    empty = spark.createDataFrame([], "id bigint, created_at timestamp, user_email string, error string, rating int, question string")
    (tmp_path / "nothing").mkdir()
    nothing = jobs.file_stream(spark, str(tmp_path / "nothing"), empty.schema)
    assert jobs.appended_result(nothing.select("question"), f"{tmp_path}/a").count() == 0
    assert jobs.updated_result(jobs.daily_kpis(nothing), f"{tmp_path}/u", ["day"]).count() == 0


def test_rolling_usage_holds_hours_and_counts_windows(spark, tmp_path):
    """The stream writes a row per user and hour; every window of 24 hours is counted from them, over several batches."""
    schema = files(spark, tmp_path, [(1, "2024-01-01T10:00:00", "a"), (2, "2024-01-01T10:59:59", "a")],
                   [(3, "2024-01-02T09:00:00", "b")], [(4, "2024-01-01T12:00:00", "late"), (5, "2024-01-02T10:00:00", "c")])
    got = jobs.rolling_usage(stream(spark, tmp_path, schema), f"{tmp_path}/usage")
    want = {}
    for t in ("2024-01-01T10", "2024-01-01T10", "2024-01-02T09", "2024-01-01T12", "2024-01-02T10"):
        for back in range(24):
            start = at(t + ":00:00") - dt.timedelta(hours=back)
            want[start] = want.get(start, 0) + 1
    assert {r.window_start: r.used for r in got.collect()} == want
    assert got.filter("window_end <> window_start + interval '24' hour or client <> 'u'").count() == 0
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/usage/result").count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(client#" in plan and "window_start#" not in "".join(
        line for line in plan.splitlines() if "hashpartitioning" in line)
