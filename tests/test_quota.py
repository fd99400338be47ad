"""Rolling use to the second, over several batches, against counting."""

import datetime as dt

from pyspark.sql import functions as F

from dealweave.streaming import jobs
from dealweave.streaming.quota import DAY, run_usage_steps, used_at

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def stream(spark, folder):
    schema = spark.createDataFrame([], "created_at timestamp, user_email string, error string").schema
    return jobs.file_stream(spark, f"{folder}/in-*", schema, files_per_batch=1)


def arrive(spark, folder, number, rows):
    data = [(START + dt.timedelta(seconds=s), u, e) for u, s, e in rows]
    spark.createDataFrame(data, "created_at timestamp, user_email string, error string").coalesce(1).write.parquet(
        f"{folder}/in-{number}")


def counted(uses, until):
    """Steps by counting; ``until``: seconds that the watermark has passed."""
    out = {}
    for u, s in uses:
        for at in (s, s + DAY):
            if at < until:
                out[u, at] = sum(1 for v, x in uses if v == u and at - DAY < x <= at)
    return out


def steps(df):
    rows = df.select("client", F.unix_seconds("at").alias("s"), "used").collect()
    got = {(r.client, r.s - int(START.timestamp())): r.used for r in rows}
    assert len(got) == len(rows)
    return got


def test_steps_over_batches_and_restarts(spark, tmp_path):
    hour = 3600
    first = [("a", 0, None), ("a", 0, None), ("b", 10, None), ("a", 5, "failed"), (None, 6, None), ("a", 7200, None)]
    second = [("a", 5000, None), ("b", 10 + DAY, None), ("a", DAY, None), ("a", 3 * hour + DAY, None)]
    late = [("a", 100, None), ("b", 3 * DAY, None)]  # the first is days older than the watermark
    for i, batch in enumerate((first, second)):
        arrive(spark, tmp_path, i, batch)
    uses = [(u, s) for u, s, e in first + second if u and not e]
    out = f"{tmp_path}/out"
    for _ in range(2):  # a second run finds nothing new
        got = steps(run_usage_steps(stream(spark, tmp_path), out))
        assert got == counted(uses, 2 * hour + DAY)
    arrive(spark, tmp_path, 2, late)
    done = run_usage_steps(stream(spark, tmp_path), out)
    want = counted(uses + [("b", 3 * DAY)], 3 * DAY - hour)
    assert steps(done) == want
    assert want["a", DAY] == 3 and want["b", 10 + DAY] == 1  # a use a day old to the second is out
    moments = [("a", 1), ("a", DAY - 1), ("a", DAY + 4999), ("b", 0), ("new", 50)]
    asked = spark.createDataFrame([(u, START + dt.timedelta(seconds=s)) for u, s in moments], "client string, at timestamp")
    got = {(r.client, r.s - int(START.timestamp())): r.used for r in used_at(done, asked).select(
        "client", F.unix_seconds("at").alias("s"), "used").collect()}
    assert got == {m: sum(1 for u, s in uses if u == m[0] and m[1] - DAY < s <= m[1]) for m in moments}


def test_state_is_bounded(spark, tmp_path):
    for i, day in enumerate((0, 3, 6, 9)):
        arrive(spark, tmp_path, i, [("a", day * DAY + s, None) for s in range(0, 200, 2)])
    run_usage_steps(stream(spark, tmp_path), f"{tmp_path}/out")
    state = spark.read.format("statestore").option("stateVarName", "uses").load(f"{tmp_path}/out/checkpoint")
    assert 0 < state.count() <= 100  # the last day's seconds, not those of all four


def test_one_value_and_one_timer_a_client(spark, tmp_path):
    """The calls to the state grow with the clients of a batch, not with the seconds they used."""
    arrive(spark, tmp_path, 0, [(u, s, None) for u in "abc" for s in range(0, 9000, 50)])
    run_usage_steps(stream(spark, tmp_path), f"{tmp_path}/out")
    for option in (("stateVarName", "uses"), ("readRegisteredTimers", True)):
        assert spark.read.format("statestore").option(*option).load(f"{tmp_path}/out/checkpoint").count() == 3
