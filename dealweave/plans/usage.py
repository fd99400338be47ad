"""Reports over the usage log, feedback, rules and run log. ``as_of`` replaces the clock everywhere.

``log`` has id, created_at, client_id, user_email, question, answer, model, error, rating, correction,
correction_status, row_count, ms, tokens_in and tokens_out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.order import newest, oldest
from dealweave.operators.rows import bounded, latest_per_key
from dealweave.plans.answers import error_class

# Report lengths of the source system, as defaults of the reports that show the newest.
LEARNING_WEEKS = 12
EVENTS = 40
QUEUE = 100
PENDING, APPROVED, DISMISSED = "pending", "approved", "dismissed"
UNKNOWN_USER = "(before login)"
EXAMPLE_KIND = "answer_example"


@dataclass(frozen=True)
class Limits:
    per_client_day: int = 40
    global_day: int = 400


@dataclass(frozen=True)
class Prices:
    """Price per million tokens read and written."""

    read: float = 0.0
    written: float = 0.0


def _ok() -> Column:
    return F.col("error").isNull()


def _last_day(as_of: Column) -> Column:
    return F.col("created_at") > as_of - F.make_dt_interval(F.lit(1))


def _since(as_of: Column, days: int) -> Column:
    """Rows later than the first moment of the day ``days`` before the as-of day."""
    return F.col("created_at") > F.date_sub(as_of.cast("date"), days).cast("timestamp")


def _int(c: Column, name: str) -> Column:
    return c.cast("bigint").alias(name)


def period(days: int) -> int:
    """A number of days, at least one."""
    if days < 1:
        raise ValueError("a period has at least one day")
    return days


def usage_quota(log: DataFrame, as_of: Column, limits: Limits = Limits(), client: str = "user_email") -> DataFrame:
    """Answered questions of the last 24 hours per client, next to the total, with what is left of both limits."""
    recent = log.filter(_ok() & _last_day(as_of))
    clients = log.select(F.col(client).alias("client")).filter(F.col("client").isNotNull()).distinct()
    used = recent.groupBy(F.col(client).alias("client")).agg(F.count(F.lit(1)).alias("used"))
    everyone = recent.agg(F.count(F.lit(1))).scalar()
    out = clients.join(used, "client", "left").select(
        "client", F.coalesce("used", F.lit(0)).alias("used"), F.lit(limits.per_client_day).alias("daily_limit"),
        everyone.alias("team_used"), F.lit(limits.global_day).alias("team_limit"))
    return out.withColumn("remaining", F.greatest(F.col("daily_limit") - F.col("used"), F.lit(0))).withColumn(
        "team_remaining", F.greatest(F.col("team_limit") - F.col("team_used"), F.lit(0)))


def usage_kpis(log: DataFrame, as_of: Column, days: int = 30, prices: Prices = Prices()) -> DataFrame:
    """One row of totals over the period. Users are counted from a partial distinct, not from one task."""
    rows = log.filter(_since(as_of, period(days) - 1))
    people = rows.filter(F.col("user_email").isNotNull()).select("user_email").distinct().agg(F.count(F.lit(1))).scalar()
    totals = rows.agg(
        _int(F.count(F.lit(1)), "total"), _int(F.count_if(_ok()), "answered"), _int(F.count_if(~_ok()), "failed"),
        _int(F.count_if(F.col("rating") == 1), "up"), _int(F.count_if(F.col("rating") == -1), "down"),
        _int(F.count_if(_ok() & F.col("rating").isNull()), "unrated"),
        F.round(F.avg(F.when(_ok(), F.col("ms").cast("decimal(18,2)"))), 0).cast("bigint").alias("avg_ms"),
        _int(F.coalesce(F.sum("tokens_in"), F.lit(0)), "tokens_in"),
        _int(F.coalesce(F.sum("tokens_out"), F.lit(0)), "tokens_out"))
    cost = (F.col("tokens_in") * F.lit(prices.read) + F.col("tokens_out") * F.lit(prices.written)) / 1_000_000
    return totals.withColumn("people", people).withColumn("est_cost_usd", F.round(cost, 2))


def _daily_counts() -> list[Column]:
    return [_int(F.count_if(_ok()), "answered"), _int(F.count_if(~_ok()), "failed"),
            _int(F.count_if(F.col("rating") == 1), "up"), _int(F.count_if(F.col("rating") == -1), "down")]


def daily_series(log: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Counts for every day of the period, days without rows included."""
    span = period(days)
    today = as_of.cast("date")
    counts = log.filter(_since(as_of, span)).groupBy(F.col("created_at").cast("date").alias("d")).agg(*_daily_counts())
    calendar = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, span - 1), today)).alias("d"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("answered", "failed", "up", "down")]
    return calendar.join(counts, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), *filled)


def people_table(log: DataFrame, users: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per person questions, answers, ratings, mean time and last use; rows without a user share one label."""
    named = log.filter(_since(as_of, period(days) - 1)).groupBy(
        F.coalesce("user_email", F.lit(UNKNOWN_USER)).alias("email")).agg(
        _int(F.count(F.lit(1)), "asked"), *_daily_counts(),
        F.round(F.avg(F.when(_ok(), F.col("ms").cast("decimal(18,2)"))), 0).cast("bigint").alias("avg_ms"),
        F.max("created_at").alias("last"))
    names = users.groupBy("email").agg(F.max("name").alias("name"))
    return named.join(names, "email", "left").orderBy(F.desc("asked"), "email")


def user_totals(log: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Every user with the answers of the last 24 hours and of all time."""
    counts = log.filter(_ok()).groupBy(F.col("user_email").alias("email")).agg(
        _int(F.count_if(_last_day(as_of)), "today"), _int(F.count(F.lit(1)), "total"))
    return users.join(counts, "email", "left").withColumn("today", F.coalesce("today", F.lit(0))).withColumn(
        "total", F.coalesce("total", F.lit(0)))


def failure_reasons(log: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """All error texts of the period by frequency, with their class. Runs of white space count as one space."""
    reasons = log.filter(~_ok() & _since(as_of, period(days) - 1)).groupBy(
        F.regexp_replace("error", r"\s+", " ").alias("reason")).agg(
        _int(F.count(F.lit(1)), "n"), F.max("created_at").alias("last"))
    return reasons.withColumn("error_class", error_class("reason")).orderBy(F.desc("n"), "reason")


def weekly_learning(feedback: DataFrame, rules: DataFrame, log: DataFrame, as_of: Column,
                    weeks: int = LEARNING_WEEKS) -> DataFrame:
    """Examples, rules and downvotes per week, weeks without any included. Weeks start on Monday."""
    last = F.date_trunc("week", as_of)
    first = last - F.make_dt_interval(F.lit(7 * (weeks - 1)))
    calendar = log.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.make_dt_interval(F.lit(7)))).alias("w"))
    parts = ((feedback.filter(F.col("rating") == 1), "examples"), (rules, "rules"),
             (log.filter(F.col("rating") == -1), "downvotes"))
    out = calendar
    for df, name in parts:
        counts = df.filter(F.col("created_at") >= first).groupBy(F.date_trunc("week", "created_at").alias("w")).agg(
            _int(F.count(F.lit(1)), name))
        out = out.join(counts, "w", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select(F.date_format("w", "yyyy-MM-dd").alias("week"), "examples", "rules", "downvotes")


def event_feed(feedback: DataFrame, rules: DataFrame, log: DataFrame, n: int = EVENTS) -> DataFrame:
    """The newest learning events: examples, rules and corrections. Each source is cut to n before they are merged."""
    channel = F.when(F.col("chat_id").startswith("team:"), F.regexp_replace("chat_id", "^team:", "")).otherwise("assistant")
    author = F.nullif(F.regexp_extract("source", r"by ([^ ]+)\z", 1), F.lit(""))
    no_text = F.lit(None).cast("string")
    parts = [
        feedback.filter(F.col("rating") == 1).select(
            F.col("created_at").alias("at"), F.lit("example").alias("type"), channel.alias("who"),
            F.col("question").alias("text"), no_text.alias("detail"), F.col("id").cast("bigint").alias("ref")),
        rules.select(
            F.col("created_at").alias("at"), F.when(F.col("active"), "rule").otherwise("rule_off").alias("type"),
            F.coalesce(author, "source").alias("who"), F.col("rule").alias("text"), F.col("source").alias("detail"),
            F.col("id").cast("bigint").alias("ref")),
        log.filter(F.col("rating") == -1).select(
            F.col("created_at").alias("at"),
            F.concat(F.lit("correction_"), F.coalesce("correction_status", F.lit(PENDING))).alias("type"),
            F.col("user_email").alias("who"), F.col("question").alias("text"), F.col("correction").alias("detail"),
            F.col("id").cast("bigint").alias("ref")),
    ]
    order = [newest("at"), oldest("type"), oldest("ref")]
    heads = [p.orderBy(*order).limit(n) for p in parts]
    return reduce(DataFrame.unionByName, heads).orderBy(*order).limit(n)


def training_totals(docs: DataFrame, rules: DataFrame, log: DataFrame) -> DataFrame:
    """One row: examples, pending embeddings, rules, corrections by state, other documents."""
    d = docs.agg(
        _int(F.count_if(F.col("kind") == EXAMPLE_KIND), "examples"),
        _int(F.count_if((F.col("kind") == EXAMPLE_KIND) & F.col("embedding").isNull()), "examples_pending"),
        _int(F.count_if(F.col("kind") != EXAMPLE_KIND), "memory_docs"),
        F.max(F.when(F.col("kind") != EXAMPLE_KIND, F.col("updated_at"))).alias("memory_updated"))
    on, off = _scalars(rules, F.count_if("active"), F.count_if(~F.col("active")))
    state = F.coalesce("correction_status", F.lit(PENDING))
    pending, approved, dismissed = _scalars(
        log, F.count_if((F.col("rating") == -1) & (state == PENDING)),
        F.count_if(F.col("correction_status") == APPROVED), F.count_if(F.col("correction_status") == DISMISSED))
    extra = {"rules_active": on, "rules_off": off, "corr_pending": pending, "corr_approved": approved,
             "corr_dismissed": dismissed}
    return d.select("*", *[value.alias(name) for name, value in extra.items()])


def _scalars(df: DataFrame, *aggregates: Column) -> list[Column]:
    """Aggregates as scalar subqueries over one shared pass."""
    row = df.agg(F.struct(*[a.alias(f"c{i}") for i, a in enumerate(aggregates)]).alias("r")).scalar()
    return [row[f"c{i}"] for i in range(len(aggregates))]


def documents_by_kind(docs: DataFrame) -> DataFrame:
    return docs.groupBy("kind").agg(_int(F.count(F.lit(1)), "n")).orderBy(F.desc("n"), "kind")


def review_queue(log: DataFrame, n: int = QUEUE) -> DataFrame:
    """Downvoted answers, the undecided first, then the newest."""
    status = F.coalesce("correction_status", F.lit(PENDING))
    rows = log.filter(F.col("rating") == -1).select(
        "id", "created_at", F.coalesce("user_email", "client_id").alias("who"), "question",
        "answer", "correction", status.alias("status"))
    return rows.orderBy((F.col("status") == PENDING).desc(), F.desc("id")).limit(n)


def log_search(log: DataFrame, before: int | None = None, limit: int = 30, user: str | None = None,
               text: str | None = None, status: str = "all") -> DataFrame:
    """Newest log rows that fit all given conditions, and whether there are more of them."""
    conditions = {
        "answered": _ok(), "failed": ~_ok(), "up": F.col("rating") == 1, "down": F.col("rating") == -1,
        "unrated": _ok() & F.col("rating").isNull(),
    }
    rows = log
    if before is not None:
        rows = rows.filter(F.col("id") < before)
    if user:
        rows = rows.filter(F.col("user_email") == user.lower())
    if text:
        like = f"%{text.strip()}%"
        rows = rows.filter(F.col("question").ilike(like) | F.col("answer").ilike(like))
    if status in conditions:
        rows = rows.filter(conditions[status])
    rows = rows.withColumn("who", F.coalesce("user_email", "client_id"))
    return bounded(rows, [F.desc("id")], limit)


# --- runs and freshness ----------------------------------------------------------------------------------------

def last_runs(runs: DataFrame, succeeded: bool = False, note_prefix: str | None = None) -> DataFrame:
    """Latest run per source, optionally of the successful ones or of those whose note starts with a text."""
    rows = runs.filter("ok") if succeeded else runs
    if note_prefix:
        rows = rows.filter(F.col("error").ilike(f"{note_prefix}%"))
    return latest_per_key(rows, ["source"], [newest("finished_at"), newest("id")])


def freshness(runs: DataFrame, pipeline: DataFrame, decided: DataFrame, content: DataFrame, main: str = "pipeline"
              ) -> DataFrame:
    """One row: data date, last success per source, and table counts."""
    per_source = runs.filter("ok").groupBy("source").agg(F.max("finished_at").alias("at"))
    base = per_source.agg(
        F.max(F.when(F.col("source") == main, F.col("at"))).alias("data_as_of"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "at")))).alias("syncs"))
    counts = {
        "deals": pipeline.agg(F.count(F.lit(1))).scalar(), "raw_data": decided.agg(F.count(F.lit(1))).scalar(),
        "with_transcript": content.agg(F.count_if(F.coalesce(F.length("transcript"), F.lit(0)) > 0)).scalar(),
    }
    return base.select("*", *[value.alias(name) for name, value in counts.items()])


def memory_report(rules: DataFrame, insights: DataFrame, feedback: DataFrame) -> DataFrame:
    """Everything learned, newest first within its section; rows rather than one nested value, as it only grows."""
    parts = [
        ("rule", rules, "rule", F.col("source"), F.col("active")),
        ("insight", insights, "title", F.col("evidence"), F.col("active")),
        ("example", feedback.filter(F.col("rating") == 1), "question", F.lit(None).cast("string"), F.lit(True)),
    ]
    rows = [
        df.select(F.lit(section).alias("section"), F.col("id").cast("bigint").alias("id"), "created_at",
                  F.col(title).alias("title"), detail.alias("detail"), active.alias("active"))
        for section, df, title, detail, active in parts]
    return reduce(DataFrame.unionByName, rows).orderBy("section", newest("created_at"), newest("id"))


def memory_summary(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: votes and the last run of every source (the sources are few)."""
    last = last_runs(runs).agg(F.sort_array(F.collect_list(F.struct(
        "source", F.col("finished_at").alias("at"), "ok", "rows_synced", F.col("error").alias("note")))).alias("x")).scalar()
    votes = feedback.agg(
        _int(F.count_if(F.col("rating") == 1), "up"), _int(F.count_if(F.col("rating") == -1), "down"))
    return votes.withColumn("last_sync", last)
