"""Checks and look-ups over questions, answers and their evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.hashing import short_digest
from dealweave.functions.order import newest, oldest
from dealweave.functions.sql_text import bare_sql
from dealweave.functions.text import any_word
from dealweave.operators.containment import Containment
from dealweave.operators.rows import first_per_group
from dealweave.session import materialised

# Words that open a remark or make up a heading, so that bold text with them is not a name.
REMARK_WORDS = (
    "scope", "takeaway", "corrected", "note", "part", "total", "all", "none", "not set", "yes", "no")
HEADING_WORDS = (
    "companies", "deals", "founders", "investors", "startups", "rounds", "teams", "sectors", "missed", "passed",
    "funded", "pattern", "patterns", "why", "who", "how many")

# Words that count parts and asks of a question, and that mark it as complex.
JOINING_WORDS = ("also", "and then", "as well as", "along with")
ASKING_WORDS = ("what", "which", "who", "whom", "how", "why", "where", "when", "list", "show", "identify")
ANALYSIS_WORDS = (
    "why", "pattern", "patterns", "compare", "comparison", "identify", "insight", "explain", "reason")
LONG_QUESTION = 160

# Error texts by class.
KEY_ERRORS = ("api key", "401", "incorrect", "key not set")
BUSY_ERRORS = ("quota", "billing", "credit", "429", "rate", "demand", "overload", "503")

# Topic words of questions about finance.
FINANCE_TOPIC = "fin ?tech|financial|lending|payments?|insur|wealth|neobank|credit"

BOLD = r"\*\*(.+?)\*\*"


# --- questions and queries -------------------------------------------------------------------------------------

def audit_sql(log: DataFrame, sql: str, blocked: Sequence[str]) -> DataFrame:
    """Flags on logged query texts: more than one statement, not a plain query, calls to ``blocked`` functions.

    Strings, quoted names, dollar-quoted texts and (nested) comments are taken out first, in one pass, so text inside
    them raises no flag and what looks like an opening quote inside a comment hides nothing.
    """
    body = F.regexp_replace(F.trim(sql), r";+\s*\z", "")
    calls = rf"(?i)\b({'|'.join(blocked)})\s*\("
    audited = log.withColumn("_body", body).withColumn("_bare", bare_sql(F.col("_body")))
    return audited.select(
        *log.columns, (F.trim("_body") == "").alias("is_empty"), F.contains("_bare", F.lit(";")).alias("many_statements"),
        (~F.col("_bare").rlike(r"(?i)^\s*(select|with)\b")).alias("not_a_query"),
        F.col("_bare").rlike(calls).alias("blocked_call"))


def question_profile(df: DataFrame, question: str = "question") -> DataFrame:
    """Parts, asks, length and the complex and finance flags of every question."""
    q = F.col(question)
    parts = F.regexp_count(q, F.lit(r"\?")) + F.regexp_count(q, F.lit(any_word(JOINING_WORDS)))
    asks = F.regexp_count(q, F.lit(any_word(ASKING_WORDS)))
    is_complex = (parts >= 2) | (asks >= 2) | (F.length(q) > LONG_QUESTION) | q.rlike(any_word(ANALYSIS_WORDS))
    return df.select(
        *df.columns, parts.alias("parts"), asks.alias("asks"), F.length(q).alias("length"),
        is_complex.alias("is_complex"), q.rlike(f"(?i){FINANCE_TOPIC}").alias("about_finance"))


def error_class(error: str | Column) -> Column:
    """``key``, ``busy`` or ``other``; NULL without an error."""
    text = F.col(error) if isinstance(error, str) else error
    return (
        F.when(text.isNull(), None).when(text.rlike(f"(?i){'|'.join(KEY_ERRORS)}"), "key")
        .when(text.rlike(f"(?i){'|'.join(BUSY_ERRORS)}"), "busy").otherwise("other")
    )


# --- grounding -------------------------------------------------------------------------------------------------

def bold_names(answers: DataFrame, answer_id: str = "answer_id", text: str = "answer") -> DataFrame:
    """(answer_id, name): distinct bold texts that look like names."""
    found = answers.select(
        F.col(answer_id).alias("answer_id"), F.explode(F.regexp_extract_all(text, F.lit(BOLD), F.lit(1))).alias("name"))
    found = found.withColumn("name", F.trim("name")).distinct()
    n = F.col("name")
    remark = n.rlike(rf"(?i)^({'|'.join(REMARK_WORDS)})\b")
    heading = n.rlike(any_word(HEADING_WORDS)) & (F.size(F.split(n, " ")) > 2)
    return found.filter((F.length(n) >= 3) & ~n.rlike(r"\d") & ~n.rlike(r"[:?]\z") & ~remark & ~heading)


def name_in_text_key(name: str | Column) -> Column:
    """Form of a name looked for in evidence: lower case, bracketed remarks removed."""
    column = F.col(name) if isinstance(name, str) else name
    return F.trim(F.regexp_replace(F.lower(column), r"\s*\(.*?\)\s*", " "))


def ungrounded_names(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, name): names of an answer found neither in its evidence rows nor in its question.

    The names of one answer travel as one array; each evidence row reports the names it holds, so names and rows are
    not paired up. ``answers``: answer_id, question, answer; ``evidence``: answer_id, text.
    """
    names = bold_names(answers).withColumn("key", name_in_text_key("name"))
    asked = answers.select("answer_id", F.lower(F.coalesce("question", F.lit(""))).alias("_q"))
    open_names = names.join(asked, "answer_id").filter(~F.contains("_q", F.col("key"))).drop("_q")
    wanted = open_names.groupBy("answer_id").agg(F.collect_set("key").alias("_keys"))
    rows = evidence.select("answer_id", F.lower("text").alias("_t")).join(wanted, "answer_id")
    seen = rows.select("answer_id", F.explode(F.filter("_keys", lambda k: F.contains(F.col("_t"), k))).alias("key"))
    return open_names.join(seen.distinct(), ["answer_id", "key"], "left_anti").select("answer_id", "name")


def drop_ungrounded(answers: DataFrame, ungrounded: DataFrame) -> DataFrame:
    """Answers without the lines naming something ungrounded, and how many names were removed."""
    bad = ungrounded.groupBy("answer_id").agg(F.collect_set("name").alias("_bad"))
    joined = answers.join(bad, "answer_id", "left")
    none = F.array().cast("array<string>")
    lines = F.filter(F.split("answer", "\n"), lambda line: ~F.exists(
        F.coalesce("_bad", none), lambda b: F.contains(line, b)))
    return joined.withColumn("answer", F.array_join(lines, "\n")) \
        .withColumn("removed_names", F.coalesce(F.size("_bad"), F.lit(0))).drop("_bad")


# --- result tables ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class CoverRules:
    """When a row, and a table, counts as contained in another one."""

    cell_share: float = 0.9
    row_share: float = 0.95
    min_partial: int = 4


def cell_form(value: str | Column) -> Column:
    """Cell text as compared: lower case, anything but letters, digits and dots as one space."""
    column = F.col(value) if isinstance(value, str) else value
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column.cast("string"), F.lit(""))), "[^a-z0-9.]+", " "))


def _table_rows(cells: DataFrame) -> DataFrame:
    """One row per table row: its non-empty cells in compared form, in sorted order."""
    row = ["answer_id", "table_no", "row_no"]
    return cells.withColumn("c", cell_form("value")).groupBy(*row).agg(
        F.sort_array(F.collect_list(F.when(F.col("c") != "", F.col("c")))).alias("cells"),
        F.bool_and("numeric").alias("numeric"))


def table_coverage(cells: DataFrame, rules: CoverRules = CoverRules()) -> DataFrame:
    """(answer_id, covered, by, rows_covered, rows): how far each table's rows occur in another table of the answer.

    ``cells``: answer_id, table_no, row_no, value, numeric. Equal rows of a table are handled once with their number.
    A row meets only rows sharing its rarest cell in the other table, so frequent cells build no pairs unless nothing
    rarer is shared.
    """
    rows = _table_rows(cells)
    kinds = rows.groupBy("answer_id", "table_no", "cells").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "row_key", F.xxhash64("cells"))
    b = kinds.filter(F.size("cells") > 0).select(
        "answer_id", F.col("table_no").alias("by"), F.col("row_key").alias("b_key"), F.col("cells").alias("b_cells"))
    index = b.select("answer_id", "by", "b_key", F.explode(F.array_distinct("b_cells")).alias("c"))
    frequency = index.groupBy("answer_id", "by", "c").agg(F.count(F.lit(1)).alias("n"))
    a = kinds.select("answer_id", F.col("table_no").alias("covered"), "row_key", "cells", "copies")
    a_cells = a.select("answer_id", "covered", "row_key", F.explode(F.array_distinct("cells")).alias("c"))
    rarest = first_per_group(
        a_cells.join(frequency, ["answer_id", "c"]).filter(F.col("covered") != F.col("by")),
        ["answer_id", "covered", "row_key", "by"], [F.col("n"), F.col("c")]
    ).select("answer_id", "covered", "row_key", "by", "c")
    pairs = rarest.join(index, ["answer_id", "by", "c"]).drop("c")
    pairs = pairs.join(a.select("answer_id", "covered", "row_key", "cells"), ["answer_id", "covered", "row_key"]) \
        .join(b, ["answer_id", "by", "b_key"])
    held = F.filter("cells", lambda c: F.array_contains(F.col("b_cells"), c) | (
        (F.length(c) >= rules.min_partial) & F.exists("b_cells", lambda x: F.contains(x, c))))
    hits = pairs.filter(F.size(held) >= rules.cell_share * F.size("cells")).select(
        "answer_id", "covered", "row_key", "by").distinct()
    return _coverage(rows, a, hits, rules)


def _coverage(rows: DataFrame, a: DataFrame, hits: DataFrame, rules: CoverRules) -> DataFrame:
    """Counts of covered rows for every two tables of an answer."""
    sizes = rows.groupBy("answer_id", "table_no").agg(F.count(F.lit(1)).alias("rows"))
    from_hits = hits.join(a, ["answer_id", "covered", "row_key"]).groupBy("answer_id", "covered", "by").agg(
        F.sum("copies").alias("_hit"))
    empty = a.filter(F.size("cells") == 0).groupBy("answer_id", "covered").agg(F.sum("copies").alias("_empty"))
    first, second = sizes.withColumnRenamed("table_no", "covered"), sizes.select(
        "answer_id", F.col("table_no").alias("by"), F.col("rows").alias("by_rows"))
    # The tables of one answer are few; only table numbers meet here, never their rows.
    table_pairs = first.join(second, "answer_id").filter(F.col("covered") != F.col("by"))
    out = table_pairs.join(from_hits, ["answer_id", "covered", "by"], "left").join(empty, ["answer_id", "covered"], "left")
    total = F.coalesce("_hit", F.lit(0)) + F.coalesce("_empty", F.lit(0))
    return out.select("answer_id", "covered", "by", total.alias("rows_covered"), "rows", "by_rows").withColumn(
        "is_covered", (F.col("rows") <= F.col("by_rows")) & (F.col("rows_covered") >= rules.row_share * F.col("rows")))


def full_coverage(cells: DataFrame, rules: CoverRules = CoverRules()) -> DataFrame:
    """As ``table_coverage``, with every covered row found: also where the rarest shared cell leads to other rows, and
    where no cell is equal but all are part of longer ones."""
    rows = materialised(_table_rows(cells))
    kinds = materialised(rows.groupBy("answer_id", "table_no", "cells").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "row_key", short_digest(F.array_join("cells", "\n"))))
    named = kinds.select(F.col("answer_id").alias("group"), F.col("table_no").alias("table"), "row_key", "cells")
    hits = Containment(named, rules.cell_share, rules.min_partial).covered().withColumnRenamed("group", "answer_id")
    return _coverage(rows, kinds.withColumnRenamed("table_no", "covered"), hits, rules)


def contained_tables(cells: DataFrame, rules: CoverRules = CoverRules(),
                     coverage: Callable[[DataFrame, CoverRules], DataFrame] = table_coverage) -> DataFrame:
    """(answer_id, table_no, kept): which result tables of an answer are worth showing.

    A table inside another one is dropped, of two equal ones the earlier. After that a one-row table of numbers is
    dropped as well, unless nothing would be left.
    """
    cover = coverage(cells, rules).filter("is_covered").select("answer_id", "covered", "by")
    back = cover.select("answer_id", F.col("covered").alias("by"), F.col("by").alias("covered"), F.lit(True).alias("_both"))
    inside = cover.join(back, ["answer_id", "covered", "by"], "left").filter(
        F.col("_both").isNull() | (F.col("by") > F.col("covered")))
    dropped = inside.select("answer_id", F.col("covered").alias("table_no")).distinct().withColumn("_inside", F.lit(True))
    tables = _table_rows(cells).groupBy("answer_id", "table_no").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and("numeric").alias("numeric"))
    marked = tables.join(dropped, ["answer_id", "table_no"], "left").withColumn("_kept", F.col("_inside").isNull())
    summary = (F.col("rows") == 1) & F.col("numeric")
    left = marked.groupBy(F.col("answer_id").alias("_a")).agg(
        F.count_if("_kept").alias("_n"), F.count_if(F.col("_kept") & ~summary).alias("_full"))
    judged = marked.join(left, F.col("answer_id") == F.col("_a"))
    kept = F.col("_kept") & (~summary | (F.col("_n") <= 1) | (F.col("_full") == 0))
    return judged.select("answer_id", "table_no", kept.alias("kept"))


# --- links and cached answers ----------------------------------------------------------------------------------

ANSWER_DAYS = 14


def mentioned_names(answers: DataFrame, table_cells: DataFrame) -> DataFrame:
    """(answer_id, name, position): bold names, then the first text column of the answer's table.

    ``table_cells``: answer_id, row_no, value of that column.
    """
    bold = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(BOLD), F.lit(1))).alias("_p", "name"))
    bold = bold.select("answer_id", F.trim("name").alias("name"), F.col("_p").cast("bigint").alias("position"))
    # Table names come after every bold one of the answer.
    cells = table_cells.select(
        "answer_id", F.col("value").alias("name"), (F.lit(1_000_000_000) + F.col("row_no")).cast("bigint").alias("position"))
    names = bold.unionByName(cells).filter((F.length("name") > 1) & (F.length("name") < 80))
    return names.groupBy("answer_id", "name").agg(F.min("position").alias("position"))


def source_links(mentions: DataFrame, deals: DataFrame) -> DataFrame:
    """Per answer the newest linked deal of every mentioned name."""
    newest_deal = first_per_group(
        deals.filter(F.col("url").isNotNull() & F.col("deal").isNotNull()), ["deal"], [newest("created_time"), oldest("id")]
    ).select(F.col("deal").alias("name"), "url", "status")
    return mentions.select("answer_id", "name").distinct().join(newest_deal, "name")


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column, days: int = ANSWER_DAYS
                 ) -> tuple[DataFrame, DataFrame]:
    """Requests with a reusable answer if there is one, and the cache with its hits counted.

    ``requests``: request_id, key; ``cache``: key, answer, created_at, hits. Requests for one key are counted before
    they meet the cache.
    """
    usable = (F.col("created_at") > as_of - F.make_dt_interval(F.lit(days))) & (F.nullif("answer", F.lit("")).isNotNull())
    found = cache.filter(usable).select("key", F.col("answer").alias("cached_answer"))
    served = requests.join(found, "key", "left").withColumn("cached", F.col("cached_answer").isNotNull())
    asked = requests.groupBy("key").agg(F.count(F.lit(1)).alias("_asked"))
    counted = cache.join(asked, "key", "left").withColumn(
        "hits", F.col("hits") + F.when(usable, F.coalesce("_asked", F.lit(0))).otherwise(0)).drop("_asked")
    return served, counted


def cache_update(cache: DataFrame, answers: DataFrame, downvoted: DataFrame) -> DataFrame:
    """Cache after a batch: verified answers replace their key's entry, answers voted down leave.

    ``answers``: key, answer, created_at, verified; ``downvoted``: answer.
    """
    new = first_per_group(answers.filter("verified"), ["key"], [newest("created_at"), oldest("answer")]).select(
        "key", "answer", "created_at", F.lit(0).cast("bigint").alias("hits"))
    held = cache.select("key", "answer", "created_at", "hits").join(new, "key", "left_anti")
    return held.unionByName(new).join(downvoted.select("answer").distinct(), "answer", "left_anti") \
        .select("key", "answer", "created_at", "hits")
