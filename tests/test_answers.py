from pyspark.sql import functions as F

from dealweave.plans.answers import (
    audit_sql, bold_names, cache_lookup, cache_update, contained_tables, drop_ungrounded, error_class, mentioned_names,
    question_profile, source_links, table_coverage, ungrounded_names)
from tests.test_rows_and_joins import rows


def test_sql_audit(spark):
    queries = ["select 1;", "select 'a;b' -- ;\n", "select 1; drop table x", "delete from t", "with a as (select 1) select * from a",
               "select pg_sleep (1)", "select 'pg_sleep(1)'", "/* ; */ select 1", "  ;; "]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "id int, q string")
    got = {r.id: (r.is_empty, r.many_statements, r.not_a_query, r.blocked_call) for r in audit_sql(df, "q", ["pg_sleep", "copy"]).collect()}
    ok = (False, False, False, False)
    assert got == {0: ok, 1: ok, 2: (False, True, False, False), 3: (False, False, True, False), 4: ok, 5: (False, False, False, True),
                   6: ok, 7: ok, 8: (True, False, True, False)}


def test_question_profile(spark):
    df = spark.createDataFrame([("Which deals? Also who?",), ("count deals",), ("x" * 161,), ("lending pattern",)], "question string")
    got = [(r.parts, r.asks, r.is_complex, r.about_finance) for r in question_profile(df).collect()]
    assert got == [(3, 2, True, False), (0, 0, False, False), (0, 0, True, False), (0, 0, True, True)]


def test_error_class(values):
    assert values([("Incorrect API key",), ("429 quota",), ("boom",), (None,)], "e string", error_class("e")) == ["key", "busy", "other", None]


def test_grounding(spark):
    text = "**Acme (India)** leads\n**Ghost Co** too\n**Scope:** x\n**Top 5**\n**all passed deals here**\n**Asked Inc** ok\n**Ghost Co** again"
    answers = spark.createDataFrame([(1, "about asked inc", text), (2, None, "**Ghost Co**")], "answer_id int, question string, answer string")
    evidence = spark.createDataFrame([(1, "row: ACME | 5"), (2, "ghost co"), (3, "ghost co")], "answer_id int, text string")
    assert rows(bold_names(answers.filter("answer_id = 1")).select("name")) == [("Acme (India)",), ("Asked Inc",), ("Ghost Co",)]
    bad = ungrounded_names(answers, evidence)
    assert rows(bad) == [(1, "Ghost Co")]
    cleaned = {r.answer_id: r for r in drop_ungrounded(answers, bad).collect()}
    assert "Ghost" not in cleaned[1].answer and "Asked Inc" in cleaned[1].answer and cleaned[1].removed_names == 1
    assert cleaned[2].answer == "**Ghost Co**" and cleaned[2].removed_names == 0


def cells(spark, tables, numeric=()):
    data = [(1, t, r, v, (t, c) in numeric or t in numeric) for t, table in tables.items() for r, row in enumerate(table) for c, v in enumerate(row)]
    return spark.createDataFrame(data, "answer_id int, table_no int, row_no int, value string, numeric boolean")


def kept(spark, tables, numeric=()):
    return {r.table_no for r in contained_tables(cells(spark, tables, numeric)).collect() if r.kept}


def test_contained_tables(spark):
    full = [["Swift", "Pass"], ["Zed", "Pass"], ["Amber", "Hold"]]
    assert kept(spark, {1: full[:1], 2: full}) == {2}
    assert kept(spark, {1: full, 2: full}) == {2}
    assert kept(spark, {1: [["Swift", "Pass", "extra"]], 2: full}) == {1, 2}
    assert kept(spark, {1: [["swift!", "pass"]], 2: [["Swift Labs", "Pass"]]}) == {2}
    assert kept(spark, {1: [["swi", "Pass"]], 2: [["swift", "Pass"]]}) == {1, 2}
    assert kept(spark, {1: [["42"]], 2: full}, numeric={1}) == {2}
    assert kept(spark, {1: [["42"]]}, numeric={1}) == {1}
    assert kept(spark, {1: [["42"]], 2: [["43"]]}, numeric={1, 2}) == {1, 2}
    assert kept(spark, {1: [["", None]], 2: full}) == {2}


def test_coverage_share(spark):
    a = [[f"name{i}", "x"] for i in range(20)]
    b = a[:19] + [["other", "y"]]
    got = {(r.covered, r.by): (r.rows_covered, r.is_covered) for r in table_coverage(cells(spark, {1: a, 2: b})).collect()}
    assert got[(1, 2)] == (19, True) and got[(2, 1)] == (19, True)


def test_source_links(spark):
    answers = spark.createDataFrame([(1, "**A** and **B** and **X**")], "answer_id int, answer string")
    table = spark.createDataFrame([(1, 1, "C"), (1, 41, "D"), (1, 2, "q" * 90)], "answer_id int, row_no int, value string")
    deals = spark.createDataFrame(
        [("1", "A", "old", "Pass", "2020"), ("2", "A", "new", "Pass", "2021"), ("3", "B", None, "Pass", "2020"), ("4", "C", "c", None, "2020"), ("5", "D", "d", None, "2020")],
        "id string, deal string, url string, status string, created_time string")
    names = mentioned_names(answers, table)
    assert {r.name for r in names.collect()} == set()  # one-letter names are too short
    longer = deals.withColumn("deal", F.concat("deal", F.lit("co")))
    names = mentioned_names(answers.withColumn("answer", F.lit("**Aco** and **Bco** and **Xco**")), table.withColumn("value", F.concat("value", F.lit("co"))))
    links = source_links(names, longer).select("answer_id", "name", "url", "status")
    assert rows(links) == [(1, "Aco", "new", "Pass"), (1, "Cco", "c", None), (1, "Dco", "d", None)]


def test_answer_cache(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([("k1", "a1", "2024-01-25", 2), ("k2", "a2", "2024-01-01", 0), ("k3", "", "2024-01-25", 0)], "key string, answer string, d string, hits bigint") \
        .select("key", "answer", F.col("d").cast("timestamp").alias("created_at"), "hits")
    asked = spark.createDataFrame([(1, "k1"), (2, "k1"), (3, "k2"), (4, "k3"), (5, "new")], "request_id int, key string")
    served, counted = cache_lookup(asked, cache, now)
    assert rows(served.select("request_id", "cached_answer")) == [(1, "a1"), (2, "a1"), (3, None), (4, None), (5, None)]
    assert rows(counted.select("key", "hits")) == [("k1", 4), ("k2", 0), ("k3", 0)]
    new = spark.createDataFrame([("k2", "b", True), ("k9", "c", False)], "key string, answer string, verified boolean").withColumn("created_at", now)
    down = spark.createDataFrame([("a1",)], "answer string")
    assert rows(cache_update(counted, new, down).select("key", "answer", "hits")) == [("k2", "b", 0), ("k3", "", 0)]
