import random
import statistics
from decimal import Decimal

from pyspark.sql import functions as F

from dealweave.operators.lists import (
    breakdown, distinct_array, distinct_join, latest_by, list_parts, ordered_join, pivot_slots, shortest)
from dealweave.operators.merge import apply_patches, finish_documents, merge_documents, prune_stale, upsert, vector_table
from dealweave.operators.quantiles import exact_median
from dealweave.sources.entities import apply_overrides, load_entities
from tests.test_rows_and_joins import rows

def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def test_texts_of_groups(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("a", 3, None), ("b", 1, None)], "k string, o int, v string")
    got = df.groupBy("k").agg(ordered_join("v", ["o"]), distinct_join("v", "; "), distinct_array("v", F.col("o") > 1))
    assert rows(got) == [("a", "z, y", "y; z", ["y"]), ("b", None, None, [])]


def test_latest_and_shortest(spark):
    df = spark.createDataFrame(
        [("a", 1, "2020-01-01", "old"), ("a", 2, "2021-01-01", None), ("b", 1, None, "x"), ("b", 2, None, "y")], "k string, id int, d string, v string")
    got = df.groupBy("k").agg(latest_by("v", "d", "id"))
    assert rows(got) == [("a", None), ("b", "y")]
    assert spark.createDataFrame([("bb",), ("c",), ("a",)], "v string").agg(shortest("v")).first()[0] == "a"


def test_list_parts_keeps_every_value_of_a_wide_group(spark):
    df = spark.createDataFrame([("hot", f"v{i:03d}") for i in range(500)] * 2 + [("small", "a"), (None, "n")], "k string, v string")
    got = list_parts(df, ["k"], "v", "vs", part_items=50).collect()
    hot = [r for r in got if r.k == "hot"]
    assert sorted(r.part for r in hot) == list(range(10)) and {len(r.vs.split(", ")) for r in hot} == {50}
    values = [v for r in hot for v in r.vs.split(", ")]
    assert sorted(values) == sorted(f"v{i:03d}" for i in range(500))
    assert [(r.part, r.vs) for r in got if r.k == "small"] == [(0, "a")]
    assert [(r.part, r.vs) for r in got if r.k is None] == [(0, "n")]


def test_breakdown_and_pivot(spark):
    df = spark.createDataFrame([("c", "s1", 1), ("c", "s1", 1), ("c", "s2", 2), ("c", "s2", 3), ("c", "s0", 4)], "c string, s string, id int")
    assert breakdown(df, ["c"], "s", "id", "t").first().t == "s2 2, s0 1, s1 1"
    slots = spark.createDataFrame([("d", 1, "A"), ("d", 4, "B")], "d string, slot int, n string")
    assert rows(pivot_slots(slots, ["d"], "slot", {"n": "n"})) == [("d", "A", None, None, "B")]


def test_exact_median_equals_statistics(spark):
    rng = random.Random(11)
    data = [(g, None if rng.random() < 0.1 else Decimal(rng.randrange(-10**9, 10**12)) / 100) for g in ("a", "b", None) for _ in range(rng.choice([30, 31]))]
    data += [("one", Decimal("5.25")), ("empty", None)]
    got = {r.g: r.m for r in exact_median(spark.createDataFrame(data, "g string, v decimal(18,2)"), ["g"], "v", "m").collect()}
    want = {g: float(statistics.median([v for k, v in data if k == g and v is not None])) for g in ("a", "b", None, "one")}
    assert {k: round(v, 4) for k, v in got.items()} == {k: round(v, 4) for k, v in want.items()}


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "id int, v string")
    assert rows(upsert(old, batch, "id", [F.desc("v")])) == [(1, "a"), (2, "y"), (3, "z")]


def test_prune_guard(spark):
    def run(fresh, stale):
        df = spark.createDataFrame([("s",)] * fresh + [("old",)] * stale, "stamp string")
        kept, report = prune_stale(df, "stamp", "s")
        r = report.first()
        return kept.count(), r.pruned, r.removed

    assert run(8, 2) == (8, True, 2)
    assert run(7, 3) == (10, False, 0)
    assert run(0, 3) == (3, False, 0)
    assert run(100, 33) == (133, False, 0)  # a quarter of the ids replaced: held back for this run


def test_patches(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    patches = spark.createDataFrame([(1, {"x": "  ", "zz": "q"}), (9, {"x": "1"})], "id int, changes map<string,string>")
    out, unmatched = apply_patches(df, patches, "id", ["x", "y"])
    assert rows(out) == [(1, None, "b"), (2, "c", "d")]
    assert rows(unmatched.select("id")) == [(9,)]
    several = spark.createDataFrame([(2, {"x": "first", "y": "kept"}, 1), (2, {"x": "last"}, 2)], "id int, changes map<string,string>, n int")
    assert rows(apply_patches(df, several, "id", ["x", "y"], "n")[0]) == [(1, "a", "b"), (2, "last", "kept")]


def documents(spark, items):
    df = spark.createDataFrame(items, "id string, kind string, title string, body string, metadata string")
    return finish_documents(df)


def stored(spark, items):
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return documents(spark, items).withColumn("embedding", F.array(F.lit(1.0).cast("float"))).withColumn(
        "updated_at", moment).withColumn("embedded_at", moment)


def test_merge_documents(spark):
    old = stored(spark, [
        ("same", "k", "t", "b", "{}"), ("text", "k", "t", "b", "{}"), ("meta", "k", "t", "b", "{}"), ("gone", "k", "t", "b", "{}"),
        ("kept", "insight", "t", "b", "{}"), ("blank", "k", None, "b", None)])
    new = documents(spark, [
        ("same", "k", "t", "b", "{}"), ("text", "k", "t", "B", "{}"), ("meta", "k", "t", "b", '{"a":1}'), ("new", "k", "", None, None),
        ("blank", "k", "", "b", "{}")])
    state, changes = merge_documents(old, new, as_of(), ["insight"])
    assert {r.change: r.documents for r in changes.collect()} == {
        "unchanged": 2, "update": 2, "insert": 1, "delete": 1, "protected": 1}
    got = {r.id: (r.embedding is not None, r.updated_at.month) for r in state.collect()}
    assert got == {"same": (True, 1), "text": (False, 2), "meta": (True, 2), "new": (False, 2), "kept": (True, 1), "blank": (True, 1)}
    assert {r.id for r in vector_table(state).collect()} == {"same", "meta", "kept", "blank"}


def test_merge_by_written_ids(spark, tmp_path):
    """With a folder only the ids on both sides meet; repeated and null ids give the rows of the full join."""
    old = stored(spark, [("both", "k", "t", "b", "{}"), ("both", "j", "t", "b", "{}"), (None, "insight", "t", "b", "{}"), (None, "k", "x", "y", "{}"),
                         ("gone", "k", "t", "b", "{}"), ("kept", "insight", "t", "b", "{}")])
    new = documents(spark, [("both", "k", "t", "b", "{}"), ("both", "k", "t", "B", "{}"), (None, "k", "t", "b", "{}"), ("new", "k", "a", "b", "{}")])
    new.write.parquet(f"{tmp_path}/new")
    new = spark.read.parquet(f"{tmp_path}/new")
    for kinds in ([], ["insight"]):
        (state, changes), (by_ids, counted) = merge_documents(old, new, as_of(), kinds), merge_documents(old, new, as_of(), kinds, f"{tmp_path}/kept")
        assert by_ids.schema.simpleString() == state.schema.simpleString()
        assert sorted(map(str, by_ids.collect())) == sorted(map(str, state.collect()))
        assert sorted(map(str, counted.collect())) == sorted(map(str, changes.collect()))


def test_merge_moves_no_text_of_inserted_documents(spark, tmp_path):
    documents(spark, [(f"n{i}", "k", "t", f"text {i}", "{}") for i in range(20)]).write.parquet(f"{tmp_path}/new")
    new = spark.read.parquet(f"{tmp_path}/new")
    state, _ = merge_documents(stored(spark, [("kept", "insight", "t", "b", "{}"), ("gone", "k", "t", "b", "{}")]), new, as_of(), ["insight"], f"{tmp_path}/kept")
    written = [spark.read.parquet(str(p)) for p in (tmp_path / "kept").iterdir()]
    assert [df.count() for df in written if "body" in df.columns] == [1]
    assert "Exchange hashpartitioning" not in state._jdf.queryExecution().executedPlan().toString()
    assert state.count() == 21
    assert all("zstd" in p.name for p in (tmp_path / "kept").glob("*/part-*.parquet"))


def test_list_parts_of_small_and_large_groups(spark):
    """Groups that fit a part are brought together at once, others by ranges; null keys are groups as well."""
    data = [(k, f"v{i}") for k, n in (("s", 3), ("t", 5), (None, 4), ("l", 23)) for i in range(n)] * 2 + [("s", None)]
    for size in (5, 100):
        got = list_parts(spark.createDataFrame(data, "k string, v string"), ["k"], "v", "vs", part_items=size).collect()
        by = {}
        for r in got:
            by.setdefault(r.k, []).append((r.part, r.vs.split(", ")))
        assert {k: sorted(p for p, _ in x) for k, x in by.items()} == {"s": [0], "t": [0], None: [0], "l": list(range(-(-23 // size)))}
        assert all(v == sorted(v) and len(v) <= size for x in by.values() for _, v in x)
        assert {k: sorted(y for _, v in x for y in v) for k, x in by.items()} == {k: sorted({v for j, v in data if j == k and v}) for k in by}


def test_merge_twice_changes_nothing(spark):
    new = documents(spark, [("a", "k", "t", "b", "{}"), ("b", "k", "t2", "b2", "{}")])
    first, _ = merge_documents(stored(spark, [("a", "k", "x", "y", "{}")]), new, as_of())
    again, changes = merge_documents(first, new, as_of())
    assert {r.change: r.documents for r in changes.collect()} == {"unchanged": 2}
    assert rows(again.select("id", "content_hash")) == rows(new.select("id", "content_hash"))


def test_entity_labels(spark):
    batch = spark.createDataFrame([('[["n","e",null,"t","d","verified","high",null,"","7"],["m"]]',)], "rows string")
    got = {r.name: (r.entity, r.parent_group, r.cluster) for r in load_entities(batch).collect()}
    assert got == {"n": ("e", None, 7), "m": (None, None, None)}


def test_overrides(spark):
    entities = spark.createDataFrame([("a", "A", "loaded"), ("b", "B", "loaded")], "name string, entity string, confidence string").withColumn(
        "status", F.lit("probable"))
    edits = spark.createDataFrame(
        [(1, " a ", "save", "verified", "A1"), (2, "a", "save", "verified", " "), (3, "b", "delete", None, None), (4, "c", "save", "bad", "C"),
         (5, "d", "save", "not_found", "D"), (6, " ", "save", "verified", "E")],
        "no int, name string, action string, status string, entity string")
    for column in ("parent_group", "entity_type", "domain", "note"):
        edits = edits.withColumn(column, F.lit(None).cast("string"))
    out, rejected = apply_overrides(entities, edits, [F.desc("no")])
    assert rows(out) == [("a", None, "manual", "verified"), ("d", "D", "manual", "not_found")]
    assert rows(rejected.select("no")) == [(4,), (6,)]
