import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dealweave.functions.order import newest, newest_known, oldest
from dealweave.operators import joins
from dealweave.operators.joins import (
    alias_cascade, alias_map, canonical_name, explode_array, explode_split, join_first, nearest_match, regex_join,
    unpivot_slots, valid_patterns, with_exists, with_in_flag, with_other_owner)
from dealweave.operators.rows import bounded, first_per_group, rank_list, top_k_per, with_group_value


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_order_null_placement(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, x int")
    assert [r.id for r in df.orderBy(newest("x")).collect()] == [1, 3, 2]
    assert [r.id for r in df.orderBy(newest_known("x")).collect()] == [3, 2, 1]
    assert [r.id for r in df.orderBy(oldest("x")).collect()] == [2, 3, 1]


def test_first_per_group_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, None), ("a", 1, "t"), ("b", 1, None)], "k string, p int, title string")
    best = first_per_group(df, ["k"], [oldest("p"), F.col("title").isNull()])
    assert rows(best) == [("a", 1, "t"), ("b", 1, None)]
    assert plan(best).count("WindowGroupLimit") >= 2


def test_top_k_per_and_rank_list(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, v int")
    best = top_k_per(df, ["g"], [F.desc("v")], 2, rank="r")
    assert rows(best.select("g", "v", "r")) == [(0, 24, 2), (0, 27, 1), (1, 25, 2), (1, 28, 1), (2, 26, 2), (2, 29, 1)]
    assert [(r.v, r["rank"]) for r in rank_list(df, [F.desc("v")], 2).collect()] == [(29, 1), (28, 2)]


def test_bounded_says_when_it_cuts(spark):
    df = spark.range(5)
    assert [(r.id, r.truncated) for r in bounded(df, [F.col("id")], 3).orderBy("id").collect()] == [(0, True), (1, True), (2, True)]
    assert {r.truncated for r in bounded(df, [F.col("id")], 5).collect()} == {False}
    assert bounded(df.limit(0), [F.col("id")], 5).count() == 0


def test_group_value_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, v int")
    assert rows(with_group_value(df, ["k"], total=F.sum("v"))) == [("a", 1, 3), ("a", 2, 3), (None, 5, 5)]


def test_exists_and_in_flags(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    other = spark.createDataFrame([("x",), ("x",)], "k string")
    assert rows(with_exists(df, other, ["k"], "f")) == [("x", True), ("y", False), (None, False)]
    assert rows(with_in_flag(df, other, "k", "k", "f")) == [("x", True), ("y", False), (None, None)]
    assert rows(with_in_flag(df, other.limit(0), "k", "k", "f")) == [("x", False), ("y", False), (None, False)]
    with_null = spark.createDataFrame([("x",), (None,)], "k string")
    assert rows(with_in_flag(df, with_null, "k", "k", "f")) == [("x", True), ("y", None), (None, None)]


def test_other_owner_matches_pairs(spark):
    rng = random.Random(3)
    own = [(f"i{rng.randrange(6)}", f"c{rng.randrange(5)}") for _ in range(40)]
    seen = [(f"i{rng.randrange(6)}", f"c{rng.randrange(5)}") for _ in range(8)]
    got = with_other_owner(spark.createDataFrame(own, "i string, c string"), spark.createDataFrame(seen, "i string, c string"), "i", "c", "f")
    want = sorted([(i, c, any(s == i and o != c for s, o in seen)) for i, c in own], key=repr)
    assert rows(got) == want


def test_regex_join_in_one_and_several_blocks(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Red Widget\nnew"), (2, "blue"), (3, None)], "id int, t string")
    patterns = spark.createDataFrame(
        [("r", "^red.*new$"), ("b", "BLUE|green"), ("u", r"\p{L}+ widget"), ("g", "(?P<x>blu)"), ("bad", "("), ("none", None)], "n string, p string")
    good, bad = valid_patterns(patterns.filter("p is not null"), "p")
    assert rows(good.select("n")) == [("b",), ("g",), ("r",), ("u",)] and rows(bad.select("n")) == [("bad",)]
    for size in (1 << 20, 1):
        monkeypatch.setattr(joins, "PATTERN_BLOCK_BYTES", size)
        found = regex_join(texts, "t", patterns, "n", "p")
        assert rows(found.select("id", "n")) == [(1, "r"), (1, "u"), (2, "b"), (2, "g")]
        assert "CartesianProduct" not in plan(found) and "BroadcastNestedLoopJoin" not in plan(found)
    assert joins.required_text(r"\bred (ring)? anvil+ x") == "anvil" and joins.required_text(r"\x41bc|d") == ""
    assert regex_join(texts, "t", patterns.filter("n = 'bad'"), "n", "p").count() == 0


def test_regex_join_pairs_are_made_by_part_outside_python(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART_NAMES", 2, raising=False)
    monkeypatch.setattr(joins, "PARTS_AT_ONCE", 2, raising=False)
    texts = [(1, "red ring"), (1, "red ring"), (2, "red ring"), (3, "blue ring"), (4, "none"), (5, None)]
    patterns = [(f"n{i}", f"red|x{i}") for i in range(5)] + [(None, "ring"), ("twice", "blue"), ("twice", "blue")]
    found = regex_join(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(patterns, "n string, p string"), "n", "p")
    matched = {"red ring": [*[f"n{i}" for i in range(5)], None], "blue ring": [None, "twice", "twice"]}
    assert found.columns == ["id", "t", "n"]
    assert rows(found) == sorted([(i, t, n) for i, t in texts for n in matched.get(t, [])], key=repr)
    # The names of a row were lists in Arrow batches before, too large for a batch where many patterns match many rows.
    assert "MapInArrow" not in plan(found)


@pytest.mark.parametrize("lanes", [1, 2, 50])
def test_regex_join_rows_travel_once_a_lane(spark, monkeypatch, lanes):
    """A row is copied for at most so many lanes, however many parts its text matches; every pair is there once."""
    monkeypatch.setattr(joins, "PART_NAMES", 1)
    monkeypatch.setattr(joins, "PAIR_LANES", lanes)
    texts, patterns = [(i, "red ring" if i % 2 else "blue") for i in range(6)], [(f"n{i}", "red") for i in range(7)] + [("b", "blue")]
    found = regex_join(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(patterns, "n string, p string"), "n", "p")
    assert rows(found) == sorted((i, t, n) for i, t in texts for n, p in patterns if p in t)
    assert "least(_parts#" in plan(found) and f", {lanes})" in plan(found)


def test_nearest_match_equals_brute_force(spark):
    rng = random.Random(5)
    base = dt.date(2020, 1, 1)

    def day():
        return None if rng.random() < 0.2 else base + dt.timedelta(days=rng.randrange(12))

    left = [(i, rng.choice(["a", "b", None, "z"]), day()) for i in range(60)]
    right = [(i, rng.choice(["a", "b", None]), day(), rng.choice([None, 1, 2])) for i in range(40)]
    got = nearest_match(
        spark.createDataFrame(left, "lid int, k string, d date"), spark.createDataFrame(right, "rid int, k string, rd date, made int"),
        "k", "d", "rd", [newest("made"), oldest("rid")], ["rid"])
    zero = dt.date(1900, 1, 1)

    def best(k, d):
        cand = [r for r in right if k is not None and r[1] == k]
        if not cand:
            return None
        return min(cand, key=lambda r: (abs(((d or zero) - (r[2] or zero)).days), (r[3] is not None, -(r[3] or 0)), r[0]))[0]

    assert {r.lid: r.match_rid for r in got.collect()} == {i: best(k, d) for i, k, d in left}


def test_alias_map_and_cascade(spark):
    companies = spark.createDataFrame([("Acme", ["ACME Inc", "beta"]), ("Beta", []), ("acme", ["zed"])], "name string, aliases array<string>")
    mapped = {r.key: r.canonical for r in alias_map(companies).collect()}
    assert mapped == {"acme": "Acme", "acme inc": "Acme", "beta": "Beta", "zed": "acme"}
    named = canonical_name(spark.createDataFrame([("BETA",), ("none",)], "s string"), "s", alias_map(companies), "c")
    assert rows(named) == [("BETA", "Beta"), ("none", "none")]
    values = spark.createDataFrame([("acme",), ("beta",), ("BETA",), ("New Co",), (None,)], "v string")
    resolved, new = alias_cascade(values, "v", companies)
    assert rows(resolved) == [("BETA", "Beta"), ("New Co", "New Co"), ("acme", "acme"), ("beta", "Acme"), (None, None)]
    assert rows(new) == [("New Co",)]


def test_join_first_and_explodes(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 9), ("a", 3)], "k string, v int")
    assert rows(join_first(left, right, "k", [oldest("v")]).select("id", "v")) == [(1, 3), (2, None)]
    lists = spark.createDataFrame([(1, ["x"]), (2, []), (3, None)], "id int, a array<string>")
    assert rows(explode_array(lists, "a", "e").select("id", "e")) == [(1, "x")]
    assert rows(explode_array(lists, "a", "e", "outer").select("id", "e")) == [(1, "x"), (2, None), (3, None)]
    assert rows(explode_array(lists, "a", "e", "default", "?").select("id", "e")) == [(1, "x"), (2, "?"), (3, "?")]
    text = spark.createDataFrame([(1, "a, ;b\n"), (2, None)], "id int, t string")
    assert rows(explode_split(text, "t", "p").select("id", "p")) == [(1, "a"), (1, "b")]


def test_unpivot_slots(spark):
    df = spark.createDataFrame([(1, " A ", None, "", " "), (2, None, None, None, "l")], "id int, n1 string, l1 string, n2 string, l2 string")
    got = unpivot_slots(df, [{"name": "n1", "link": "l1"}, {"name": "n2", "link": "l2"}], keep=("name", "link"))
    assert rows(got) == [(1, 1, "A", None), (2, 2, None, "l")]
