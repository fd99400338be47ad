"""Covered rows against every row tried with every row."""

import random

import pytest
from pyspark.sql import functions as F

from dealweave.operators.containment import Containment, cell_holders, window_hashes
from dealweave.plans.answers import contained_tables, full_coverage
from tests.test_answers import cells


def table_rows(spark, tables):
    """``tables``: {(group, table): rows}; equal rows once, as callers pass them."""
    data = {(g, t, "|".join(sorted(row)), tuple(sorted(row))) for (g, t), rows in tables.items() for row in rows}
    return spark.createDataFrame([(g, t, k, list(row)) for g, t, k, row in data],
                                 "group int, table int, row_key string, cells array<string>")


def holds(cell, row):
    return any(cell == x or (len(cell) > 3 and cell in x) for x in row)


def by_force(tables):
    out = set()
    for (g, t), rows in tables.items():
        for (h, by), others in tables.items():
            if g == h and t != by:
                for row in rows:
                    if row and any(10 * sum(holds(c, o) for c in row) >= 9 * len(row) for o in others):
                        out.add((g, t, "|".join(sorted(row)), by))
    return out


def found(work):
    return {tuple(r) for r in work.covered().select("group", "covered", "row_key", "by").collect()}


@pytest.mark.parametrize("crowded", [0, 64])
def test_against_brute_force(spark, crowded):
    rng = random.Random(crowded)
    words = ["a", "bc", "swift", "swift labs", "amber swift labs", "labs", "12", "1234", "12345", "x" * 33, "y" + "x" * 40, "lab"]
    def row():
        size = rng.choice([0, 1, 1, 2, 3, 4, 9, 10, 11, 20])
        return [rng.choice(words[:rng.choice([4, 12])]) for _ in range(size)]
    tables = {(g, t): [row() for _ in range(rng.randrange(1, 14))] for g in range(6) for t in range(4)}
    want = by_force(tables)
    assert len(want) > 100
    assert found(Containment(table_rows(spark, tables), crowded=crowded)) == want


@pytest.mark.parametrize("small", [0, 30, 512])
def test_small_groups_are_brought_together(spark, small):
    """Groups of few cells are compared where they lie; with none larger, nothing is looked up by windows."""
    rng = random.Random(3)
    words = ["a", "bc", "swift", "swift labs", "amber swift labs", "labs", "12", "1234", "12345", "lab"]
    tables = {(g, t): [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 10]))] for _ in range(rng.randrange(1, 3 + g))]
              for g in range(6) for t in range(3)}
    work = Containment(table_rows(spark, tables), small_cells=small)
    assert found(work) == by_force(tables) and work.any_large == (small < 512)
    assert ("held" in vars(work)) == (small < 512)
    if small == 512:
        plan = work.covered()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the rows by group


def test_repeats_and_a_spare_cell(spark):
    """Nine repeats of one cell are enough of ten; a row of twenty may miss two."""
    many = [f"cell{i:02d}" for i in range(20)]
    tables = {(1, 1): [["x"] * 9 + ["y"], many, many[:18] + ["q1", "q2"], many[:17] + ["q1", "q2", "q3"]],
              (1, 2): [["x", "z"], many[::-1] + ["more"]]}
    got = {k for g, t, k, by in found(Containment(table_rows(spark, tables), crowded=0)) if t == 1}
    assert got == {"|".join(sorted(r)) for r in tables[1, 1][:3]}


def test_holders_of_long_cells(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab c.1") for _ in range(2500))
    parts = [long[995:1010], long[:4], long[2400:], long[1990:2100], "nowhere", long[1:2499]]
    data = spark.createDataFrame([(1, c) for c in {*parts, long}] + [(2, parts[0])], "g int, cell string")
    want = {(1, p, w) for p in {*parts, long} for w in {*parts, long} if p != w and p in w}
    assert {tuple(r) for r in cell_holders(data, ["g"]).collect()} == want
    got = spark.createDataFrame([(long,), ("abc",), ("",)], "c string").select(F.size(window_hashes(F.col("c"), F.lit(8)))).collect()
    assert [r[0] for r in got] == [2493, 0, 0]


def test_frequent_cells_build_no_pairs_of_rows(spark):
    """Rows of few different values: one table repeats the other with a column more; the pairs grow with the rows."""
    def work(n):
        rows = [[f"s{i % 8}", f"t{i // 8 % 8}", f"u{i // 64}"] for i in range(n)]
        return Containment(table_rows(spark, {(1, 1): rows, (1, 2): [[*r, f"id {i}"] for i, r in enumerate(rows)]}), crowded=4)
    for n in (256, 512):
        w = work(n)
        equal = w.equal_sets()
        assert equal.count() == n and w.candidates(equal).count() == 0
        assert sum(t == 1 for _, t, _, _ in found(w)) == n


def test_equal_cells_with_a_missing_partner(spark):
    """Rows without an equal set are paired by two cells, far fewer than all with all."""
    rows = [[f"s{i % 16}", f"t{i // 16}"] for i in range(256)]
    others = [[*r, f"u{i % 3}"] for i, r in enumerate(rows)]
    asked = [[*r, f"u{(i + 1) % 3}"] for i, r in enumerate(rows)]
    w = Containment(table_rows(spark, {(1, 1): asked, (1, 2): others}), crowded=4)
    equal = w.equal_sets()
    assert equal.count() == 0
    assert w.candidates(equal).count() <= 6 * len(rows)  # 65,536 by all with all
    assert found(w) == set()


def test_rows_go_by_short_keys(spark, monkeypatch):
    """Keys and digests of rows travel through every step: 16 bytes each, not texts of 64 letters."""
    seen = []
    monkeypatch.setattr("dealweave.plans.answers.Containment", lambda kinds, *a: seen.append(kinds) or Containment(kinds, *a))
    assert contained_tables(cells(spark, {1: [["x"]], 2: [["x"]]}), coverage=full_coverage).count() == 2
    assert {len(r.row_key) for r in seen[0].collect()} == {16}


def test_tables_worth_showing(spark):
    full = [["Swift", "Pass"], ["Zed", "Pass"], ["Amber", "Hold"]]
    def kept(tables, numeric=()):
        got = contained_tables(cells(spark, tables, numeric), coverage=full_coverage).collect()
        return {r.table_no for r in got if r.kept}
    assert kept({1: full[:1], 2: full}) == {2}
    assert kept({1: full, 2: full}) == {2}
    assert kept({1: [["swif", "zzz"]], 2: [["Swift", "Pass"]]}) == {1, 2}
    assert kept({1: [["swif"]], 2: [["Swift", "Pass"]]}) == {2}  # no cell is equal, one is a part
    assert kept({1: [["42", "7"]], 2: full}, numeric={1}) == {2}
    assert kept({1: [["42"]], 2: [["43"]]}, numeric={1, 2}) == {1, 2}
    assert kept({1: [["", None]], 2: full}) == {2}
    # the rarest shared cell leads to another row, the covering one is found nevertheless
    assert kept({1: [["swift", "rare"]], 2: [["swift", "rares"], ["rare", "other"], ["swift", "x"]]}) == {2}
    none = cells(spark, {1: full}).limit(0)
    assert contained_tables(none, coverage=full_coverage).count() == 0
