from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from dealweave.functions.sql_text import without_literals
from dealweave.plans.answers import audit_sql


def by_hand(sql: str) -> str:
    """Character by character: one state after another."""
    out, i, n = [], 0, len(sql)
    while i < n:
        before = sql[i - 1] if i else " "
        apart = not (before.isalnum() or before in "_$")
        if sql.startswith("--", i):
            while i < n and sql[i] != "\n":
                i += 1
            out.append(" ")
        elif sql.startswith("/*", i):
            depth, i = 1, i + 2
            while i < n and depth:
                step = {"/*": 1, "*/": -1}.get(sql[i:i + 2], 0)
                depth, i = depth + step, i + (2 if step else 1)
            out.append(" ")
        elif sql[i] in "'\"" or (apart and sql[i] in "eE" and sql[i + 1:i + 2] == "'"):
            escapes = sql[i] in "eE"
            i += escapes
            quote, i = sql[i], i + 1
            while i < n:
                if escapes and sql[i] == "\\":
                    i += 2
                elif sql.startswith(quote * 2, i):
                    i += 2
                elif sql[i] == quote:
                    break
                else:
                    i += 1
            i = min(i + 1, n)
            out.append(quote * 2)
        elif apart and sql[i] == "$" and "$" in sql[i + 1:] and (
                (tag := sql[i + 1:sql.index("$", i + 1)]) == "" or (tag.isidentifier())):
            end = sql.find(f"${tag}$", i + len(tag) + 2)
            i = n if end < 0 else end + len(tag) + 2
            out.append("''")
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(["'", '"', "$$", "$a$", "$", "--", "\n", "/*", "*/", "e", "a", ";", " ", "''", "E'", "\\", "1"]), max_size=14))
def test_scanner_equals_one_by_hand(parts):
    sql = "".join(parts)
    if sql.endswith("\\"):
        sql += " "
    assert without_literals(sql) == by_hand(sql)


def test_probes(spark):
    texts = {
        "select 1 -- it's\n; drop table t -- isn't": True, 'select "a;b" from t': False, "select $$a;b$$": False,
        "select $q$ $$;$$ $q$": False, "select 1 /* a /* b */ ; */": False, "select 1 /* a */ ; /* */ select 2": True,
        r"select e'it\'s;'": False, "select 'never ends ; ": False, None: None,
    }
    df = spark.createDataFrame([(q,) for q in texts], "q string")
    assert {r.q: r.many_statements for r in audit_sql(df, "q", ["copy"]).collect()} == texts
