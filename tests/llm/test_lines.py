from __future__ import annotations

import random
import re
from collections import Counter

from dealweave.llm.common import shared_folder
from dealweave.llm.line_runs import LineRuns, drop_common_lines


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(texts, min_docs):
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if found[key(x)] < min_docs or not key(x)]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_common_lines(spark):
    rng = random.Random(4)
    pool = ["Menu", " menu\t", "MENU\r", "É", "é", "", " ", "\x0b", "\x1cmenu", "Footer text", "footer TEXT ", *(f"line {i}" for i in range(40))]
    texts = [None, "", "\n", "menu", "x" * 100_000 + "\nmenu"]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(80)] + ["menu\nfooter text\nown"] * 25
    rows = [(i, t, "old", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kept_text string, a int")
    for fanout, batches in ((2, 5), (4, 1)):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in drop_common_lines(
            docs, batches=batches, fanout=fanout).collect()}
        assert got == dict(enumerate(brute(texts, 10)))
    twice = drop_common_lines(docs.union(docs), min_docs=20).where("a = doc_id")
    assert sorted((r.doc_id, r.n_dropped) for r in twice.collect()) == sorted(
        2 * [(i, x[1]) for i, x in enumerate(brute(texts + texts, 20)[:len(texts)])])
    assert drop_common_lines(docs.limit(0)).count() == 0


def test_runs_are_levelled_and_settled_keys_stay_out(spark):
    runs = LineRuns(spark, shared_folder(spark), min_docs=3, fanout=2)
    for batch in range(4):
        runs.add(spark.createDataFrame([(1, 1)] * 3 + [(2, batch)], "a bigint, b bigint"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(1, 1)]
    assert runs._read(runs.levels[2]).where("a = 1").first()["n"] == 3


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id int, text string")
    plan = drop_common_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
