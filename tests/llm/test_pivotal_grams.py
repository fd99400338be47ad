from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dealweave.llm import pivotal_grams as pg
from dealweave.llm.queries import QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows, min_chars=5, min_count=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_chars and c >= min_count}
    # two words one edit apart have a common string with one code point less, or one has it itself
    by = {}
    for w in n:
        for s in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(s, set()).add(w)
    near = {w: {x for s in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for x in by[s] if one_edit(w, x)} for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def result(frame):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect()), key=lambda r: r[0])


def test_equals_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdeéß×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 10))) for _ in range(120)] + ["aaaaa", "aaaaaa", "ababab", "bababa"]
    texts = [None, "", " \n", "1234 !!"]
    for _ in range(200):
        words = []
        for _ in range(rng.randrange(40)):
            w = base[int(len(base) * rng.random() ** 3)]
            k = rng.randrange(len(w))
            w = rng.choice([w] * 5 + [w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        texts.append(rng.choice([" ", ", ", "1"]).join(words))
    texts.append(" ".join(["mnopq"] * 3 + ["mnopr"] * 7 + ["mnotr"] * 20))  # a chain of forms
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (9, texts[9])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, Word int")
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    assert result(pg.variants(docs)) == want
    assert pg.variants(docs.limit(0)).collect() == []


def test_ties_take_the_smallest_form(spark):
    text = " ".join(["abcdef"] * 3 + ["abcdeg"] * 6 + ["abcdeé"] * 6 + ["abcdea"] * 5)
    rows = [(1, text)]
    got = {r[0]: r[1:] for r in result(pg.variants(spark.createDataFrame(rows, "doc_id int, text string")))}
    assert got == {r[0]: r[1:] for r in brute(rows)}
    assert got["abcdef"][0] == "abcdeg"


@settings(max_examples=2000, deadline=None)
@given(st.text("abc", min_size=4, max_size=9), st.text("abc", min_size=4, max_size=9), st.integers(0, 9))
def test_a_pivot_of_one_meets_the_prefix_of_the_other(a, b, salt):
    """Without Spark: near words share a look-up key, whatever the order of the bigrams."""
    pivots = pg.Pivots(np.random.default_rng(salt).integers(0, 4, pg.CLASSES))
    prefix, left, right, _ = pivots.of(a)
    assert {left, right} <= set(prefix) and right - left >= 2 and len(prefix) >= 3
    if one_edit(a, b):
        meets = []
        for x, y in ((a, b), (b, a)):
            (asked, low), (held, high) = pg.look_ups(x, pivots), pg.index_keys(y, pivots)
            meets.append(low <= high and bool(set(asked) & set(held)))
        assert any(meets)


def test_the_index_is_not_broadcast(spark, monkeypatch):
    """A word makes many keys, but Spark sizes them as one row a word; so a few MB of words became GB on the driver."""
    plans = []
    kept = pg.stored
    monkeypatch.setattr(pg, "stored", lambda df, folder=None: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or kept(df, folder))
    words = kept(spark.createDataFrame([(w, 3) for w in ("abcdef", "abcdeg", "abcde", "xyzxyz")], "word string, n bigint"))
    assert {(r.word, r.near) for r in pg.near_words(words).collect()} == {
        (a, b) for a in ("abcdef", "abcdeg", "abcde") for b in ("abcdef", "abcdeg", "abcde") if a != b}
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert len(want) > 200
    assert result(QUERIES["op12_spelling_variants"](spark, folder)) == want
