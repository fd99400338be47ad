from __future__ import annotations

import random
import re

import numpy as np
import pytest

from dealweave.llm import decontaminate


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item, value in items:
        w = words(value)
        size = min(window, len(w))
        for j in range(len(w) - size + 1) if w and item is not None else ():
            for p in range(len(own) - size + 1):
                if own[p:p + size] == w[j:j + size]:
                    hit |= set(range(p, p + size))
                    found.add(item)
    return len(own), len(hit), sorted(found)


def corpus(rng):
    pool = [f"w{i}" for i in range(60)] + ["Été", "漢字", "X1"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([13, 14, 20, 40])))) for i in range(12)]
    items += [(90, "only-three words"), (91, "zebra"), (92, ""), (None, "lost item here"), (93, None), (0, items[1][1])]
    docs = [None, "", "!!", "zebra, ZEBRA", "only three WORDS only three", "lost item here"]
    for _ in range(30):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(40)))]
        text = rng.choice(items[:12])[1]
        a = rng.randrange(8)
        parts.append(rng.choice([text, text.upper().replace(" ", ", "), " ".join(text.split()[a:a + 14]), text[:30]]))
        parts.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(300))))
        docs.append("\n".join(parts))
    return docs + docs[-3:] + [items[0][1] + " " + items[0][1], "pad " * 20000 + items[2][1]], items


@pytest.mark.parametrize("block", [1 << 23, 100])
def test_matches(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts, items = corpus(random.Random(block))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    matched = decontaminate.contaminated(decontaminate.matches(docs, benchmark))
    rows = matched.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_words, n_hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n_words, n_hit, found)
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)
        assert sum(s.end - s.start for s in r.spans) == n_hit
        assert (r.longest > 0) == (n_hit > 0) and r.longest <= max([0, *(s.end - s.start for s in r.spans)])
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.contaminated}


def test_longest_match_reaches_over_windows(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(text.split()[3:25]) + " c")], "doc_id int, text string")
    benchmark = spark.createDataFrame([(5, text)], "item_id bigint, text string")
    row = decontaminate.matches(docs, benchmark).first()
    assert row.longest == 22 and [(s.start, s.end) for s in row.spans] == [(2, 24)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id int, text string")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matches(docs, benchmark).first().n_hit == 0
    assert decontaminate.matches(docs.limit(0), benchmark).count() == 0


def test_suffix_order_and_bounds():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.integers(0, 9, 500)]
    order = decontaminate._sorted_order(keys)
    rows = list(zip(*[k[order].tolist() for k in keys], strict=True))
    assert rows == sorted(rows)
    wanted = [np.array([1, 3, 9]), np.array([2, 0, 0]), np.array([4, 8, 0])]
    sorted_keys = [k[order] for k in keys]
    for i, w in enumerate(zip(*wanted, strict=True)):
        assert decontaminate._bound(sorted_keys, wanted, "left")[i] == sum(r < w for r in rows)
        assert decontaminate._bound(sorted_keys, wanted, "right")[i] == sum(r <= w for r in rows)
