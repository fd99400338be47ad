from __future__ import annotations

import random

import duckdb
import pytest

from dealweave.llm import cover_windows as cw
from dealweave.llm.queries import CHECKS, QUERIES


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), ws in zip(rows, words, strict=True):
        for p in range(len(ws) - window + 1):
            key, place = tuple(ws[p:p + window]), (i is None, i or 0, p)
            first[key] = min(first.get(key, place), place)
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p:p + window])] < (i is None, i or 0, p):
                gone |= set(range(p, p + window))
        out.append((i if i is not None else -1, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out)


def result(frame):
    rows = frame.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in rows)


def corpus(seed, window):
    rng = random.Random(seed)

    def noise(n):
        return [rng.choice(["a", "b", "c", "É", "漢", "x y"]) for _ in range(n)]

    passages = [noise(rng.choice([window - 1, window, window + 1, 3 * window])) for _ in range(6)]
    texts = [None, "", " \t\n", "one", " ".join(noise(window - 1)), " ".join(["a"] * (4 * window)), " ".join(["a", "b"] * window)]
    for _ in range(40):
        made = []
        for _ in range(rng.randrange(1, 6)):
            made += rng.choice([noise(rng.randrange(12)), rng.choice(passages)])
        texts.append(rng.choice([" ", "\n ", "\x0b"]).join(made))
    whole = noise(90)
    texts += [" ".join(whole)] * 6 + [" ".join(whole[:40] + ["#"] + whole[41:])]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("window, period", [(7, 4), (20, 13), (5, 1), (9, 7)])
@pytest.mark.parametrize("block, part", [(2 << 20, 16 << 20), (300, 400)])
def test_equals_brute_force(spark, monkeypatch, window, period, block, part):
    monkeypatch.setattr(cw, "BLOCK_BYTES", block)
    monkeypatch.setattr(cw, "PART_BYTES", part)
    rows = corpus(window + block, window)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, N_Words int")
    assert result(cw.remove_windows(docs, window=window, period=period)) == brute(rows, window)


def test_difference_covers():
    assert cw.difference_cover(13) == [0, 1, 3, 9]
    for v in (1, 2, 7, 16, 31, 64):
        cover = cw.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_null_ids_repeated_rows_ties_and_empty_tables(spark):
    text = "p q r s t u v w"
    rows = [(3, text), (3, text), (None, text), (None, "z " + text), (9, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(cw.remove_windows(docs, window=6, period=3)) == brute(rows, 6)
    assert [r[2] for r in brute(rows, 6)] == [8, 8, 0, 0, 8]
    assert cw.remove_windows(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        cw.remove_windows(docs, window=5, period=5)
    with pytest.raises(TypeError):
        cw.remove_windows(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_a_text_far_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(cw, "BLOCK_BYTES", 1000)
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(200_000))
    rows = [(1, long), (2, long[700_000:]), (3, long[:5000] + "x")]
    assert result(cw.remove_windows(spark.createDataFrame(rows, "doc_id int, text string"))) == brute(rows, 20)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{folder}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({CHECKS['op11_cover_windows']})").fetchall())
    got = QUERIES["op11_cover_windows"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want
    assert sum(r[2] for r in want) > 0
