from __future__ import annotations

import random
import re
from collections import Counter

import duckdb

from dealweave.llm import phrase_graph as pg
from dealweave.llm.queries import CHECKS, QUERIES


def brute(rows, min_count, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        counts = f.setdefault(lang or "und", Counter())
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                counts.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= min_count:
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                found.append((p, a, min(cuts)))
        whole = {p: a for p, a, _ in found}
        covered = set()
        for y, b in whole.items():
            for size in range(2, len(y)):
                for i in range(len(y) - size + 1):
                    if y[i:i + size] in whole and 100 * b >= 80 * whole[y[i:i + size]]:
                        covered.add(y[i:i + size])
        best = sorted(((p, a, c) for p, a, c in found if p not in covered), key=lambda x: (-x[2][0], -x[1], " ".join(x[0]).encode()))
        out += [(lang, k + 1, " ".join(p), a, c[2], c[3], n[lang], c[0]) for k, (p, a, c) in enumerate(best[:top])]
    return sorted(out)


def result(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, frame.collect()))


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "of", "a", "é", "x-y", "漢"]
    idioms = ["in spite of", "once upon a time there was", "as soon as", "a a a a a", "new york", "ab ab"]
    rows = []
    for lang in ["en", "de", None, "und"]:
        for _ in range(60):
            words = []
            for _ in range(rng.randrange(25)):
                words.append(rng.choice([rng.choice(common), rng.choice(idioms), f"w{rng.randrange(80)}"]))
                words.append(rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", " ,, ", "\x0b", " "]))
            rows.append((lang, "".join(words).title() if rng.random() < 0.3 else "".join(words)))
    return rows + [("en", None), ("en", ""), ("en", " \n.,"), ("fr", "one"), ("en", " ".join(["long"] * 5000))]


def test_equals_brute_force(spark, monkeypatch):
    for seed, bits, held in [(1, 1 << 25, 300_000), (2, 1 << 15, 20)]:
        monkeypatch.setattr(pg, "BITS", bits)
        monkeypatch.setattr(pg, "PAIR_BITS", bits)
        monkeypatch.setattr(pg, "HELD_WORDS", held)
        monkeypatch.setattr(pg, "HELD_PAIRS", held)
        rows = corpus(seed)
        docs = spark.createDataFrame([(x, t, 0) for x, t in rows], "lang string, text string, Phrase int")
        want = brute(rows, 6)
        assert len(want) > 20 and {r[2].count(" ") for r in want} == {1, 2, 3}
        assert result(pg.collocations(docs, min_count=6)) == want
        assert result(pg.collocations(docs, min_count=6, top=3)) == brute(rows, 6, 3)


def test_flow_and_paths(spark, tmp_path):
    passage = "we hold these truths to be self evident that all men are equal"
    rows = [("en", f"z{i} {passage} q{i}") for i in range(5)] + [("en", "truths to be told"), ("en", "to be")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    words = pg.word_counts(docs)
    edges = pg.graph(docs, words, 1)
    every = Counter()
    for _, t in rows:
        ws = t.split()
        for size in range(1, 5):
            every.update(" ".join(ws[i:i + size]) for i in range(len(ws) - size + 1))
    for size, counts in pg.flow(edges).items():
        assert {r.phrase: r.f for r in counts.collect()} == {p: c for p, c in every.items() if p.count(" ") == size - 1}
    counts, paths = pg.phrase_counts(edges, 2, str(tmp_path))
    # "truths to be" is left in two ways, all other nodes of the passage in one
    assert sorted((" ".join(r.words), r.f) for r in paths.collect()) == [
        ("truths to be self evident that all men are equal", 5), ("we hold these truths to be", 5)]
    for size in range(1, 5):
        assert {r.phrase: r.f for r in counts[size].collect()} == {
            p: c for p, c in every.items() if p.count(" ") == size - 1 and c >= 2}


def test_nodes_travel_as_one_text(spark):
    """Language and words share a column in the shuffle; any language comes back as it was."""
    langs = ["", "1 a", "12", "a\0b", "zh ü", " en", None]
    docs = spark.createDataFrame([(x, "b a\0 c d e") for x in langs for _ in range(2)], "lang string, text string")
    edges = pg.graph(docs, pg.word_counts(docs), 2)
    assert "hashpartitioning(node" in edges._jdf.queryExecution().executedPlan().toString()
    got = {(r.lang, r.head, r["last"], r.c) for r in edges.collect()}
    assert got == {(x or ("und" if x is None else ""), *row) for x in langs for row in [
        ("b a\0 c", "d", 2), ("a\0 c d", "e", 2), ("c d e", None, 2)]}


def test_exact_products_and_empty_tables(spark):
    counts = {1: [("en", "a", 1 << 61), ("en", "b", 1 << 61)], 2: [("en", "a b", (1 << 61) - 1)], 3: [], 4: []}
    frames = {k: spark.createDataFrame(v, "lang string, phrase string, f bigint") for k, v in counts.items()}
    assert pg.scored(frames).collect()[0].score == 2_000_000 * ((1 << 61) - 1) // (1 << 62)
    empty = spark.createDataFrame([], "lang string, text string")
    assert pg.collocations(empty).collect() == []
    docs = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert pg.collocations(docs).collect() == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{folder}/documents.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    want = sorted(con.execute(f"select {columns} from ({CHECKS['op13_phrase_graph']})").fetchall())
    assert result(QUERIES["op13_phrase_graph"](spark, folder)) == want and len(want) > 20
