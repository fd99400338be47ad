from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dealweave.llm import suffix_dedup as sd


def brute(texts, length):
    found = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if found[t[i:i + length]] > 1:
                gone |= set(range(i, i + length))
        spans = [i for i in sorted(gone) if i - 1 not in gone]
        out.append((len(t), len(gone), len(spans), bytes(b for i, b in enumerate(t) if i not in gone)))
    return out


def corpus(rng, alphabet="abcd "):
    def noise(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    passages = [noise(rng.choice([19, 20, 21, 30, 64])) for _ in range(8)]
    texts = [None, "", "x", noise(19), "a" * 60, "ab" * 30, "é" * 30]
    for _ in range(40):
        texts.append("".join(rng.choice([noise(rng.randrange(30)), rng.choice(passages)]) for _ in range(rng.randrange(1, 7))))
    whole = noise(150)
    return texts + [whole] * 5 + [whole[:70] + "#" + whole[71:], whole[3:90], "漢字かな" * 9]


@pytest.mark.parametrize("together", [128, 1])
@pytest.mark.parametrize("block", [6 << 20, 300])
def test_removed_bytes(spark, monkeypatch, together, block):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    monkeypatch.setattr(sd, "SEGMENT", 1 << 20 if block > 300 else 11)
    monkeypatch.setattr(sd, "SORT_BYTES", 200)
    monkeypatch.setattr(sd, "PIECE", 4)
    texts = corpus(random.Random(block + together))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, kept string")
    want = brute([(t or "").encode() for t in texts], 20)
    got = sd.remove_repeats(docs, length=20, gram=6, together=together).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want[r.doc_id], texts[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_null_ids_repeated_rows_and_empty_table(spark):
    schema = "doc_id int, text string"
    docs = spark.createDataFrame([(None, "q" * 14 + "once"), (1, "abcdefghijklmnopqr"), (1, "abcdefghijklmnopqr")], schema)
    got = sorted((r.doc_id or -1, r.n_removed) for r in sd.remove_repeats(docs, length=16, gram=4).collect())
    assert got == [(-1, 0), (1, 18), (1, 18)]
    assert sd.remove_repeats(docs.limit(0), length=16, gram=4).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.text("ab", min_size=8, max_size=8), st.integers(0, 2)), min_size=1, max_size=40))
def test_sorted_repeats(rows):
    data = np.frombuffer("".join(t for t, _ in rows).encode(), np.uint8)
    starts = np.arange(len(rows)) * 8
    groups = np.array([g for _, g in rows])
    counts = Counter(rows)
    assert sd.sorted_repeats(data, starts, groups, 8).tolist() == [counts[r] > 1 for r in rows]


def test_collisions_are_told_apart(monkeypatch):
    class Blind(sd.PrefixHashes):
        def of(self, start, size):
            return super().of(start, size) & np.uint64(1)

    monkeypatch.setattr(sd, "PrefixHashes", Blind)
    rng = random.Random(2)
    rows = ["".join(rng.choice("abc") for _ in range(4)) for _ in range(60)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    got = sd.sorted_repeats(data, np.arange(60) * 4, np.zeros(60, np.int64), 4)
    counts = Counter(rows)
    assert not any(g and counts[r] == 1 for g, r in zip(got.tolist(), rows, strict=True))


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_spans_cover_every_string(segment):
    rng = np.random.default_rng(3)
    sizes = np.array([50, 0, 3, 200, 20, 19])
    data = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
    _, place, start, more = sd.spans_of(data, sizes, 20, 6, segment)
    covered = sorted(s + k for s, m in zip(start, more, strict=True) for k in range(m + 1))
    ends = np.cumsum(sizes)
    assert covered == [i for i in range(sizes.sum()) if any(e - n <= i and i + 20 <= e for e, n in zip(ends, sizes, strict=True))]
    assert all(s + m <= p <= s + 14 for p, s, m in zip(place, start, more, strict=True))
