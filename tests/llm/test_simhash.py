from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from dealweave.llm import simhash
from dealweave.llm.common import shared_folder


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


@given(st.text(alphabet="aBé \n\x0b\x1c ", max_size=60))
def test_fingerprint_of_any_text(text):
    got = simhash._fingerprint(text.encode().lower().split(), 4, 42)
    assert got % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("paired", [1000, 3])
def test_links_of_random_fingerprints(spark, paired):
    rng = random.Random(paired)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        values.add(center)
        for _ in range(12):
            near = center
            for _ in range(rng.randrange(1, 7)):
                near ^= 1 << rng.randrange(64)
            values.add(near)
    fps = sorted(values)
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(rows, shared_folder(spark), paired).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    joined = {f: i for i, f in enumerate(fps)}
    for _ in fps:
        for a, b in got:
            joined[a] = joined[b] = min(joined[a], joined[b])
    assert [joined[f] for f in fps] == brute_components(fps)


def test_components_and_edge_cases(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(200)) for _ in range(6)]
    texts = [None, "", " \n", "One", "one two THREE", *base, *base[:3]]
    for b in base:
        words = b.split()
        for _ in range(3):
            words[rng.randrange(200)] = "zz"
            texts.append(" ".join(words))
    rows = [(i, t, f"c{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    fps = [brute_fingerprint(t) for t in texts]
    want = dict(enumerate(brute_components(fps)))
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in want}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert all(r.fp == f"c{r.doc_id}" for r in kept.collect())


def test_null_ids_repeated_rows_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "other words here")], schema)
    got = sorted(((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]
    assert simhash.keep_one(docs).count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
