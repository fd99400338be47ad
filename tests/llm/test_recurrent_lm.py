from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dealweave.llm import recurrent_lm as lm

SMALL = lm.Shape(words=10, per_class=4, hidden=5, steps=3, lanes=2)


def small_model(seed=0):
    model = lm.Model.fresh(SMALL, np.arange(10, 0, -1), 6)
    rng = np.random.default_rng(seed)
    model.weights = {k: rng.normal(0, 0.4, v.shape) for k, v in model.weights.items()}
    return model


def test_probabilities_sum_to_one():
    model = small_model()
    state = np.random.default_rng(1).normal(size=(1, 5))
    each = [math.exp(model.output(state, np.array([t]))[0]) for t in range(SMALL.words + 1)]
    assert sum(each) == pytest.approx(1)


def test_gradients_equal_differences():
    model, rng = small_model(2), np.random.default_rng(3)
    inputs = rng.integers(0, 12, (4, 3))
    targets = rng.integers(0, 11, (4, 3))
    state = rng.normal(size=(3, 5))
    found = {}

    class Spy(dict):
        def items(self):
            found.update({k: v.copy() for k, v in dict.items(self)})
            return ()

    output = model.output
    model.output = lambda s, t, train=False: (lambda r: (r[0], Spy(r[1]), r[2]))(output(s, t, train)) if train else output(s, t)
    model.run, run = lambda i, s: tuple(_as_double(run(i, s))), model.run
    model.learn(inputs, targets, state)
    for name, w in model.weights.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w.shape)
            values = []
            for step in (1e-3, -1e-3):
                w[at] += step
                values.append(output(run(inputs, state)[0].reshape(-1, 5).astype(np.float64), targets.reshape(-1)).sum())
                w[at] -= step
            assert found[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-2), name


def _as_double(result):
    states, kept = result
    return states.astype(np.float64), kept


def test_state_is_carried_through_whole_documents():
    model, rng = small_model(4), np.random.default_rng(5)
    docs = [rng.integers(0, 11, n).astype(np.int32) for n in (1, 7, 20, 3, 40, 2, 2)]
    got = lm.score_block(model, docs)
    for d, total in zip(docs, got, strict=True):
        inputs = np.array([SMALL.words + 1, *d[:-1]])[:, None]
        states, _ = model.run(inputs, np.zeros((1, 5)))
        assert total == pytest.approx(model.output(states.reshape(-1, 5), d).sum(), rel=1e-4)


def test_pieces_hold_every_token_once():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 11, n).astype(np.int32) for n in (1, 7, 20, 3, 41, 2, 2)]
    lanes = lm.Lanes.of(docs, SMALL, 6)
    there = lanes.owners >= 0
    assert there.sum() == sum(map(len, docs)) and lanes.fresh[there].sum() == sum(-(-len(d) // 6) for d in docs)
    seen = {d: [] for d in range(len(docs))}
    for lane in range(there.shape[1]):
        at = np.flatnonzero(there[:, lane])
        assert at.tolist() == list(range(len(at)))  # padding stands at the end
        for t in at:
            seen[lanes.owners[t, lane]].append((lanes.inputs[t, lane], lanes.targets[t, lane]))
    for d, text in enumerate(docs):
        assert sorted(seen[d]) == sorted(zip([SMALL.words + 1, *text[:-1]], text, strict=True))
    covered = sum(len(range(*w.indices(len(there)))) for w, _ in lanes.windows(3, 12))
    assert covered == len(there)


def test_training_learns_what_follows_what():
    shape = lm.Shape(words=12, per_class=4, hidden=8, steps=8, lanes=8, rate=0.1)
    rng = random.Random(1)
    docs = [np.array([(start + i) % 12 for i in range(40)], np.int32) for start in [rng.randrange(12) for _ in range(60)]]
    model = lm.Model.fresh(shape, np.full(12, 10.0), 0)
    before = lm.score_block(model, docs[:5]).sum()
    for _ in range(12):
        lm.train_block(model, docs[5:])
    assert lm.score_block(model, docs[:5]).sum() > before / 3


@pytest.mark.parametrize("sizes", [(2,), (3, 2), (7, 2), (20, 4, 1)])
def test_every_token_is_trained_and_padding_is_not(sizes):
    model, rng = small_model(6), np.random.default_rng(7)
    docs = [rng.integers(0, 10, n).astype(np.int32) for n in sizes]
    targets, output = [], model.output

    def spy(states, chosen, train=False):
        targets.extend(chosen.tolist())
        return output(states, chosen, train)

    model.output = spy
    lm.train_block(model, docs)
    assert sorted(targets) == sorted(np.concatenate(docs).tolist())


def test_padding_changes_no_weight():
    rng = np.random.default_rng(9)
    inputs, targets, state = rng.integers(0, 10, (3, 2)), rng.integers(0, 10, (3, 2)), rng.normal(size=(2, 5))
    there = np.array([[True, True], [True, False], [True, False]])
    inputs[1:, 1] = SMALL.words + 1
    trained = []
    for other in (0, 7):
        model = small_model(8)
        model.learn(inputs, np.where(there, targets, other), state, there)
        trained.append(model.weights)
    assert all((trained[0][k] == trained[1][k]).all() for k in trained[0])
    assert (trained[0]["input"][SMALL.words + 1] == small_model(8).weights["input"][SMALL.words + 1]).all()


def test_scores_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    rng = random.Random(8)
    texts = [None, "", " \n", "One", "x" * 5000] + [
        " ".join(rng.choice("the The cat sat on É é mat\x1cx a".split(" ")) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1), (7, texts[7], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").repartition(3)
    got = lm.scores(docs, shape=lm.Shape(words=6, per_class=3, hidden=4, steps=4, lanes=4)).collect()
    assert len(got) == len(rows)

    def tokens(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["<end>"]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    counts = Counter(w for i, t, _ in rows if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        own = tokens(text_of[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held[r.doc_id], len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert -9 * len(own) < r.score < 0
    assert any(held.values())
    assert lm.scores(docs.limit(0)).count() == 0
