from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dealweave.llm import byte_bpe, quality, token_counts

TEXTS = [
    None, "", " \n\t", "one", "The cat\x0bsat.\nThe cat\x0bsat.\n \nthe end", "a\x1cb c\x1cd", "<|endoftext|> x <|endoftext|><|endoftext|>",
    "naïve café 漢字 🙂🙂 don't I'll 12³ ½", "x" * 3000, "ab" * 2000 + " tail", "# * $ % & | < > [ ]", "to be or not to be or not to be",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(byte_bpe.VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(remembered=50)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoding_equals_the_library(bpe, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = bpe.encode_many(texts)
    assert got == [",".join(map(str, w)) for w in want]
    assert [bpe.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want] == texts


def test_forced_boundaries_hold(bpe):
    for token in bpe.token_ids:
        assert not any(bpe.forced[a, b] for a, b in zip(token, token[1:]))


def test_encoded_table(spark, library):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)] * 2, "doc_id int, text string, ids_sha256 string")
    rows = byte_bpe.encode_texts(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_texts(docs.limit(0)).count() == 0


def greedy(word, vocabulary, longest):
    n = i = 0
    while i < len(word):
        j = min(len(word), i + longest)
        while word[i:j] not in vocabulary:
            j -= 1
        i, n = j, n + 1
    return n


def test_automaton_of_a_small_vocabulary():
    rng = random.Random(3)
    single = [bytes([b]) for b in range(256)]
    for _ in range(20):
        extra = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(12)}
        automaton = token_counts.LongestMatch([*single, *extra])
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 30))) for _ in range(60)] + [b"abc" * 300]
        ends = np.cumsum([len(w) for w in words])
        got = automaton.counts(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
        assert got.tolist() == [greedy(w, set(single) | extra, 6) for w in words]


def test_counted_table(spark):
    vocabulary = set(token_counts.vocabulary_bytes())
    longest = max(map(len, vocabulary))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id int, text string, n_words int")
    rows = token_counts.count_tokens(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        words = (TEXTS[r.doc_id] or "").encode().split()
        assert r.n_words == len(words)
        assert r.n_tokens == sum(greedy(b" " + w, vocabulary, longest) for w in words)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    model = sentencepiece.SentencePieceProcessor(model_file=quality.VOCABULARY)
    pieces = [i for w in words for i in model.encode(w)]
    counts = collections.Counter(pieces)
    entropy = -sum(c / len(pieces) * math.log2(c / len(pieces)) for c in counts.values()) if pieces else 0
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_pieces": len(pieces),
        "byte_share": sum(model.is_byte(i) for i in pieces) / max(len(pieces), 1), "token_entropy": entropy,
        "chars_per_token": sum(map(len, words)) / max(len(pieces), 1),
    }


def test_quality_measures(spark):
    rng = random.Random(1)
    texts = TEXTS + ["\n".join(" ".join(rng.choice("aa bb cc dd ee".split()) for _ in range(rng.randrange(12)))
                               for _ in range(9)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", 9) for i, t in enumerate(texts)] * 2, "doc_id int, text string, lang string, n_words int")
    rows = quality.verdicts(quality.measures(docs)).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        want = brute_quality(texts[r.doc_id])
        for k, v in want.items():
            assert getattr(r, k) == pytest.approx(v), (k, texts[r.doc_id])
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r.base_failed and r.kept)
    assert quality.measures(docs.limit(0)).count() == 0


def test_verdicts_by_language_and_script(spark):
    rng = random.Random(2)
    vocabulary = "the house of all these people was under water when light from that river came over it".split()
    prose = " ".join(rng.choice(vocabulary) + rng.choice(["", "s", "ed", "ing", " and", " but"]) for _ in range(200))
    noise = " ".join("".join(rng.choice("#$%&qxzj07") for _ in range(9)) for _ in range(200))
    rows = [(1, prose, "en"), (2, noise, "en"), (3, prose, None), (4, "漢字と仮名" * 5, "ja"), (5, noise, "xx"), (6, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert {r.doc_id for r in quality.accepted(docs).collect()} == {1, 3}
    assert quality.accepted(docs).columns == docs.columns
    assert quality.accepted(docs.drop("lang"), lang=None).count() == 2
