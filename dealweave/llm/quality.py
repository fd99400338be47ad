"""Quality rules from tokeniser fertility.

A public sentence-piece vocabulary with byte fallback was made from ordinary text of many languages. Text it fits well
takes few tokens per character, hardly any byte tokens and a spread of tokens neither too narrow (filler, lists of one
phrase) nor as wide as noise. Three figures per document are compared with bands of its language, or of its main
script where the language has none; a figure outside its band rejects the document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import by_position, column_at, map_texts
from dealweave.llm.token_counts import word_bounds

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Distinct words whose pieces a Python worker remembers; the memory is emptied when full.
REMEMBERED = 150_000
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted figures of a language or script.

    Characters per token: at least ``chars_low - slack / sqrt(tokens)`` (short texts scatter more) and at most
    ``chars_high``. Share of byte tokens: at most ``bytes_high``. Token entropy over the largest entropy that a text
    of as many tokens can have: at least ``spread_low``.
    """

    chars_low: float
    slack: float
    chars_high: float = 9.0
    bytes_high: float = 0.05
    spread_low: float = 0.43


#: Bands by language code, and by script for the rest. The lower bounds are set so that ordinary prose of the sample
#: tables passes at every length; measure a corpus with ``measures`` and pass own bands for other text.
LANGUAGES = {"en": Band(2.16, 5.0), "de": Band(2.19, 3.8), "fr": Band(1.93, 3.4), "es": Band(1.88, 2.6)}
SCRIPTS = {"latin": Band(1.6, 4.0, bytes_high=0.1), "other": Band(0.3, 2.0, bytes_high=0.6)}


class Fertility:
    """Piece statistics of texts, word by word, with a bounded memory of words."""

    def __init__(self, path: str = VOCABULARY, remembered: int = REMEMBERED):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.remembered = remembered
        self.pieces: dict[bytes, list[int]] = {}

    def _pieces_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of distinct words in one array, and where each word's begin (and the last ends)."""
        new = [w for w in words if w not in self.pieces]
        if len(self.pieces) + len(new) > self.remembered:
            self.pieces, new = {}, words
        spelled = [w.decode("utf-8", "replace") for w in new]
        self.pieces.update(zip(new, self.model.encode(spelled, num_threads=1), strict=True))
        found = list(map(self.pieces.__getitem__, words))
        ends = np.cumsum([0, *map(len, found)])
        return np.array([i for f in found for i in f], np.int64), ends

    def measure(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        split = [t.split() for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        index: dict[bytes, int] = {}
        words = np.fromiter((index.setdefault(w, len(index)) for s in split for w in s), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ids, ends = self._pieces_of(list(index))
        counts = np.diff(ends)[words]
        tokens = _per_text(counts, edges)
        at = np.repeat(ends[words], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        used = ids[at]
        keys, times = np.unique(np.repeat(owner, counts) * self.size + used, return_counts=True)
        doc = keys // self.size
        plogp = np.bincount(doc, times * np.log2(times), len(texts))
        total = np.maximum(tokens, 1)
        entropy = np.maximum(np.log2(total) - plogp / total, 0)
        fallback = np.bincount(doc, times * self.is_byte[keys % self.size], len(texts))
        return {
            "n_words": sizes, "n_pieces": tokens, "byte_share": fallback / total, "token_entropy": entropy,
            "token_spread": entropy / np.log2(np.maximum(np.minimum(tokens, self.size), 2)),
            "n_repeat_words": _repeated(words, owner, edges, len(index)),
        }


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring edges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated(words: np.ndarray, owner: np.ndarray, edges: np.ndarray, distinct: int) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in the text."""
    if len(words) < 3:
        return np.zeros(len(edges) - 1, np.int64)
    inside = owner[2:] == owner[:-2]
    key = owner[:-2]
    for step in range(3):
        part = words[step:len(words) - 2 + step]
        if int(key.max() + 1) * distinct >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * distinct + part
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    again = np.zeros(len(words), bool)
    # windows that reach into the next text take part in no count: their key starts with their own text and is
    # compared only after they are masked
    valid = np.bincount(which, inside, len(times))
    hit = inside & (valid[which] >= 2)
    for step in range(3):
        again[step:len(words) - 2 + step] |= hit
    return _per_text(again, edges)


def measures(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
             keep: list[str] | None = None) -> DataFrame:
    """Add word counts, repetition counts and fertility figures of every whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word equal to an
    earlier line), ``n_repeat_words`` (words in 3-word windows found twice or more), ``n_pieces``, ``chars_per_token``,
    ``byte_share``, ``token_entropy``, ``token_spread``, ``latin_share`` (share of code points in words below U+0250).
    Words are runs without ASCII white space. Null, empty and blank texts have zeros everywhere. Input columns with
    the new names are replaced.
    """
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def make():
        fertility = Fertility(vocabulary)

        def work(texts):
            made = fertility.measure(texts)
            data = np.frombuffer(b"".join(texts), np.uint8)
            edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            point = ((data & 0xC0) != 0x80) & (data != 32) & ((data < 9) | (data > 13))
            made["word_chars"] = _per_text(point, edges)
            made["n_symbols"] = _per_text(symbol[data], edges)
            latin = _per_text(point & (data < 0xC9), edges)  # a lead byte below C9 starts a code point below U+0240
            made["latin_share"] = latin / np.maximum(made["word_chars"], 1)
            made["chars_per_token"] = made["word_chars"] / np.maximum(made["n_pieces"], 1)
            lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
            made["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
            return made

        return work

    return map_texts(docs, text, make, (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "n_pieces bigint, chars_per_token double, byte_share double, token_entropy double, token_spread double, "
        "latin_share double"), keep)


def _outside(band: Band) -> Column:
    low = band.chars_low - band.slack / F.sqrt(F.col("n_pieces"))
    return ~(F.col("chars_per_token").between(low, F.lit(band.chars_high))
             & (F.col("byte_share") <= band.bytes_high) & (F.col("token_spread") >= band.spread_low))


def verdicts(measured: DataFrame, lang: str | None = "lang", languages: dict[str, Band] = LANGUAGES,
             scripts: dict[str, Band] = SCRIPTS) -> DataFrame:
    """Add ``base_failed`` (fewer than 50 words, or over half of them repeated) and ``kept``.

    A document that does not fail the base rule is kept if all its figures lie in the band of its language, or of its
    main script where the language is null or has no band.
    """
    outside = F.when(F.col("latin_share") >= 0.5, _outside(scripts["latin"])).otherwise(_outside(scripts["other"]))
    if lang:
        for code, band in languages.items():
            outside = F.when(F.col(lang) == code, _outside(band)).otherwise(outside)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~outside})


def accepted(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Documents that pass, with all columns of the input."""
    judged = verdicts(measures(by_position(docs), f"c{column_at(docs, text)}"), lang and f"c{column_at(docs, lang)}")
    return judged.where("kept").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
