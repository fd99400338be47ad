"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up inside one token, whatever merges
run: between the two a token boundary is certain. Every pre-token is cut at these pairs, each fragment is encoded on
its own, and the ids are concatenated. Fragments repeat far more often than words, so their encodings are remembered
(a bounded memory that is emptied when full; it never changes a result).
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dealweave.llm.common import map_texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The pre-token pattern for any text, and the same with its classes written out for texts of Latin-1 characters.
SPLIT_ANY = regex.compile(public_tokenizers.PATTERN).findall
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t-\\r\\x85\\xa0"
SPLIT_LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
NO_RANK = 1 << 60
#: Remembered encodings per Python worker.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 characters stand for themselves, the
    other bytes in ascending order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str = VOCABULARY, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        spelled = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.token_ids = {b: spec["model"]["vocab"][t] for t, b in spelled.items()}
        self.token_bytes = {i: b for b, i in self.token_ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        self.width = max(ids.values()) + 1
        pairs = np.array([ids[a] * self.width + ids[b] for a, b in merges], np.int64)
        self.merged_ids = np.array([ids[a + b] for a, b in merges], np.int64)
        self.pair_ranks = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.pair_ranks]
        self.first_ids = np.array([self.token_ids[bytes([b])] for b in range(256)], np.int64)
        self.names = {i: str(i) for i in ids.values()}
        inside = np.zeros((256, 256), bool)
        for token in self.token_ids:
            pair = np.frombuffer(token, np.uint8)
            inside[pair[:-1], pair[1:]] = True
        self.forced = ~inside
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.words: dict[str, str] = {}
        self.fragments: dict[bytes, str] = {}
        self.remembered = remembered
        self.id_bytes = {str(i): b for i, b in self.token_bytes.items()}

    def _merge(self, fragments: list[bytes]) -> list[str]:
        """Ids of many fragments at once, as comma-joined texts.

        All fragments take their steps together: in each step every unfinished fragment joins all occurrences of its
        pair of lowest rank, from the left. A merge only makes pairs of higher rank, so this equals one join at a time.
        """
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        owner = np.repeat(np.arange(len(fragments)), sizes)
        symbols = self.first_ids[np.frombuffer(b"".join(fragments), np.uint8)]
        done_owner, done_symbols = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK, np.int64)
            rank[:-1] = self._pair_ranks(symbols[:-1], symbols[1:])
            rank[:-1][owner[1:] != owner[:-1]] = NO_RANK
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, starts), counts)
            active = best < NO_RANK
            done_owner.append(owner[~active])
            done_symbols.append(symbols[~active])
            symbols, owner, rank, best = symbols[active], owner[active], rank[active], best[active]
            chosen = rank == best
            at = np.flatnonzero(chosen)
            if len(at):
                run = np.cumsum(np.concatenate([[True], np.diff(at) != 1])) - 1
                first = at[np.concatenate([[True], np.diff(at) != 1])]
                at = at[(at - first[run]) % 2 == 0]
                symbols[at] = self.merged_ids[rank[at]]
                stay = np.ones(len(symbols), bool)
                stay[at + 1] = False
                symbols, owner = symbols[stay], owner[stay]
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        names = list(map(self.names.__getitem__, symbols[order].tolist()))
        ends = np.cumsum(np.bincount(owner, minlength=len(fragments))).tolist()
        return [",".join(names[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.width + right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NO_RANK)

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words: cut them at forced boundaries, encode the new fragments, concatenate."""
        data = [w.encode() for w in words]
        octets = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        cut = np.zeros(len(octets) + 1, bool)
        cut[1:-1] = self.forced[octets[:-1], octets[1:]]
        cut[0] = cut[ends] = True
        at = np.flatnonzero(cut)
        joined, at_list = octets.tobytes(), at.tolist()
        pieces = [joined[i:j] for i, j in zip(at_list, at_list[1:], strict=False)]
        if len(self.fragments) > self.remembered:
            self.fragments = {}
        new = [p for p in dict.fromkeys(pieces) if p not in self.fragments]
        if new:
            self.fragments.update(zip(new, self._merge(new), strict=True))
        ids = list(map(self.fragments.__getitem__, pieces))
        last = np.searchsorted(at, ends).tolist()
        if len(self.words) > self.remembered:
            self.words = {}
        self.words.update(zip(words, (ids[i] if j == i + 1 else ",".join(ids[i:j])
                                      for i, j in zip([0, *last], last, strict=False)), strict=True))

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text, with the strings of special tokens as pieces of their own."""
        if not any(s in text for s in self.special):
            return self._split(text)
        out: list[str] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self._split(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return SPLIT_ANY(text)
        return SPLIT_LATIN(text)

    def encode_many(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text joined by commas. Strings of special tokens become these tokens."""
        pieces = [self._pieces(t) for t in texts]
        known = self.words
        new = list({w for p in pieces for w in p if w not in known} - self.special.keys())
        short: dict[str, str] = {}
        if new:
            before = known
            self._learn(new)
            if self.words is not before:  # the memory was emptied: what this call still needs of it comes along
                short = before
        known = self.words | short if short else self.words
        known |= {s: str(i) for s, i in self.special.items()}
        return [",".join(map(known.__getitem__, p)) for p in pieces]

    def decode(self, ids: str) -> str:
        """Text of comma-joined ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        return b"".join(map(self.id_bytes.__getitem__, ids.split(","))).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None,
                 ids: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``token_ids`` (array, left out with ``ids=False``), ``ids_sha256`` and ``decoded_sha256``.

    The digests are of the decimal ids joined by commas and of the text decoded from these ids. Null counts as empty:
    no tokens. Texts are taken whole, one at a time. Input columns with the new names are replaced.
    """
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")

    def make():
        bpe = ByteBpe(vocabulary)

        def work(texts):
            coded = bpe.encode_many([t.decode() for t in texts])
            made = {
                "n_tokens": [c.count(",") + 1 if c else 0 for c in coded],
                "ids_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in coded],
                "decoded_sha256": [hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded],
            }
            if ids:
                flat = np.fromstring(",".join(c for c in coded if c), np.int32, sep=",")
                ends = np.cumsum([0, *made["n_tokens"]]).astype(np.int32)
                made["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            return made

        return work

    return map_texts(docs, text, make, fields, keep)
