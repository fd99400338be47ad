"""Greedy word-piece lengths with a linear longest-match automaton.

The vocabulary is a trie over bytes. Longest-match-first tokenising of a word is turned into a single left-to-right
pass: every trie node has a failure link, followed when no child fits the next byte, and the number of tokens that the
link pops. Resolving the links for each node and byte gives one table "next node, tokens popped", so counting the
tokens of a word is one table step per byte, and no piece is ever built.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from dealweave.llm.byte_bpe import byte_letters
from dealweave.llm.common import map_texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words up to this many bytes step together; longer ones are walked alone.
TOGETHER = 512


def vocabulary_bytes(path: str = VOCABULARY) -> list[bytes]:
    """Byte strings of a byte-level vocabulary file, special tokens left out."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    return [bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


class LongestMatch:
    """Automaton over a vocabulary that holds every single byte.

    ``step[node, byte]`` is the node after the byte, ``popped[node, byte]`` how many tokens end before it.
    ``rest[node]`` is the number of tokens that the text remembered by a node amounts to at the end of a word.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = sorted(set(tokens) - {b""})
        if sum(len(t) == 1 for t in self.tokens) != 256:
            raise ValueError("the vocabulary has to hold every single byte")
        nodes, paths, parents, octets, final = {b"": 0}, [b""], [-1], [-1], [False]
        known = set(self.tokens)
        for token in self.tokens:
            for n in range(1, len(token) + 1):
                path = token[:n]
                if path not in nodes:
                    nodes[path] = len(paths)
                    paths.append(path)
                    parents.append(nodes[path[:-1]])
                    octets.append(path[-1])
                    final.append(path in known)
        depth = np.array([len(p) for p in paths])
        parent, octet, final = np.array(parents), np.array(octets), np.array(final)
        n = len(paths)
        child = np.full((n, 256), -1, np.int32)
        child[parent[1:], octet[1:]] = np.arange(1, n)
        self.step = np.zeros((n, 256), np.int32)
        self.popped = np.zeros((n, 256), np.uint8)
        self.rest = np.zeros(n, np.uint8)
        link, pops = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.step[0] = child[0]
        for level in range(1, depth.max() + 1):
            at = np.flatnonzero(depth == level)
            up, letter = parent[at], octet[at]
            # a whole token pops itself; else what the parent's link pops, then a step from there
            from_link = link[up]
            link[at] = np.where(final[at], 0, self.step[from_link, letter])
            pops[at] = np.where(final[at], 1, pops[up] + self.popped[from_link, letter])
            missing = child[at] < 0
            self.step[at] = np.where(missing, self.step[link[at]], child[at])
            self.popped[at] = np.where(missing, pops[at][:, None] + self.popped[link[at]], 0)
            ended = pops[at] + self.rest[link[at]]
            if max(ended.max(), self.popped.max() + pops[at].max()) > 255:
                raise ValueError("a token of this vocabulary has a prefix of over 255 tokens")
            self.rest[at] = ended

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[start:end]``."""
        total = np.zeros(len(starts), np.int64)
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        long = int((sizes > TOGETHER).sum())
        for i in order[:long]:
            node, n = 0, 0
            for b in data[starts[i]:ends[i]].tolist():
                n += int(self.popped[node, b])
                node = self.step[node, b]
            total[i] = n + int(self.rest[node])
        order = order[long:]
        if not len(order):
            return total
        begin, size = starts[order], sizes[order]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        node, n = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        for t, k in enumerate(alive.tolist()):
            letter = data[begin[:k] + t]
            now = node[:k]
            n[:k] += self.popped[now, letter]
            node[:k] = self.step[now, letter]
        total[order] = n + self.rest[node]
        return total


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without ASCII white space."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
                 keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words`` and ``n_tokens``: greedy longest-match pieces of every word of the whole text.

    A word is a run without ASCII white space, matched with one space in front (the vocabulary marks word starts so).
    Null, empty and blank texts have 0 of both. Input columns with the new names are replaced.
    """

    def make():
        automaton = LongestMatch(vocabulary_bytes(vocabulary))

        def work(texts):
            # the space before a word is in the text itself: each text follows one, white space is written as space
            data = np.frombuffer(b" " + b" ".join(texts), np.uint8).copy()
            data[(data >= 9) & (data <= 13)] = 32
            starts, ends = word_bounds(data)
            counts = automaton.counts(data, starts - 1, ends)
            edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            at = np.searchsorted(starts, edges)
            total = np.concatenate([[0], np.cumsum(counts)])
            return {"n_words": np.diff(at), "n_tokens": np.diff(total[at])}

        return work

    return map_texts(docs, text, make, "n_words bigint, n_tokens bigint", keep)
