"""Benchmark decontamination by suffix arrays of the training text.

Each shard of documents (a slice of an Arrow batch) is turned into word numbers of the benchmark's vocabulary, and the
suffixes that start with a benchmark word are sorted by their first words: a suffix array to the depth of a window.
Every window of the test items is then found by binary search as a range of that array, which gives all its verbatim
occurrences with their locations; neighbouring occurrences on one diagonal make up the longest match. Documents that
hold enough of the benchmark are removed.

The benchmark is the stated query set. It is cut into blocks of bounded size, each broadcast; every shard meets every
block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import by_position, column_at, map_texts

WINDOW = 13
#: Text bytes of one broadcast block of test items, and of a whole benchmark; larger ones are given in parts.
BLOCK_BYTES = 8 << 20
BENCHMARK_BYTES = 256 << 20


def _table() -> bytes:
    """Byte map: A-Z to a-z; digits, letters and bytes of non-ASCII characters stay; all others become spaces."""
    def mapped(b: int) -> int:
        c = chr(b).lower() if b < 0x80 else ""
        return ord(c) if c and (c.isdigit() or "a" <= c <= "z") else b if b >= 0x80 else 0x20
    return bytes(map(mapped, range(256)))


TABLE = _table()


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII digits, letters (lower-cased) and non-ASCII characters."""
    return text.translate(TABLE).split()


class Block:
    """Windows of some test items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            size = min(window, len(ids))
            for j in range(len(ids) - size + 1) if ids else ():
                found.setdefault(ids[j:j + size], set()).add(item)
        self.items = [sorted(i) for i in found.values()]
        self.sizes = np.array([len(w) for w in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.words[i, :len(w)] = w
        self.bits = len(self.vocabulary).bit_length()
        self.pack = max(1, 62 // max(self.bits, 1))

    def _keys(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Word columns packed into as few sort keys as fit."""
        keys = []
        for start in range(0, self.window, self.pack):
            part = columns[start:start + self.pack]
            key = np.zeros(len(part[0]), np.int64)
            for column in part:
                key = key << self.bits | column
            keys.append(key)
        return keys

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of all windows in a word-number array (0 for words the benchmark lacks): window, position."""
        starts = np.flatnonzero(ids)
        if not len(starts) or not len(self.sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate([ids, np.zeros(self.window, np.int64)])
        columns = [padded[starts + k] for k in range(self.window)]
        keys = self._keys(columns)
        order = _sorted_order(keys)
        keys = [k[order] for k in keys]
        suffixes = starts[order]
        top = (1 << self.bits) - 1
        low = self._keys([self.words[:, k] for k in range(self.window)])
        filled = np.where(np.arange(self.window) < self.sizes[:, None], self.words, top)
        high = self._keys([filled[:, k] for k in range(self.window)])
        begin, end = _bound(keys, low, "left"), _bound(keys, high, "right")
        times = end - begin
        which = np.repeat(np.arange(len(times)), times)
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
        return which, suffixes[at]


def _sorted_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by several keys: sort by the first, then sort runs of equal ones by the next keys."""
    order = np.argsort(keys[0])
    tied = keys[0][order]
    group = np.cumsum(np.concatenate([[True], tied[1:] != tied[:-1]])) - 1
    for key in keys[1:]:
        size = np.bincount(group)
        loose = np.flatnonzero(size[group] > 1)
        if not len(loose):
            break
        part = order[loose]
        fine = np.lexsort((key[part], group[loose]))
        order[loose] = part[fine]
        now = key[order]
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (now[1:] != now[:-1])])) - 1
    return order


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], side: str) -> np.ndarray:
    """Binary search of key tuples in sorted key columns, all at once: the leftmost or rightmost place for each."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        probe = np.minimum(middle, len(keys[0]) - 1)
        less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for have, want in zip(keys, wanted, strict=True):
            less |= same & (have[probe] < want)
            same &= have[probe] == want
        right = open_ & (less | (same if side == "right" else False))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> list:
    """The benchmark as broadcast blocks of bounded size. Items without an id or without words are left out; rows with
    one id count as one item."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if total > BENCHMARK_BYTES:
        raise ValueError("the benchmark is too large for one call: give it in parts")
    blocks, held, size = [], [], 0
    for item, value in items.select(item_id, text).toLocalIterator():
        held.append((item, words_of(value.encode())))
        size += len(value)
        if size > BLOCK_BYTES:
            blocks.append(context.broadcast(Block(held, window)))
            held, size = [], 0
    if held:
        blocks.append(context.broadcast(Block(held, window)))
    return blocks


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items``, ``longest`` and ``spans`` to every document.

    A window is ``window`` consecutive words of an item; an item of fewer words (but any) is one window. ``n_hit``
    counts document words inside any occurrence of a window, ``items`` lists the ids with an occurring window in
    order, ``spans`` the maximal hit runs as (start, end) word positions, ``longest`` the words of the longest verbatim
    match (windows on one diagonal). Null, empty and word-free texts have none. Input columns with the new names are
    replaced.
    """
    blocks = benchmark_blocks(benchmark, item_id, item_text, window)

    def make():
        def work(texts):
            split = [words_of(t) for t in texts]
            sizes = [len(s) for s in split]
            # a gap of one unknown word ends the matches of each document
            edges = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
            change = np.zeros(int(edges[-1]) + 1, np.int64)
            items: list[set[int]] = [set() for _ in texts]
            longest = [0] * len(texts)
            for shared in blocks:
                block = shared.value
                known = block.vocabulary.get
                ids = np.zeros(int(edges[-1]), np.int64)
                for s, a in zip(split, edges.tolist(), strict=False):
                    ids[a:a + len(s)] = np.fromiter((known(w, 0) for w in s), np.int64, len(s))
                which, at = block.search(ids)
                if not len(which):
                    continue
                size = block.sizes[which]
                np.add.at(change, at, 1)
                np.add.at(change, at + size, -1)
                owner = np.searchsorted(edges, at, side="right") - 1
                for d, w in np.unique(np.stack([owner, which]), axis=1).T.tolist():
                    items[d].update(block.items[w])
                for d, n in _longest_runs(owner, which, at, size, block):
                    longest[d] = max(longest[d], n)
            hit = np.cumsum(change[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8)))
            begin, end = turns[::2], turns[1::2]
            first = np.searchsorted(begin, edges)
            total = np.concatenate([[0], np.cumsum(hit)])
            return {
                "n_words": sizes, "n_hit": np.diff(total[edges]), "items": [sorted(i) for i in items], "longest": longest,
                "spans": [[{"start": int(begin[k] - edges[d]), "end": int(end[k] - edges[d])} for k in range(first[d], first[d + 1])]
                          for d in range(len(texts))],
            }

        return work

    return map_texts(docs, text, make, (
        "n_words bigint, n_hit bigint, items array<bigint>, longest bigint, spans array<struct<start: bigint, end: bigint>>"),
        keep)


def _longest_runs(owner, which, at, size, block):
    """Longest match of each document: occurrences that follow each other word by word and overlap in all but one word
    of their windows continue one match."""
    order = np.argsort(at, kind="stable")
    full = order[size[order] == block.window]
    best: dict[int, int] = {}
    for d, n in zip(owner[order].tolist(), size[order].tolist(), strict=True):
        best[d] = max(best.get(d, 0), n)
    run, last = 0, None
    for p, d, w in zip(at[full].tolist(), owner[full].tolist(), which[full].tolist(), strict=True):
        follows = last is not None and p == last[0] + 1 and not set(block.items[w]).isdisjoint(block.items[last[1]])
        run = run + 1 if follows else 0
        best[d] = max(best[d], block.window + run)
        last = (p, w)
    return best.items()


def contaminated(matched: DataFrame) -> DataFrame:
    """Add ``contaminated``: some word is hit, and the hit words are a twentieth of all words or more."""
    return matched.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents that are not contaminated, with all columns of the input."""
    judged = contaminated(matches(by_position(docs), benchmark, f"c{column_at(docs, text)}"))
    return judged.where("not contaminated").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
