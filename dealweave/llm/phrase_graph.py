"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of three words, edges runs of four, weighted by how often they occur. Only these longest runs are
counted in the texts, besides the last (up to three) words of every segment. All shorter counts follow from the flow:
a run of three occurs as often as edges leave its node, plus the segments that end with it; a run of two as often as
the runs of three that start with it, plus the segments that end with it; and so for single words.

A segment is a part of a piece without words and neighbouring pairs that are surely too rare to be in any phrase asked
for. Which these are is read from two bit maps of stated sizes, one of frequent words and one of frequent pairs: some
rare ones share a bit with a frequent one and stay, which costs time and changes no result.

Nodes with one way in and one way out are compacted: their edges form unary paths of one weight. The phrases of four
words and the counts of the nodes inside a path are read from the paths, the other counts from the flow.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.common import shared_folder, stored, text_bytes, text_slices

MIN_COUNT = 30
LONGEST = 4
SCALE = 2_000_000
COVERED = 80
#: Bits of the maps of words and of pairs that are frequent enough.
BITS = 1 << 25
PAIR_BITS = 1 << 26
#: Text bytes whose runs are counted together in a task.
RUN_BYTES = 12 << 20
#: Pairs are counted under so many numbers.
PAIRS = 1 << 40
#: Pairs that a task holds before it passes on their counts.
HELD_PAIRS = 4_000_000
#: Different words that a task holds before it passes on its counts.
HELD_WORDS = 300_000

UNKNOWN = "und"
_MARK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in order, A-Z lower-cased, with a mark before every piece but the first."""
    return _MARK.join(texts).translate(_TABLE).replace(_MARK, b" \xff ").split()


def _by_language(batch: pa.RecordBatch):
    langs = batch.column("lang").to_pylist()
    texts = text_bytes(batch.column("text"))
    for lang in sorted(set(langs)):
        yield lang, [t for t, x in zip(texts, langs, strict=True) if x == lang]


def _count_words(batches):
    held: dict[str, Counter] = {}

    def passed_on():
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.string()),
            "n": pa.array([r[2] for r in rows], pa.int64())})

    for batch in batches:
        for part in text_slices(batch, "text"):
            for lang, texts in _by_language(part):
                counts = held.setdefault(lang, Counter())
                counts.update(tokens_of(texts))
                counts.pop(_MARK, None)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield passed_on()
    if held:
        yield passed_on()


def _bit(lang: Column, word: Column) -> Column:
    return F.pmod(F.crc32(F.concat(lang, F.lit("\0"), word).cast("binary")), F.lit(BITS))


def _bit_map(places: DataFrame, size: int) -> np.ndarray:
    """Bit map of ``size`` bits, as bytes, of a column ``at``; its size is fixed, whatever the number of rows."""
    width = 4096 * 8
    rows = places.groupBy(F.expr(f"at div {width}").alias("k")).agg(F.bitmap_construct_agg(F.expr(f"at % {width}")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for row in rows.toLocalIterator():
        bits[row.k * 4096:(row.k + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits


def _unique_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of every different row of equally long columns of small numbers from 0."""
    key = columns[0]
    for column in columns[1:]:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * (int(column.max(initial=0)) + 1) + column
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return first, times


def _in_map(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Line:
    """Tokens of a slice of texts of one language, with the words that are possibly frequent."""

    def __init__(self, lang: str, texts: list[bytes], word_bits: np.ndarray):
        tokens = tokens_of(texts)
        index: dict[bytes, int] = {_MARK: 0}
        self.ids = np.fromiter((index.setdefault(w, len(index)) for w in tokens), np.int64, len(tokens))
        self.words = list(index)
        start, seed = zlib.crc32(lang.encode() + b"\0"), xxhash.xxh64_intdigest(lang.encode())
        at = np.fromiter((zlib.crc32(w, start) for w in self.words), np.int64, len(index)) % (8 * len(word_bits))
        possible = _in_map(word_bits, at)
        possible[0] = False  # the mark
        self.there = possible[self.ids]
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(index))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of neighbouring possible words, and where the first stands."""
        at = np.flatnonzero(self.there[:-1] & self.there[1:])
        h = self.hashes[self.ids[at]] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.ids[at + 1]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(29))) & np.uint64(PAIRS - 1)).view(np.int64), at

    def runs(self, pair_bits: np.ndarray):
        """(words of a node, next word, count) of all runs of ``LONGEST`` words, and of all segment ends without a next."""
        n = len(self.ids)
        h, at = self.pairs()
        link = np.zeros(n + 1, bool)  # does a segment go on from this word to the next?
        link[at[_in_map(pair_bits, h % (8 * len(pair_bits)))]] = True
        edge = np.ones(max(n - LONGEST + 1, 0), bool)
        for k in range(LONGEST - 1):
            edge &= link[k:len(edge) + k]
        yield from self._named(np.flatnonzero(edge), LONGEST, LONGEST - 1)
        last = np.flatnonzero(self.there & ~link[:n])
        size = np.ones(len(last), np.int64)
        for k in range(1, LONGEST - 1):
            size += (size == k) & (last >= k) & link[last - k]
        for k in range(1, LONGEST):
            yield from self._named(last[size == k] - k + 1, k, k)

    def _named(self, start: np.ndarray, size: int, head: int):
        if len(start):
            first, times = _unique_rows([self.ids[start + k] for k in range(size)])
            parts = [self.ids[start[first] + k].tolist() for k in range(size)]
            for *ks, n in zip(*parts, times.tolist(), strict=True):
                yield b" ".join([self.words[k] for k in ks[:head]]), self.words[ks[-1]] if head < size else None, n


def _sources(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col(text).cast("string").alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, word, n``: occurrences of every word. Null texts have none, a null language counts as ``und``."""
    found = _sources(docs, text, lang).mapInArrow(_count_words, "lang string, word string, n bigint")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, word_bits, text: str, lang: str) -> DataFrame:
    """``h, n``: how often pairs of possible neighbours occur, by hash. Pairs with one hash count as the same."""

    def passed_on(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": pa.array(h), "n": pa.array(n)})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                for language, texts in _by_language(part):
                    held.append(Line(language, texts, word_bits.value).pairs()[0])
                    size += len(held[-1])
                if size > HELD_PAIRS:
                    yield passed_on(held)
                    held, size = [], 0
        if held:
            yield passed_on(held)

    return _sources(docs, text, lang).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def graph(docs: DataFrame, words: DataFrame, min_count: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, head, last, c, f, first``: edges from the node ``head`` by the word ``last`` with their weights ``c``, and
    rows without ``last`` for segments that end with ``head``. ``f`` is the flow through a node, the sum over its rows;
    ``first`` marks one row of each node. Edges that weigh less than ``min_count`` and are no first rows are only in ``f``.

    ``words`` are the ``word_counts``. Runs with a word or a neighbouring pair that occurs less than ``min_count`` times
    may be left out; no other run is. Rows are dealt by node once, for their own sums and for the flow.
    """
    spark = docs.sparkSession
    word_bits = spark.sparkContext.broadcast(_bit_map(words.where(F.col("n") >= min_count).select(
        _bit(F.col("lang"), F.col("word")).alias("at")), BITS))
    pairs = _pair_counts(docs, word_bits, text, lang).where(F.col("n") >= min_count)
    pair_bits = spark.sparkContext.broadcast(_bit_map(pairs.select(F.pmod("h", F.lit(PAIR_BITS)).alias("at")), PAIR_BITS))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", RUN_BYTES):
                for language, texts in _by_language(part):
                    rows = list(Line(language, texts, word_bits.value).runs(pair_bits.value))
                    mark = f"{len(language)} {language}".encode()
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array([mark + r[0] for r in rows], pa.string()),
                        "last": pa.array([r[1] for r in rows], pa.string()), "c": pa.array([r[2] for r in rows], pa.int32())})

    # A node travels as one text, the length of its language, the language and the words: shorter rows to shuffle.
    found = _sources(docs, text, lang).mapInArrow(run, "node string, last string, c int")
    found = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node")
    edges = found.groupBy("node", "last").agg(F.sum("c").alias("c"))
    node = Window.partitionBy("node").orderBy("c")
    whole = node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flowing = edges.withColumns({"f": F.sum("c").over(whole), "first": F.row_number().over(node) == 1})
    flowing = flowing.where(F.col("first") | F.col("last").isNull() | (F.col("c") >= min_count))
    size = F.substring_index("node", " ", 1)
    start, length = F.length(size) + 2, size.cast("int")
    return flowing.select(F.substr("node", start, length).alias("lang"), F.substr("node", start + length).alias("head"),
                          "last", "c", "f", "first")


def flow(edges: DataFrame) -> dict[int, DataFrame]:
    """Counts ``lang, phrase, f`` of runs of three, two and one words, by size, from the flow through their nodes."""
    sized = edges.withColumn("size", F.size(F.split("head", " ")))
    longer = sized.where(F.col("first") & (F.col("size") == LONGEST - 1)).select("lang", F.col("head").alias("phrase"), "f")
    counts = {LONGEST - 1: longer}
    for size in range(LONGEST - 2, 0, -1):
        ended = sized.where(F.col("last").isNull() & (F.col("size") >= size)).select(
            "lang", F.substring_index("head", " ", -size).alias("phrase"), F.col("c").alias("f"))
        left = longer.select("lang", F.substring_index("phrase", " ", size).alias("phrase"), "f")
        counts[size] = longer = left.union(ended).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counts


def unary_paths(edges: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """``lang, words, f``: edges joined over all nodes with one way in and one way out; ``words`` is an array.

    ``edges`` (lang, phrase, f) and ``nodes`` (lang, phrase, f) may leave out those below some count. A node whose flow
    equals the weight of an edge into it and of one out of it has no other and no segment starts or ends there. Every
    edge finds the first edge of its path by pointer doubling, so a path of n edges takes about log2(n) rounds.
    """
    size = LONGEST - 1
    head, tail = F.substring_index("phrase", " ", size), F.substring_index("phrase", " ", -size)
    into = edges.select("lang", tail.alias("node"), "f", F.col("phrase").alias("before"))
    out = edges.select("lang", head.alias("node"), "f", "phrase")
    inner = nodes.select("lang", F.col("phrase").alias("node"), "f")
    before = inner.join(into, ["lang", "node", "f"]).join(out, ["lang", "node", "f"]).select("lang", "phrase", "before")
    state = stored(edges.join(before, ["lang", "phrase"], "left").select(
        "lang", "phrase", "f", F.coalesce("before", "phrase").alias("first"),
        F.col("before").isNotNull().cast("bigint").alias("steps")), folder)
    while True:
        ahead = state.select("lang", F.col("phrase").alias("first"), F.col("first").alias("further"), F.col("steps").alias("more"))
        moved = stored(state.join(ahead, ["lang", "first"]).select(
            "lang", "phrase", "f", F.col("further").alias("first"), (F.col("steps") + F.col("more")).alias("steps"), "more"), folder)
        state = moved.drop("more")
        if not moved.where("more > 0").limit(1).count():
            break
    ordered = F.sort_array(F.collect_list(F.struct("steps", F.substring_index("phrase", " ", -1).alias("word"))))
    paths = state.groupBy("lang", "first", "f").agg(ordered.alias("rest"))
    words = F.concat(F.split(F.substring_index("first", " ", size), " "), F.col("rest.word"))
    return paths.select("lang", words.alias("words"), "f")


def _windows(words: Column, size: int, first: int, last: Column) -> Column:
    """Runs of ``size`` words of a path that start from ``first`` on and before ``last``."""
    return F.when(last > first, F.transform(
        F.sequence(F.lit(first), last - 1), lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def phrase_counts(edges: DataFrame, min_count: int, folder: str) -> tuple[dict[int, DataFrame], DataFrame]:
    """Counts of all runs of one to four words that occur at least ``min_count`` times, by size, and the unary paths."""
    counts = {size: stored(c.where(F.col("f") >= min_count), folder) for size, c in flow(edges).items()}
    heavy = edges.where(F.col("last").isNotNull() & (F.col("c") >= min_count))
    heavy = stored(heavy.select("lang", F.concat_ws(" ", "head", "last").alias("phrase"), F.col("c").alias("f")), folder)
    paths = stored(unary_paths(heavy, counts[LONGEST - 1], folder), folder)
    words, n = F.col("words"), F.size("words")
    counts[LONGEST] = paths.select("lang", F.explode(_windows(words, LONGEST, 0, n - LONGEST + 1)).alias("phrase"), "f")
    size = LONGEST - 1
    inside = stored(paths.select("lang", F.explode(_windows(words, size, 1, n - size)).alias("phrase"), "f"), folder)
    others = counts[size].join(inside, ["lang", "phrase"], "left_anti")
    counts[size] = inside.union(others)
    return counts, paths


def _cuts(phrase: Column, size: int) -> Column:
    return F.array(*[F.struct(
        F.lit(k).alias("k"), F.substring_index(phrase, " ", k).alias("left"),
        F.substring_index(phrase, " ", k - size).alias("right")) for k in range(1, size)])


def scored(counts: dict[int, DataFrame]) -> DataFrame:
    """Phrases of two words and more with their weakest cut: ``lang, phrase, size, a, l, r, score``.

    The score of a cut is floor(2000000 a / (l + r)); the lowest counts, the earliest of equals. Products are decimals.
    """
    parts = None
    for size in range(2, LONGEST + 1):
        cut = counts[size].select("lang", "phrase", F.lit(size).alias("size"), F.col("f").alias("a"),
                                  F.explode(_cuts(F.col("phrase"), size)).alias("cut"))
        parts = cut if parts is None else parts.union(cut)
    known = None
    for size in range(1, LONGEST):
        known = counts[size] if known is None else known.unionByName(counts[size])
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = parts.select("lang", "phrase", "size", "a", "cut.k", "cut.left", "cut.right").join(left, ["lang", "left"])
    cuts = cuts.join(right, ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20, 0)) * cast({SCALE} as decimal(8, 0)) div "
                   "(cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    cuts = cuts.withColumn("score", score)
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(weakest).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def uncovered(found: DataFrame) -> DataFrame:
    """Phrases without those whose words lie inside a longer phrase that is at least 80 % as frequent."""
    subs = None
    for size in range(3, LONGEST + 1):
        for inner in range(2, size):
            longer = found.where(F.col("size") == size)
            words = F.split("phrase", " ")
            shorter = F.array(*[F.array_join(F.slice(words, i + 1, inner), " ") for i in range(size - inner + 1)])
            part = longer.select("lang", F.explode(F.array_distinct(shorter)).alias("phrase"), F.col("a").alias("longer"))
            subs = part if subs is None else subs.union(part)
    most = subs.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = "cast({} as decimal(20, 0)) * cast({} as decimal(3, 0))"
    covered = F.expr(f"{wide.format('longer', 100)} >= {wide.format('a', COVERED)}")
    return found.join(most, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 top: int = 2000) -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends and these into words at blanks and tabs, A-Z lower-cased.
    Phrases have two to four words of one piece and occur at least ``min_count`` times (``a``); ``l`` and ``r`` count
    the parts of the weakest cut, ``n`` all word occurrences of the language. Phrases covered by a longer one go.
    Ranked by score, then count (both descending), then phrase.

    Null texts are empty, a null language counts as ``und``; empty and blank texts add nothing, repeated rows count
    each, an empty table gives an empty result. Only the two named columns are read, so others cannot clash.
    """
    folder = shared_folder(docs.sparkSession)
    words = stored(word_counts(docs, text, lang), folder)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    edges = stored(graph(docs, words, min_count, text, lang), folder)
    counts, _ = phrase_counts(edges, min_count, folder)
    found = stored(scored(counts), folder)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = uncovered(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
