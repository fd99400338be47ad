"""Spelling variants: words one edit apart, found by pivotal bigrams.

All bigrams have one order, the rare ones first. The prefix of a word are its three first bigrams in this order, with
all that tie with the third; its pivots are two disjoint bigrams of the prefix, chosen by dynamic programming for the
smallest total frequency. One edit destroys at most one pivot. Of two near words take the one whose prefix ends first:
a pivot of it that the edit leaves whole is also in the other's prefix.

Position limits are exact for one edit, since it lies wholly on one side of a pivot that survives. If it comes after
the first pivot, this pivot and all before it stand at the same place from the left; otherwise the second pivot and all
after it stand at the same place from the right. So each word is looked up twice, by its beginning up to the first pivot
and by its end from the second one on, in an index of beginnings and ends at the prefix bigrams. The rest of the two words, again one edit
apart, agrees in its first or its last half, which is part of the look-up as well. Every hit is then verified.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import shared_folder, stored, text_bytes, text_slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run of a document in so many loses a code point.
ONE_IN = 97
MIN_CHARS = 5
MIN_COUNT = 3
#: Classes of bigrams whose frequencies make the order; bigrams of one class count as the same.
CLASSES = 1 << 16
#: Different words that a task holds before it passes on its counts.
HELD_WORDS = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _count(shortest: int):
    def run(batches):
        held: dict[str, int] = {}

        def passed_on():
            made = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc, text in zip(part.column("id").to_pylist(), text_bytes(part.column("text")), strict=True):
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    times: dict[str, int] = {}
                    for run in RUN.findall(text.translate(_LOWER).decode("utf-8", "replace")):
                        if len(run) >= shortest:
                            times[run] = times.get(run, 0) + 1
                    for run, n in times.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % ONE_IN == 0:
                            run = run[:h % len(run)] + run[h % len(run) + 1:]
                            if len(run) < shortest:
                                continue
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD_WORDS:
                    yield passed_on()
        if held:
            yield passed_on()

    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``min_chars`` code points or more
    that occur ``min_count`` times or more.

    Let h be the crc32 of ``<doc_id>:<run>`` (a null id is empty): where 97 divides h the run loses code point h % length
    in this document. Null, empty and blank texts have no words; repeated rows count each.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    found = source.mapInArrow(_count(min_chars), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _class(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % CLASSES


def _class_counts(batches):
    counts = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for word in batch.column(0).to_pylist():
            for i in range(len(word) - 1):
                counts[_class(word[i:i + 2])] += 1
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"class": pa.array(used, pa.int64()), "n": pa.array(counts[used])})


class Pivots:
    """Prefixes and pivots under the order of bigram classes by frequency; bigrams of a class count as the same."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.known: dict[str, tuple[int, int]] = {}

    def _of(self, gram: str) -> tuple[int, int]:
        found = self.known.get(gram)
        if found is None:
            if len(self.known) >= CLASSES:
                self.known = {}
            c = _class(gram)
            found = self.known[gram] = int(self.rank[c]), int(self.counts[c])
        return found

    def of(self, word: str) -> tuple[list[int], int, int, int]:
        """Places of the prefix bigrams, of the left and the right pivot, and the order of the last prefix bigram."""
        order = [self._of(word[i:i + 2]) for i in range(len(word) - 1)]
        last = sorted(order)[2][0]
        prefix = [i for i, o in enumerate(order) if o[0] <= last]
        # the cheapest bigram that ends before place j starts is the best partner of j
        best, pair, cheapest, at, ready = None, (0, 0), None, 0, 0
        for j in prefix:
            while prefix[ready] <= j - 2:
                cost = order[prefix[ready]][1]
                if cheapest is None or cost < cheapest:
                    cheapest, at = cost, prefix[ready]
                ready += 1
            if cheapest is not None and (best is None or cheapest + order[j][1] < best):
                best, pair = cheapest + order[j][1], (at, j)
        return prefix, *pair, last


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def look_ups(word: str, pivots: Pivots) -> tuple[list[int], int]:
    """Keys by which a word is looked up: two sides, of the rest either half."""
    _, left, right, last = pivots.of(word)
    kept, rest = word[:left + 2], word[left + 2:]
    end, head = word[right:], word[:right]
    h, g = len(rest) // 2, len(head) // 2
    return [_key(f"<a{kept}|{rest[:h]}"), _key(f"<b{kept}|{rest[h:]}"), _key(f">a{end}|{head[:g]}"), _key(f">b{end}|{head[g:]}")], last


def index_keys(word: str, pivots: Pivots) -> tuple[list[int], int]:
    """Keys under which a word is found, for all halves that a rest one longer, as long or one shorter can have."""
    prefix, _, _, last = pivots.of(word)
    keys = []
    for i in prefix:
        for side, kept, rest in (("<", word[:i + 2], word[i + 2:]), (">", word[i:], word[:i])):
            n = len(rest)
            for first in {max(n - 1, 0) // 2, (n + 1) // 2}:
                keys.append(_key(f"{side}a{kept}|{rest[:first]}"))
            for second in {(max(n - 1, 0) + 1) // 2, (n + 2) // 2}:
                if second <= n:
                    keys.append(_key(f"{side}b{kept}|{rest[n - second:]}"))
    return keys, last


def _entries(counts: np.ndarray, keys_of):
    """Arrow batches of words (word, n) to ``key, last, word, n``."""

    def run(batches):
        pivots = Pivots(counts)
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                made = [keys_of(w, pivots) for w in part.column("word").to_pylist()]
                times = np.array([len(k) for k, _ in made], np.int64)
                which = pa.array(np.repeat(np.arange(len(made)), times))
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for keys, _ in made for k in keys], pa.int64()),
                    pa.array(np.repeat(np.array([x for _, x in made], np.int32), times)),
                    part.column("word").take(which), part.column("n").take(which)], names=["key", "last", "word", "n"])

    return run


_ENTRY = "key bigint, last int, word string, n bigint"


def near_words(words: DataFrame, folder: str | None = None) -> DataFrame:
    """``word, n, near, near_n``: all ordered pairs of different words that differ by exactly one inserted, deleted or
    replaced code point. ``words`` (word, n) has each word once, of four code points or more."""
    spark = words.sparkSession
    folder = folder or shared_folder(spark)
    words = words.select("word", "n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    classes = words.select("word").mapInArrow(_class_counts, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES, np.int64)
    for row in classes.toLocalIterator():  # at most CLASSES rows, whatever the number of words
        counts[row["class"]] = row["n"]
    asks = words.mapInArrow(_entries(counts, look_ups), _ENTRY).alias("a")
    index = words.mapInArrow(_entries(counts, index_keys), _ENTRY).alias("b")
    hit = ((F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last")) & (F.col("a.word") != F.col("b.word"))
           & (F.abs(F.length("a.word") - F.length("b.word")) <= 1) & (F.levenshtein("a.word", "b.word", 1) == 1))
    # Each word makes many keys, which Spark sizes as one row: it would broadcast the index of a small table of words.
    met = stored(asks.join(index.hint("merge"), hit).select(
        F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")), folder)
    return met.union(met.select("near", "near_n", "word", "n")).distinct()


def roots(links: DataFrame, folder: str) -> DataFrame:
    """``word, root`` of links (word, form) that lead from each word to a more frequent one: the last of the chain.

    Pointer doubling: each round joins every pointer with the pointer of where it leads, so chains of n links settle in
    about log2(n) rounds.
    """
    state = stored(links.select("word", F.col("form").alias("root")), folder)
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(state.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), folder)
        state = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return state


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
             min_count: int = MIN_COUNT, ratio: int = 2) -> DataFrame:
    """One row per word of ``vocabulary``: ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the near words. ``form`` is the near word of largest n (the smallest in code-point order of
    equals) if that n is at least ``ratio`` times the word's own, else null, and ``form_n`` its n. ``root`` is reached
    by following forms to the last; a word without form is its own root. Counts grow along a chain, so it ends.

    Texts, nulls and repeated rows are handled as in ``vocabulary``; an empty table gives an empty result. Only the two
    named columns are read, so others cannot clash.
    """
    if min_chars < 4 or ratio < 2:
        raise ValueError("words need four code points for two disjoint bigrams, and forms must be more frequent")
    folder = shared_folder(docs.sparkSession)
    words = stored(vocabulary(docs, doc_id, text, min_chars, min_count), folder)
    near = near_words(words, folder).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    near = stored(near.select(
        "word", "n_near", F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), folder)
    led = roots(near.where("form is not null").select("word", "form"), folder)
    return words.join(near, "word", "left").join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
