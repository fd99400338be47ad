"""Removal of long repeated byte strings by a distributed, hash-compared suffix sort.

The bytes to remove are those of strings of ``length`` bytes that start at two places or more. Sorting all suffixes
would find them; sorting the few that can have an equal is enough. Each string of ``length`` bytes is filed under the
``gram`` in it with the smallest hash (the leftmost of equals), so equal strings are filed under equal grams at equal
offsets. Neighbouring strings with one such gram form a span, and grams found once in the corpus are done with.

* Spans with equal bytes are merged by an aggregation first: a span found twice or more is a repeat as a whole.
* Where a gram has different spans, their suffixes are sorted inside a task: mergesort, each comparison finding the
  common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours that agree in ``length``
  bytes are repeats, after their bytes have been compared.
* A gram with very many different spans would be one large task. Its spans are cut into pieces instead, equal pieces
  merged, and the strings of those that are alike but not equal dealt out by a 128-bit hash and counted.

Texts are stored once, in blocks, in a table bucketed by block; what is learned about a span goes to its block, and no
later step moves texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dealweave.llm.common import shared_folder, stored, text_bytes, text_slices

LENGTH = 200
GRAM = 32
#: Different spans of one gram up to which they are sorted together in a task.
SORTED_TOGETHER = 256
#: Strings of a piece of a span where a gram has more.
PIECE = 16
BLOCK_BYTES = 2 << 20
#: Strings hashed in one call.
SEGMENT = 1 << 20
#: Suffixes sorted in one call.
SORT_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


class PrefixHashes:
    """Polynomial hashes, modulo 2**64, of any substring of a byte array from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.down = np.full(n + 1, _INVERSE, np.uint64)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def spans_of(data: np.ndarray, sizes: np.ndarray, length: int, gram: int, segment: int):
    """Spans of texts that stand one after another: hash of the gram, its place, first string, strings less one.

    ``segment`` strings are hashed at once, so the memory for a text of any size is bounded; a span that crosses the
    end of a segment becomes two, filed under the same gram.
    """
    found = []
    for at in range(0, max(len(data) - length + 1, 1), segment):
        stop = min(at + segment + length - 1, len(data))
        ends = np.cumsum(sizes)
        first, last = np.searchsorted(ends, [at, stop], side="right")
        edges = np.clip(np.append(ends[first:last], stop), at, stop) - at
        g, place, start, more = _segment_spans(data[at:stop], np.diff(edges, prepend=0), length, gram)
        found.append((g, place + at, start + at, more))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segment_spans(data: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    none = np.zeros(0, np.int64)
    if len(data) < length or sizes.max(initial=0) < length:
        return none.astype(np.uint64), none, none, none
    grams = _mixed(PrefixHashes(data).of(np.arange(len(data) - gram + 1), gram))
    bits = np.uint64(len(data).bit_length())
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min((grams >> bits << bits) | place, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    least = least.astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:len(least)]
    start = np.arange(len(least))
    valid = start + length <= ends[owner]
    start, least, owner = start[valid], least[valid], owner[valid]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return grams[least[first]], least[first], start[first], start[last] - start[first]


def sorted_repeats(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes agree with another one of their group in their first ``length`` bytes?

    Bottom-up mergesort of all groups side by side. In each round every suffix finds its rank in the neighbouring run
    by binary search; a comparison takes the common extension, found by binary search over prefix hashes, and the byte
    after it. Suffixes are compared to ``length`` bytes.
    """
    repeated = np.zeros(len(starts), bool)
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    head = np.concatenate([[True], g[1:] != g[:-1]])
    size = np.diff(np.append(np.flatnonzero(head), len(g)))
    many = np.repeat(size > 1, size)
    order = order[many]
    if not len(order):
        return repeated
    size = size[size > 1]
    begin = np.repeat(np.cumsum(size) - size, size)
    end = begin + np.repeat(size, size)
    hashes = PrefixHashes(data)
    width = 1
    while width < size.max():
        at = np.arange(len(order))
        inside = at - begin
        run = begin + inside // (2 * width) * (2 * width)
        middle = np.minimum(run + width, end)
        left = at < middle
        low = np.where(left, middle, run)
        high = np.where(left, np.minimum(run + 2 * width, end), middle)
        base = low.copy()
        own = starts[order]
        while len(open_ := np.flatnonzero(low < high)):
            probe = (low[open_] + high[open_]) // 2
            sign = _compare(data, hashes, starts[order[probe]], own[open_], length)
            # equal suffixes keep the order of their runs
            goes = (sign < 0) | ((sign == 0) & ~left[open_])
            low[open_] = np.where(goes, probe + 1, low[open_])
            high[open_] = np.where(goes, high[open_], probe)
        target = at + np.where(left, low - base, low - base - (middle - run))
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    pair = np.flatnonzero(np.arange(len(order))[1:] < end[:-1]) if len(order) > 1 else np.zeros(0, np.int64)
    a, b = starts[order[pair]], starts[order[pair + 1]]
    equal = hashes.of(a, length) == hashes.of(b, length)
    pair, a, b = pair[equal], a[equal], b[equal]
    true = np.ones(len(pair), bool)
    reach = np.arange(length)
    for part in range(0, len(pair), 4096):
        s = slice(part, part + 4096)
        true[s] = (data[a[s, None] + reach] == data[b[s, None] + reach]).all(axis=1)
    repeated[order[pair[true]]] = repeated[order[pair[true] + 1]] = True
    for k in np.unique(groups[order[pair[~true]]]).tolist():  # a hash collision: the group is judged on its bytes
        members = np.flatnonzero(groups == k)
        texts = [data[s:s + length].tobytes() for s in starts[members].tolist()]
        repeated[members] = [texts.count(t) > 1 for t in texts]
    return repeated


def _compare(data, hashes, a, b, length):
    """Sign of the order of suffixes a and b, 0 if they agree in ``length`` bytes."""
    sign = np.zeros(len(a), np.int64)
    differ = np.flatnonzero(hashes.of(a, length) != hashes.of(b, length))
    a, b = a[differ], b[differ]
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length - 1)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    sign[differ] = np.sign(data[a + low].astype(np.int64) - data[b + low])
    return sign


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _blocks(docs: DataFrame, doc_id: str, text: str, length: int, gram: int) -> DataFrame:
    """One row per block of documents: ids, sizes, all bytes, and the spans (hashes of gram and bytes, places)."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[doc_id].dataType)),
        T.StructField("sizes", T.BinaryType()), T.StructField("data", T.BinaryType()),
        T.StructField("g", T.ArrayType(T.LongType())), T.StructField("s", T.ArrayType(T.LongType())),
        T.StructField("place", T.BinaryType()), T.StructField("start", T.BinaryType()), T.StructField("more", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        made = 0
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK_BYTES):
                texts = text_bytes(part.column("text"))
                joined = b"".join(texts)
                sizes = np.array([len(t) for t in texts], np.int64)
                g, place, start, more = spans_of(np.frombuffer(joined, np.uint8), sizes, length, gram, SEGMENT)
                s = np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(
                    start.tolist(), (start + more + length).tolist(), strict=True)), np.uint64, len(start))
                block = TaskContext.get().partitionId() << 16 | made
                made += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([part.column("id").to_pylist()], arrow.field("ids").type),
                    pa.array([sizes.tobytes()]), pa.array([joined], pa.binary()),
                    pa.array([_signed(g)], arrow.field("g").type), pa.array([_signed(s)], arrow.field("s").type),
                    *(pa.array([x.astype(np.int64).tobytes()]) for x in (place, start, more))], schema=arrow)

    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _row(block: pa.Table, *names: str) -> list:
    values = [block.column(n)[0].as_py() for n in names]
    return [np.frombuffer(v, np.int64) if n in ("sizes", "place", "start", "more") else v for n, v in zip(names, values, strict=True)]


_TEXTS = "g bigint, s bigint, n bigint, offset bigint, text binary"
_PIECES = ("g bigint, s bigint, n bigint, of bigint, i bigint, far bigint, j bigint, high bigint, low bigint, full bigint, "
           "core bigint")
_STRINGS = "g bigint, j bigint, full bigint, n bigint, d bigint, h bigint, k bigint"
_FOUND = "g bigint, s bigint, low bigint, high bigint"


def _span_texts(length: int):
    """Cogroup: bytes of asked spans of a block."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return pa.table({n.split()[0]: pa.array([], pa.binary() if n.endswith("binary") else pa.int64()) for n in _TEXTS.split(", ")})
        data, place, start, more = _row(block, "data", "place", "start", "more")
        i = asked.column("i").to_numpy()
        return pa.table({
            "g": asked.column("g"), "s": asked.column("s"), "n": asked.column("n"), "offset": pa.array(place[i] - start[i]),
            "text": pa.array([data[a:b] for a, b in zip(start[i].tolist(), (start + more + length)[i].tolist(), strict=True)], pa.binary())})

    return run


def _empty(ddl: str) -> pa.Table:
    return pa.table({n.split()[0]: pa.array([], pa.int64()) for n in ddl.split(", ")})


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes of parts of the data, as two columns."""
    found = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _pieces(length: int):
    """Cogroup: the asked spans in pieces of up to ``PIECE`` strings, at aligned distances to the gram.

    ``full`` is a hash of all bytes of a piece and its distances, ``core`` of the bytes that any string of the whole
    aligned piece holds.
    """

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return _empty(_PIECES)
        data, place, start, more = _row(block, "data", "place", "start", "more")
        i = asked.column("i").to_numpy()
        far, near = place[i] - start[i], place[i] - start[i] - more[i]
        times = far // PIECE - near // PIECE + 1
        which = np.repeat(np.arange(len(i)), times)
        j = near[which] // PIECE + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        high, low = np.minimum(j * PIECE + PIECE - 1, far[which]), np.maximum(j * PIECE, near[which])
        x = place[i][which]
        full = _digests(data, x - high, x - low + length)[:, 0] ^ (high << 16 | low)
        core = _digests(data, x - j * PIECE, x - j * PIECE - PIECE + 1 + length)[:, 0]
        own = [asked.column(n).to_numpy()[which] for n in ("g", "s", "n")]
        return pa.table(dict(zip([n.split()[0] for n in _PIECES.split(", ")], [
            *own, asked.column("of").to_numpy()[which], i[which], far[which], j, high, low, full, core], strict=True)))

    return run


def _strings(length: int):
    """Cogroup: every string of the asked pieces, by its distance to the gram and a hash of its bytes."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return _empty(_STRINGS)
        data, place = _row(block, "data", "place")
        high, low = (asked.column(n).to_numpy() for n in ("high", "low"))
        times = high - low + 1
        which = np.repeat(np.arange(len(high)), times)
        d = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        first = place[asked.column("i").to_numpy()][which] - d
        h, k = _digests(data, first, first + length).T
        own = [asked.column(n).to_numpy()[which] for n in ("g", "j", "full", "n")]
        return pa.table(dict(zip([n.split()[0] for n in _STRINGS.split(", ")], [*own, d, h.copy(), k.copy()], strict=True)))

    return run


def _counted(blocks: DataFrame, asked: DataFrame, length: int, folder: str) -> DataFrame:
    """Repeated strings of spans whose grams have too many different spans to be sorted in one task (g, s, low, high).

    Equal pieces are merged and repeated as a whole. Pieces that differ but have a core in common are compared string
    by string, by counting; all others hold no repeat.
    """
    source = blocks.select("block", "data", "place", "start", "more").groupBy("block")
    pieces = stored(source.cogroup(asked.groupBy("of")).applyInArrow(_pieces(length), _PIECES), folder)
    merged = pieces.groupBy("g", "j", "full").agg(
        F.sum("n").alias("n"), F.min("core").alias("core"), F.min(F.shiftleft("of", 24).bitwiseOR(F.col("i"))).alias("p"),
        F.min("high").alias("high"), F.min("low").alias("low"))
    merged = stored(merged, folder)
    cores = merged.groupBy("g", "j", "core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    alike = merged.join(cores, ["g", "j", "core"], "left_semi").select(
        F.shiftright("p", 24).alias("of"), F.col("p").bitwiseAND(F.lit((1 << 24) - 1)).alias("i"), "g", "j", "full", "n", "high", "low")
    source = blocks.select("block", "data", "place").groupBy("block")
    strings = stored(source.cogroup(alike.groupBy("of")).applyInArrow(_strings(length), _STRINGS), folder)
    again = strings.groupBy("g", "d", "h", "k").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    single = strings.where("n = 1").join(again, ["g", "d", "h", "k"], "left_semi")
    marks = merged.where("n > 1").select("g", "j", "full", "high", "low").union(
        single.select("g", "j", "full", F.col("d").alias("high"), F.col("d").alias("low")))
    return pieces.select("g", "s", "far", "j", "full").join(stored(marks, folder), ["g", "j", "full"]).select(
        "g", "s", (F.col("far") - F.col("high")).alias("low"), (F.col("far") - F.col("low")).alias("high"))


def _sorter(length: int):
    """Arrow batches of span texts in order of g: runs of repeated strings inside each span."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[4]) for r in rows], np.int64)
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        times = sizes - length + 1
        which = np.repeat(np.arange(len(rows)), times)
        at = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        starts = (np.cumsum(sizes) - sizes)[which] + at
        distance = np.array([r[3] for r in rows], np.int64)[which] - at
        gram = np.unique([r[0] for r in rows], return_inverse=True)[1][which]
        again = sorted_repeats(data, starts, gram * (length + 1) + distance, length)
        again = np.concatenate([[False], again, [False]])
        edge = np.flatnonzero((again[1:] != again[:-1]) | np.concatenate([[False], (at == 0)[1:] & again[1:-2], [False]]))
        low = [e for e in edge.tolist() if e < len(which) and again[e + 1]]
        high = np.array([*(e for e in edge.tolist()), len(which)])
        stop = high[np.searchsorted(high, np.array(low, np.int64), side="right")] if low else np.zeros(0, np.int64)
        own = which[low] if low else np.zeros(0, np.int64)
        return pa.RecordBatch.from_pydict({
            "g": pa.array([rows[k][0] for k in own], pa.int64()), "s": pa.array([rows[k][1] for k in own], pa.int64()),
            "low": pa.array(at[low] if low else [], pa.int64()),
            "high": pa.array(at[stop - 1] if low else [], pa.int64())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and size > SORT_BYTES:
                    yield judged(held)
                    held, size = [], 0
                if held and row[:2] == held[-1][:2]:
                    continue
                held.append(row)
                size += len(row[4])
        if held:
            yield judged(held)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   together: int = SORTED_TOGETHER) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans, kept``.

    A byte of a text (UTF-8) is removed if a string of ``length`` bytes that covers it also starts at another place of
    any text, the same one included. Strings never reach over the end of a text and are judged on the input, so all
    copies of a repeat go. ``spans`` are the maximal removed runs as (start, end) byte positions, ``kept`` the
    remaining bytes. Null and empty texts have no bytes. Rows that repeat an id stay rows of their own. An empty table
    gives an empty result. Only the two named columns are read.
    """
    if gram > length or length < PIECE:
        raise ValueError(f"strings have at least {PIECE} bytes and hold a gram")
    spark = docs.sparkSession
    folder = shared_folder(spark)
    name = f"llm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _blocks(docs, doc_id, text, length, gram).write.bucketBy(buckets, "block").option("path", f"{folder}/blocks").saveAsTable(name)
    blocks = spark.table(name)
    filed = blocks.select("block", F.posexplode(F.arrays_zip("g", "s"))).select(
        F.col("col.g").alias("g"), F.col("col.s").alias("s"), F.shiftleft("block", 24).bitwiseOR(F.col("pos")).alias("place"))
    # written, so that the join has a shuffle of its own on both sides and a frequent gram can be split
    twice = stored(filed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), folder)
    filed = stored(filed.join(twice, "g", "left_semi"), folder)
    kinds = stored(filed.groupBy("g", "s").agg(F.count("*").alias("n"), F.min("place").alias("place")), folder)
    many = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = kinds.join(many, "g").select(
        F.shiftright("place", 24).alias("of"), F.col("place").bitwiseAND(F.lit((1 << 24) - 1)).alias("i"), "g", "s", "n", "kinds")
    asked = stored(asked, folder)
    source = blocks.select("block", "data", "place", "start", "more").groupBy("block")
    few = source.cogroup(asked.where(F.col("kinds") <= together).groupBy("of")).applyInArrow(_span_texts(length), _TEXTS)
    found = few.repartition("g").sortWithinPartitions("g", "s").mapInArrow(_sorter(length), _FOUND)
    crowded = asked.where(F.col("kinds") > together)
    if crowded.limit(1).count():
        found = found.union(_counted(blocks, crowded, length, folder))
    # a span found twice is repeated as a whole; its high end is cut to the span where it is read
    whole = kinds.where("n > 1").select("g", "s", F.lit(0).cast("bigint").alias("low"), F.lit(1 << 40).alias("high"))
    found = stored(whole.union(found.join(kinds.where("n > 1"), ["g", "s"], "left_anti")), folder)
    marks = filed.join(found, ["g", "s"]).select(
        F.shiftright("place", 24).alias("of"), F.col("place").bitwiseAND(F.lit((1 << 24) - 1)).alias("i"), "low", "high")
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType)] + T.StructType.fromDDL(
        "n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary").fields)
    arrow = to_arrow_schema(schema)

    def cut(block: pa.Table, marked: pa.Table) -> pa.Table:
        ids, sizes, data, start, more = _row(block, "ids", "sizes", "data", "start", "more")
        change = np.zeros(len(data) + 1, np.int32)
        if marked.num_rows:
            i, low, high = (marked.column(n).to_numpy() for n in ("i", "low", "high"))
            np.add.at(change, start[i] + low, 1)
            np.add.at(change, start[i] + np.minimum(high, more[i]) + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        octets = np.frombuffer(data, np.uint8)
        removed, spans, kept, at = [], [], [], 0
        for n in sizes.tolist():
            mask = gone[at:at + n]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8))).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            removed.append(int(mask.sum()))
            kept.append(octets[at:at + n][~mask].tobytes())
            at += n
        return pa.table([
            pa.array(ids, arrow.field(0).type), pa.array(sizes), pa.array(removed, pa.int64()),
            pa.array(spans, arrow.field(3).type), pa.array(kept, pa.binary())], schema=arrow)

    return blocks.select("block", "ids", "sizes", "data", "start", "more").groupBy("block").cogroup(
        marks.groupBy("of")).applyInArrow(cut, schema)
