"""Removal of repeated word windows by difference-cover anchors.

A window is ``window`` consecutive words of one document; a word goes if a window over it has the words of a window that
starts earlier (smaller id, or the same id and an earlier start).

The places modulo ``period`` that belong to a difference cover are the anchors: any two places have a common shift
below ``period`` that takes both into the cover. So two equal windows share an anchor at the same offset, and only the
``window - period + 1`` words from each anchor on need a hash to find all candidates. An anchor seen twice is extended
to every window that can hold it at such an offset; windows are compared by 128 bits of hash over all their words.

Texts are stored once, in blocks, in a table bucketed by block. A block sends each of its hashes once, sorted and dealt
to parts by value, and gets one bit per hash back: hash tables of parts are of bounded size, a frequent anchor costs
one entry per block, and neither texts nor places of repeats are moved or paired.
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

WINDOW = 20
PERIOD = 13
BLOCK_BYTES = 2 << 20
#: Text bytes for each part of the hash tables; a part is handled in one piece.
PART_BYTES = 16 << 20

_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, (2, 4096), dtype=np.uint64) | np.uint64(1)
_BITS = "block bigint, part bigint, kind int, bits binary"


def difference_cover(period: int) -> list[int]:
    """Residues whose differences are all residues: each step adds the one with the most new differences."""
    cover, met = [0], {0}
    while len(met) < period:
        gains = {x: len({(x - y) % period for y in cover} | {(y - x) % period for y in cover} | met)
                 for x in range(period) if x not in cover}
        best = max(gains, key=lambda x: (gains[x], -x))
        met |= {(best - y) % period for y in cover} | {(y - best) % period for y in cover}
        cover.append(best)
    return sorted(cover)


class BlockWords:
    """Words of a block's texts, their hashes, anchors and candidate windows; the same at every call."""

    def __init__(self, data: bytes, sizes: np.ndarray, window: int, period: int):
        ends = np.cumsum(sizes).tolist()
        self.window, self.period = window, period
        self.split = [data[a:b].split() for a, b in zip([0, *ends], ends, strict=False)]
        self.counts = np.array([len(s) for s in self.split], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(self.counts)])
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for s in self.split for w in s), np.int64, int(self.edges[-1]))
        digest = b"".join(map(xxhash.xxh3_128_digest, index))
        self.hashes = np.frombuffer(digest, ">u8").astype(np.uint64).reshape(-1, 2)[ids]
        self.owner = np.repeat(np.arange(len(sizes)), self.counts)
        self._anchors()

    def _summed(self, at: np.ndarray, size: int, which: int) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for j in range(size):
            total += self.hashes[at + j, which] * _FACTORS[which, j]
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(29))

    def _anchors(self) -> None:
        """Different anchor hashes in order, how often each comes, and where."""
        size = self.window - self.period + 1
        place = np.arange(len(self.owner)) - self.edges[self.owner]
        of = self.counts[self.owner]
        fits = np.isin(place % self.period, difference_cover(self.period)) & (of >= self.window) & (place + size <= of)
        self.at = np.flatnonzero(fits)
        self.anchors, self.which, self.times = np.unique(
            self._summed(self.at, size, 0), return_inverse=True, return_counts=True)

    def extend(self, elsewhere: np.ndarray) -> None:
        """Windows around anchors found twice, here or ``elsewhere`` (one flag per anchor): their places and hashes."""
        twice = (self.times > 1) | elsewhere
        mark = np.zeros(len(self.owner) + 1, bool)
        for shift in range(self.period):
            start = self.at[twice[self.which]] - shift
            start = start[start >= 0]
            mark[start] = True
        start = np.flatnonzero(mark)
        own = self.owner[start]
        # a start before the anchor's own document belongs to another one; it is a window like any other
        self.starts = start[start + self.window <= self.edges[own + 1]]
        self.own = self.owner[self.starts]
        self.within = self.starts - self.edges[self.own]
        self.first_hash = self._summed(self.starts, self.window, 0)
        self.second_hash = self._summed(self.starts, self.window, 1)


def _dealt(values: np.ndarray, parts: int) -> np.ndarray:
    """Edges of the runs of sorted hashes that belong to each part."""
    part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, so that equal high bytes stand together and compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def _ids(ids: list) -> np.ndarray:
    """Ids as numbers; a null id counts as the largest."""
    top = np.iinfo(np.int64).max
    return np.array([top if i is None else i for i in ids], np.int64)


class _Firsts:
    """Different candidate windows of a block in order of hash, each with its earliest place in the block."""

    def __init__(self, words: BlockWords, ids: np.ndarray):
        a, b, doc, start = words.first_hash, words.second_hash, ids[words.own], words.within
        order = np.lexsort((start, doc, b, a))
        a, b, doc, start = a[order], b[order], doc[order], start[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.a, self.b, self.doc, self.start = a[first], b[first], doc[first], start[first]
        self.group = np.empty(len(a), np.int64)
        self.group[order] = group
        later = (doc != self.doc[group]) | (start != self.start[group]) if len(a) else np.zeros(0, bool)
        self.later = np.empty(len(a), bool)
        self.later[order] = later


def _answers(rows: pa.Table, kind: int, n: int, edges: np.ndarray) -> np.ndarray:
    """Flags that the parts sent back for a block's ``n`` hashes."""
    flags = np.zeros(n, bool)
    for part, which, bits in zip(*(rows.column(c).to_pylist() for c in ("part", "kind", "bits")), strict=True):
        if which == kind:
            low, high = int(edges[part]), int(edges[part + 1])
            flags[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
    return flags


def _bits(blocks: list[int], part: int, kind: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    made, at = [], 0
    for block, n in zip(blocks, sizes, strict=True):
        if flags[at:at + n].any():
            made.append((block, np.packbits(flags[at:at + n]).tobytes()))
        at += n
    return pa.table({
        "block": pa.array([m[0] for m in made], pa.int64()), "part": pa.array([part] * len(made), pa.int64()),
        "kind": pa.array([kind] * len(made), pa.int32()), "bits": pa.array([m[1] for m in made], pa.binary())})


def _seen_twice(rows: pa.Table) -> pa.Table:
    """Of one part: which anchors of each block are also in another block?"""
    found = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    _, which, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    return _bits(rows.column("block").to_pylist(), rows.column("part")[0].as_py(), 0, times[which] > 1, [len(f) for f in found])


def _seen_earlier(rows: pa.Table) -> pa.Table:
    """Of one part: which windows of each block have an earlier place in another block?"""
    a, b, doc, start = ([_values(x, kind) for x in rows.column(name).to_pylist()] for name, kind in (
        ("a", np.uint64), ("b", np.uint64), ("doc", np.int64), ("start", np.int64)))
    sizes = [len(x) for x in a]
    a, b, doc, start = (np.concatenate(x) for x in (a, b, doc, start))
    order = np.lexsort((start, doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.empty(len(a), bool)
    later[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return _bits(rows.column("block").to_pylist(), rows.column("part")[0].as_py(), 1, later, sizes)


def _blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per block of documents: ids, sizes of the texts, all bytes."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[doc_id].dataType)),
        T.StructField("sizes", T.BinaryType()), T.StructField("data", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        made = 0
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK_BYTES):
                texts = text_bytes(part.column("text"))
                block = TaskContext.get().partitionId() << 24 | made
                made += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([part.column("id").to_pylist()], arrow.field("ids").type),
                    pa.array([np.array([len(t) for t in texts], np.int64).tobytes()]),
                    pa.array([b"".join(texts)], pa.binary())], schema=arrow)

    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def remove_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   period: int = PERIOD) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept``.

    Words are runs without ASCII white space. Windows are judged on the input; the first place of a window stays.
    ``spans`` are the maximal removed runs as (start, end) word positions, ``kept`` the other words joined by one space.

    Null, empty and blank texts have no words, texts of fewer than ``window`` words lose none. Ids are integers; a null
    id counts as the largest. Rows that repeat an id are one document: windows at the same start do not remove each
    other, and each row gives a row. An empty table gives an empty result. Only the two named columns are read, so
    others cannot clash. A task holds one block, a longer text being a block of its own, or one part.
    """
    if not 1 <= period < window <= _FACTORS.shape[1]:
        raise ValueError("the period must be shorter than the window")
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError("ids must be integers")
    spark = docs.sparkSession
    folder = shared_folder(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"llm_windows_{uuid.uuid4().hex}"
    (_blocks(docs, doc_id, text).write.bucketBy(buckets, "block").option("path", f"{folder}/blocks")
     .option("compression", "zstd").saveAsTable(name))
    blocks = spark.table(name)
    total = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = total // PART_BYTES + 1

    def opened(block: pa.Table) -> BlockWords:
        return BlockWords(block.column("data")[0].as_py(), np.frombuffer(block.column("sizes")[0].as_py(), np.int64),
                          window, period)

    def anchors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                words = opened(row)
                edges = _dealt(words.anchors, parts)
                used = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(used, pa.int64()),
                    "block": pa.array([row.column("block")[0].as_py()] * len(used), pa.int64()),
                    "hashes": pa.array([words.anchors[edges[p]:edges[p + 1]].tobytes() for p in used], pa.binary())})

    sent = blocks.select("block", "sizes", "data").mapInArrow(anchors, "part bigint, block bigint, hashes binary")
    twice = stored(sent.groupBy("part").applyInArrow(_seen_twice, _BITS), folder)

    windows_schema = "part bigint, block bigint, a binary, b binary, doc binary, start binary"

    def windows(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:  # a block that answers name is always there
            raise RuntimeError("answers without a block")
        words = opened(block)
        words.extend(_answers(answers, 0, len(words.anchors), _dealt(words.anchors, parts)))
        firsts = _Firsts(words, _ids(block.column("ids")[0].as_py()))
        edges = _dealt(firsts.a, parts)
        used = np.flatnonzero(np.diff(edges))
        made = {
            "part": pa.array(used, pa.int64()),
            "block": pa.array([block.column("block")[0].as_py()] * len(used), pa.int64())}
        for column in ("a", "b", "doc", "start"):
            values = getattr(firsts, column)
            made[column] = pa.array([_planes(values[edges[p]:edges[p + 1]]) for p in used], pa.binary())
        return pa.table(made)

    source = blocks.select("block", "ids", "sizes", "data").groupBy("block")
    sent = source.cogroup(twice.groupBy("block")).applyInArrow(windows, windows_schema)
    earlier = stored(sent.groupBy("part").applyInArrow(_seen_earlier, _BITS), folder)

    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType)] + T.StructType.fromDDL(
        "n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept string").fields)
    arrow = to_arrow_schema(schema)

    def cut(block: pa.Table, answers: pa.Table) -> pa.Table:
        words = opened(block)
        words.extend(_answers(answers, 0, len(words.anchors), _dealt(words.anchors, parts)))
        ids = block.column("ids")[0].as_py()
        firsts = _Firsts(words, _ids(ids))
        away = _answers(answers, 1, len(firsts.a), _dealt(firsts.a, parts))
        gone_from = words.starts[firsts.later | away[firsts.group]]
        change = np.zeros(int(words.edges[-1]) + 1, np.int64)
        change[gone_from] += 1
        change[gone_from + window] -= 1
        gone = np.cumsum(change[:-1]) > 0
        spans, kept, removed = [], [], []
        for split, a, b in zip(words.split, words.edges.tolist(), words.edges[1:].tolist(), strict=False):
            mask = gone[a:b]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8))).tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)])
            stay = [0, *turns, len(split)]
            kept.append(b" ".join([w for x, y in zip(stay[::2], stay[1::2], strict=True) for w in split[x:y]]))
            removed.append(int(mask.sum()))
        return pa.table([
            pa.array(ids, arrow.field(0).type), pa.array(words.counts), pa.array(removed, pa.int64()),
            pa.array(spans, arrow.field(3).type), pa.array(kept, pa.string())], schema=arrow)

    answers = twice.union(earlier)
    return source.cogroup(answers.groupBy("block")).applyInArrow(cut, schema)
