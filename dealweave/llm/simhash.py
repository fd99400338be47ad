"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints with at most four differing bits agree in the last
segment, or differ in at most one bit of one of the first two: otherwise they would differ in 2 + 2 + 1 bits or more.
So every fingerprint looks up the one-bit Hamming balls of its first two segments and its own value of the third in a
table of segment values, and each match is verified on all 64 bits.

Rows with equal fingerprints are merged before any join. A segment value shared by very many different fingerprints is
not paired out: its members meet at midpoints instead (two fingerprints are within four bits exactly if some 64-bit
value lies within two bits of both), which is one aggregation whose input grows linearly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import group_labels, map_texts, shared_folder, stored

#: Widths of the segments and how many bits may differ inside each for a link of at most four bits.
SEGMENTS = ((23, 1), (23, 1), (18, 0))
MAX_BITS = 4
#: Different fingerprints in one segment value up to which matches are verified one by one.
PAIRED = 1000


def _fingerprint(words: list[bytes], size: int, seed: int) -> int:
    if not words:
        return 0
    last = max(len(words) - size, 0)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + size]), seed) for i in range(last + 1)), np.uint64, last + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        octets = hashes[start:start + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4, seed: int = 42,
                 keep: list[str] | None = None) -> DataFrame:
    """Add ``fp`` (bigint): bit set where more than half of the word-shingle XXH64 hashes have it.

    Words are runs without ASCII white space, A-Z lower-cased; repeated shingles count each time. A text with fewer
    than ``size`` words has one shingle of all its words; null, empty or blank texts get 0. A column ``fp`` of the
    input is replaced.
    """

    def make():
        return lambda texts: {"fp": [_fingerprint(t.lower().split(), size, seed) for t in texts]}

    return map_texts(docs, text, make, "fp bigint", keep)


def _ball(width: int, radius: int) -> list[int]:
    """XOR masks of all values within ``radius`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _moved(value: Column, masks: list[int], seg: int) -> Column:
    """Array of (seg, value XOR mask) over all masks."""
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]),
                       lambda m: F.struct(F.lit(seg).alias("seg"), value.bitwiseXOR(m).alias("value")))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segment_values() -> list[Column]:
    values, at = [], 0
    for width, _ in SEGMENTS:
        values.append(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return values


def links(distinct: DataFrame, folder: str, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) that connect all different fingerprints within four bits of each other, directly or in chains
    of such links."""
    values = _segment_values()
    table = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), v.alias("value")) for i, v in enumerate(values)])).alias("s")).select("fp", "s.*")
    looks = [_moved(v, _ball(w, r), i) for i, ((w, r), v) in enumerate(zip(SEGMENTS, values, strict=True))]
    probes = distinct.select("fp", F.explode(F.concat(*looks)).alias("s")).select("fp", "s.*")
    crowded = stored(table.groupBy("seg", "value").count().where(F.col("count") > paired).select("seg", "value"), folder)
    busy = crowded.limit(1).count() > 0
    few = table.join(crowded, ["seg", "value"], "left_anti") if busy else table
    a, b = probes.alias("a"), few.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    met = (a.join(b, (F.col("a.seg") == F.col("b.seg")) & (F.col("a.value") == F.col("b.value"))
                  & (F.col("a.fp") < F.col("b.fp")) & near)
           .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    if not busy:
        return met
    members = probes.join(crowded, ["seg", "value"], "left_semi").select("fp").distinct()
    masks = [_signed(m) for m in _ball(64, MAX_BITS // 2)]
    middle = stored(members.select("fp", F.explode(_moved(F.col("fp"), masks, 0)).alias("s"))
                    .select("fp", F.col("s.value").alias("z")), folder)
    first = middle.groupBy("z").agg(F.min("fp").alias("b"))
    return met.union(middle.join(first, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4,
                    paired: int = PAIRED) -> DataFrame:
    """One row per document: ``doc_id``, ``fp``, ``component_id`` (smallest id reachable over links of at most four
    differing bits, itself included), ``label`` (smallest fingerprint of the component) and ``text_hash``.

    Null texts have fingerprint 0 and link like any other. A null id never becomes a component id unless the component
    has no other; repeated rows stay separate rows of one component. An empty table gives an empty result. Only the
    two named columns are read, so other columns cannot clash.
    """
    folder = shared_folder(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    marks = stored(fingerprints(source, "text", size, keep=["doc_id", "text_hash"]), folder)
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), folder)
    labels = group_labels(links(distinct.select("fp"), folder, paired), folder)
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label"))
    named = stored(named, folder)
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    owner = named.join(least, "label").select("fp", "label", "component_id")
    return marks.join(stored(owner, folder), "fp").select("doc_id", "fp", "component_id", "label", "text_hash")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """The document with the smallest id of each component, all columns kept. Rows that repeat that id count once.

    Components are those of ``near_duplicates`` with shingles of ``size`` words.
    """
    found = near_duplicates(docs, doc_id, text, size)
    first = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "label")
             .agg(F.min("text_hash").alias("text_hash")).select(F.col("doc_id").alias("of"), "text_hash"))
    first = stored(first).withColumnsRenamed({"of": "__of", "text_hash": "__hash"})
    own = docs.withColumns({"__id": F.col(doc_id), "__text": F.xxhash64(text)})
    one = own.join(first, own["__id"].eqNullSafe(first["__of"]) & (own["__text"] == first["__hash"]), "left_semi")
    return one.dropDuplicates(["__id", "__text"]).select(*docs.columns)
