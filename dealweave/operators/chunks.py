"""Cut long texts into numbered parts of bounded length, along lines and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from dealweave.operators.rows import with_group_value

#: Texts whose pieces a task holds at once.
TEXTS_AT_ONCE = 256

_SENTENCE_END = re.compile(r".*[.!?](?=\s)", re.S)
_LAST_SPACE = re.compile(r".*(?=\s)", re.S)


def _head(line: str, size: int) -> str:
    """Longest leading piece of at most ``size`` characters: up to a sentence end, else a space, else all of it."""
    window = line[:size]
    for pattern in (_SENTENCE_END, _LAST_SPACE):
        found = pattern.match(window)
        if found and found.group():
            return found.group()
    return window


def chunk_text(text: str | None, size: int) -> Iterator[str]:
    """Pieces of one text. Lines are packed together as long as they fit; a longer line is cut on its own."""
    held: list[str] = []
    length = 0
    for raw in (text or "").split("\n"):
        line = raw.strip(" ")
        while len(line) > size:
            if held:
                yield "\n".join(held)
                held, length = [], 0
            piece = _head(line, size)
            yield piece
            line = line[len(piece):].strip(" ")
        if not line:
            continue
        if held and length + len(line) + 1 > size:
            yield "\n".join(held)
            held, length = [], 0
        length += len(line) + (1 if held else 0)
        held.append(line)
    if held:
        yield "\n".join(held)


def chunk_documents(df: DataFrame, doc_id: str, text: str, size: int | str = 1600) -> DataFrame:
    """(doc_id, part, chunk, parts): numbered parts of every text.

    ``size`` is a number or the name of a column holding one. Each task cuts the whole texts of its own rows; the
    number of parts comes from an aggregate over (doc_id).
    """
    sized = df.select(F.col(doc_id), F.col(text).alias("_text"),
                      (F.col(size) if isinstance(size, str) else F.lit(size)).cast("int").alias("_size"))
    schema = T.StructType([df.schema[doc_id], T.StructField("part", T.IntegerType()),
                           T.StructField("chunk", T.StringType()), T.StructField("parts", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                pieces = [list(chunk_text(body, limit)) for body, limit in zip(
                    part.column("_text").to_pylist(), part.column("_size").to_pylist())]
                own = [i for i, found in enumerate(pieces) for _ in found]
                yield pa.RecordBatch.from_arrays([
                    part.column(doc_id).take(pa.array(own, pa.int64())),
                    pa.array([n for found in pieces for n in range(1, len(found) + 1)], pa.int32()),
                    pa.array([piece for found in pieces for piece in found], pa.string()),
                    pa.array([len(pieces[i]) for i in own], pa.int32())], names=[doc_id, "part", "chunk", "parts"])

    return sized.filter(F.col("_text").isNotNull()).mapInArrow(cut, schema)


def count_parts(chunks: DataFrame, doc_id: str, out: str = "parts") -> DataFrame:
    """Number of parts of each text next to every part."""
    return with_group_value(chunks, [doc_id], **{out: F.count(F.lit(1))})


@udtf(returnType="part int, chunk string")
class TextChunks:
    """Table function form: ``SELECT ... FROM docs, LATERAL text_chunks(docs.text, 1600)``."""

    def eval(self, text: str, size: int):
        for i, piece in enumerate(chunk_text(text, size), 1):
            yield i, piece


def register_text_chunks(spark, name: str = "text_chunks") -> None:
    spark.udtf.register(name, TextChunks)
