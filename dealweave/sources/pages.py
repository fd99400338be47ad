"""Exported workspace pages (JSON) to typed tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealweave.functions.order import as_col

# The property shapes of an exported page, as Spark reads them.
_SIMPLE_PROPERTY = ",".join((
    "type:string",
    "title:array<struct<plain_text:string>>",
    "rich_text:array<struct<plain_text:string>>",
    "`select`:struct<name:string>",
    "status:struct<name:string>",
    "multi_select:array<struct<name:string>>",
    "date:struct<start:string>",
    "checkbox:boolean",
    "number:double",
    "url:string",
    "email:string",
    "phone_number:string",
    "people:array<struct<id:string>>",
    "relation:array<struct<id:string>>",
    "created_time:string",
    "last_edited_time:string",
    "created_by:struct<id:string>",
    "last_edited_by:struct<id:string>",
    "files:array<struct<name:string>>",
    "unique_id:struct<number:bigint,prefix:string>",
    "formula:struct<type:string,`string`:string,number:double,boolean:boolean,date:struct<start:string>>",
))
_ROLLUP = f"rollup:struct<type:string,number:double,date:struct<start:string>,array:array<struct<{_SIMPLE_PROPERTY}>>>"
PROPERTY = f"struct<{_SIMPLE_PROPERTY},{_ROLLUP}>"
PAGE_SCHEMA = f"object string, id string, in_trash boolean, archived boolean, properties map<string,{PROPERTY}>"


@dataclass(frozen=True)
class SourceColumn:
    """Property ``title`` of a page becomes column ``name``, converted as ``kind``."""

    title: str
    name: str
    kind: str


def _one(text: str) -> str:
    """SQL: plain value as a one-element list, NULL for NULL and empty text."""
    return f"if(nullif({text}, '') is not null, array({text}), null)"


def _number(n: str) -> str:
    """SQL: number as text, without a decimal point when it is whole."""
    return f"if({n} = floor({n}) and abs({n}) < 1e15, cast(cast({n} as bigint) as string), cast({n} as string))"


def _list(items: str, value: str) -> str:
    return f"transform(coalesce({items}, array()), x -> {value})"


def _plain_value(p: str, page_url: str) -> str:
    """SQL: value of the property ``p`` of any type but a rollup, as ``array<string>``.

    Lists stay lists (they may be empty), single values become one element, absent ones NULL.
    """
    formula = f"{p}.formula"
    number = f"cast({p}.unique_id.number as string)"
    values = {
        "title": _one(f"array_join({p}.title.plain_text, '')"),
        "rich_text": _one(f"array_join({p}.rich_text.plain_text, '')"),
        "select": _one(f"{p}.`select`.name"),
        "status": _one(f"{p}.status.name"),
        "multi_select": _list(f"{p}.multi_select", "x.name"),
        "date": _one(f"{p}.date.start"),
        "checkbox": f"array(cast(coalesce({p}.checkbox, false) as string))",
        "number": _one(_number(f"{p}.number")),
        "url": _one(f"{p}.url"),
        "email": _one(f"{p}.email"),
        "phone_number": _one(f"{p}.phone_number"),
        "people": _list(f"{p}.people", "concat('user://', x.id)"),
        "relation": _list(f"{p}.relation", f"concat('{page_url}', replace(x.id, '-', ''))"),
        "created_time": _one(f"{p}.created_time"),
        "last_edited_time": _one(f"{p}.last_edited_time"),
        "created_by": _one(f"concat('user-', {p}.created_by.id)"),
        "last_edited_by": _one(f"concat('user-', {p}.last_edited_by.id)"),
        "files": _list(f"{p}.files", "x.name"),
        "unique_id": _one(f"concat(coalesce(concat(nullif({p}.unique_id.prefix, ''), '-'), ''), {number})"),
        "formula": _one(
            f"case {formula}.type when 'date' then {formula}.date.start when 'number' then {_number(formula + '.number')} "
            f"when 'boolean' then cast({formula}.boolean as string) else {formula}.`string` end"),
    }
    return _case(f"{p}.type", values)


def _case(subject: str, values: dict[str, str]) -> str:
    return f"case {subject} " + " ".join(f"when '{kind}' then {sql}" for kind, sql in values.items()) + " end"


def property_value(p: str, page_url: str) -> str:
    """SQL: value of the property ``p`` of any type. A rollup of a list is flattened and its blanks removed."""
    items = f"flatten(transform({p}.rollup.array, r -> coalesce({_plain_value('r', page_url)}, array())))"
    rollup = _case(f"{p}.rollup.type", {
        "array": f"filter({items}, v -> v is not null and v <> '')",
        "date": _one(f"{p}.rollup.date.start"),
        "number": _one(_number(f"{p}.rollup.number")),
    })
    return f"case when {p}.type = 'rollup' then {rollup} else {_plain_value(p, page_url)} end"


def _plain_properties(columns: Sequence[SourceColumn], page_url: str) -> Column:
    """Mapped properties of a page with their values.

    One expression reads any property, so the plan stays the same size however many columns a source maps.
    """
    titles = ", ".join("'" + c.title.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in columns)
    return F.expr(
        f"transform_values(map_filter(properties, (t, p) -> t in ({titles})), (t, p) -> {property_value('p', page_url)})")


def extract_properties(pages: DataFrame, columns: Sequence[SourceColumn],
                       page_url: str = "https://pages.example/") -> DataFrame:
    """Page id and, per mapped property, its raw values as ``array<string>``."""
    read = pages.select("id", _plain_properties(columns, page_url).alias("_p"))
    return read.select("id", *[F.col("_p")[c.title].alias(c.name) for c in columns])


# Texts of a ticked checkbox. The number 1 is one too, the text "1" is not.
TRUE_SPELLINGS = ("__YES__", "true")


def convert(c: str | Column, kind: str, is_number: Column | None = None) -> Column:
    """Text value of a source column as its declared kind. An empty text is NULL for every kind.

    ``arr`` reads a JSON list as it is, else wraps the text; ``arrsplit`` also splits at ``;``, trims and drops
    blanks; ``num`` gives NULL for anything that is not a finite number; ``date`` keeps the first ten characters.
    ``is_number`` tells for ``bool`` whether the text came from a number.
    """
    text = F.nullif(as_col(c), F.lit(""))
    if kind not in ("arr", "arrsplit"):
        return convert_values(F.when(text.isNotNull(), F.array(text)), kind, is_number)
    listed = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    values = F.when(text.isNotNull(), F.coalesce(listed, F.array(text)))
    return values if kind == "arr" else convert_values(values, kind)


def convert_values(values: Column, kind: str, is_number: Column | None = None) -> Column:
    """Like ``convert`` for values that already are a list."""
    present = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    first = F.nullif(F.get(values, F.lit(0)), F.lit(""))
    if kind == "arr":
        return F.when(F.size(present) > 0, present)
    if kind == "arrsplit":
        parts = F.flatten(F.transform(present, lambda x: F.split(x, r"\s*;\s*")))
        return F.when(F.size(present) > 0, F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))
    if kind == "bool":
        ticked = first.isin(*TRUE_SPELLINGS)
        if is_number is not None:
            ticked = ticked | (F.coalesce(is_number, F.lit(False)) & (first == "1"))
        return F.when(first.isNotNull(), ticked)
    if kind == "num":
        number = first.try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if kind == "date":
        return F.substring(first, 1, 10).try_cast("date")
    if kind == "ts":
        return first.try_cast("timestamp")
    if kind == "text":
        return F.when(F.size(values) > 0, F.array_join(values, ", "))
    raise ValueError(f"unknown kind {kind}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files with the declared schema; only the properties a query maps are parsed into columns."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def load_source(pages: DataFrame, columns: Sequence[SourceColumn], stamp: Column,
                page_url: str = "https://pages.example/") -> DataFrame:
    """Typed rows of one source: live pages only, mapped columns, id, link and the stamp of this run."""
    live = pages.filter(
        (F.col("object") == "page") & ~F.coalesce("in_trash", F.lit(False)) & ~F.coalesce("archived", F.lit(False)))
    read = live.select("id", _plain_properties(columns, page_url).alias("_p"), *_number_flags(columns))
    cells = [convert_values(F.col("_p")[c.title], c.kind, _flag(c)).alias(c.name) for c in columns]
    return read.select("id", F.concat(F.lit(page_url), F.replace("id", F.lit("-"), F.lit(""))).alias("url"), *cells, stamp.alias("synced_at"))


def _number_flags(columns: Sequence[SourceColumn]) -> list[Column]:
    """Per boolean column: is its property a number?"""
    return [(F.col("properties")[c.title]["type"] == "number").alias(f"_n_{c.name}") for c in columns if c.kind == "bool"]


def _flag(column: SourceColumn) -> Column | None:
    return F.col(f"_n_{column.name}") if column.kind == "bool" else None


def rejected_values(pages: DataFrame, columns: Sequence[SourceColumn], page_url: str = "https://pages.example/") -> DataFrame:
    """(column, kind, rejected): how many values of a page table do not fit the kind of their column and become NULL."""
    strict = [c for c in columns if c.kind in ("num", "date", "ts")]
    read = pages.select(_plain_properties(columns, page_url).alias("_p"))
    checks = F.array(*[F.struct(
        F.lit(c.name).alias("column"), F.lit(c.kind).alias("kind"),
        (F.nullif(F.get(F.col("_p")[c.title], F.lit(0)), F.lit("")).isNotNull()
         & convert_values(F.col("_p")[c.title], c.kind).isNull()).alias("bad")) for c in strict])
    return read.select(F.explode(checks).alias("c")).groupBy("c.column", "c.kind").agg(
        F.count_if("c.bad").alias("rejected"))
