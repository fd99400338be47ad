"""Join shapes: existence flags, pattern joins, nearest dates, alias look-ups and row splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dealweave.functions.order import newest, oldest
from dealweave.functions.text import LIST_SEPARATOR, name_key
from dealweave.operators.rows import first_per_group
from dealweave.session import materialised

#: Size of one broadcast block of patterns.
PATTERN_BLOCK_BYTES = 4 << 20
#: Names in one part of what a text matches, and parts in one Arrow batch.
PART_NAMES = 1_000
PARTS_AT_ONCE = 256
#: Least number of shares that the pairs of texts and patterns are made in.
PAIR_SHARES = 64
#: Most copies of a row that are dealt out to meet the parts of what its text matches.
PAIR_LANES = 8


# --- existence -------------------------------------------------------------------------------------------------

def with_exists(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """EXISTS as a boolean column: false for unmatched and for NULL keys."""
    found = other.select(*on).distinct().withColumn("_found", F.lit(True))
    return df.join(found, list(on), "left").withColumn(name, F.coalesce("_found", F.lit(False))).drop("_found")


def with_in_flag(df: DataFrame, other: DataFrame, column: str, other_column: str, name: str) -> DataFrame:
    """``column IN (other)`` as a three-valued column.

    NULL for a NULL key, unless ``other`` is empty, when it is false; and NULL for an unmatched key when ``other``
    itself holds a NULL.
    """
    values = other.select(F.col(other_column).alias("_value"))
    state = values.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_value").isNull()).alias("nulls"))
    size = state.select("n").scalar()
    nulls = state.select("nulls").scalar()
    found = values.filter(F.col("_value").isNotNull()).distinct().withColumn("_found", F.lit(True))
    flag = (
        F.when(size == 0, F.lit(False))
        .when(F.col(column).isNull(), F.lit(None).cast("boolean"))
        .when(F.col("_found"), F.lit(True))
        .when(nulls > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
    joined = df.join(found, df[column] == found["_value"], "left")
    return joined.withColumn(name, flag).drop("_value", "_found")


def with_other_owner(df: DataFrame, evidence: DataFrame, value: str, owner: str, name: str) -> DataFrame:
    """Does the row's value also belong to another owner in ``evidence``?

    Two bounds per value (least and greatest owner) answer it, so the rows sharing a value are never paired up.
    """
    bounds = evidence.groupBy(F.col(value).alias("_value")).agg(
        F.min(owner).alias("_least"), F.max(owner).alias("_greatest")
    )
    other = (F.col("_least") != F.col(owner)) | (F.col("_greatest") != F.col(owner))
    joined = df.join(bounds, df[value] == bounds["_value"], "left")
    return joined.withColumn(name, F.coalesce(other, F.lit(False))).drop("_value", "_least", "_greatest")


# --- patterns --------------------------------------------------------------------------------------------------

def valid_patterns(patterns: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Patterns that compile and those that do not, judged by the engine that runs them (the ``regex`` package)."""
    different = patterns.select(F.col(pattern).alias("_pattern")).distinct()
    # Dealt by a stated number: compiling costs far more than the few bytes by which shuffles are sized.
    different = different.repartition(patterns.sparkSession.sparkContext.defaultParallelism, "_pattern")
    flags = different.mapInPandas(_compiles, "_pattern string, _ok boolean")
    judged = patterns.join(flags, F.col(pattern).eqNullSafe(F.col("_pattern")), "left")
    return tuple(judged.filter(c).select(*patterns.columns) for c in (F.col("_ok"), ~F.col("_ok")))


def _compiled(text: str):
    return regex.compile(text, regex.IGNORECASE | regex.DOTALL)


def _compiles(batches):
    def ok(text) -> bool:
        try:
            _compiled(text)
            return True
        except (regex.error, TypeError):
            return False

    for batch in batches:
        yield batch.assign(_ok=batch["_pattern"].map(ok))


_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?:|(?:[*+?]|\{\d*,?\d*\})[?+]?|.", re.DOTALL)
_REPEAT = re.compile(r"([*+?]|\{(\d*),?\d*\})[?+]?")
#: Letters outside ASCII that equal an ASCII letter when case is ignored.
_FOLDED = str.maketrans({"\u017f": "s", "\u212a": "k", "\u0130": "i", "\u0131": "i"})


class _Unclear(Exception):
    """The pattern holds something whose matches are not looked into."""


def required_literals(pattern: str) -> tuple[str, ...]:
    """Runs of ASCII letters and digits of which every match holds at least one, in any case; empty when none is certain.

    Of a sequence the longest run or group counts, of a choice all its branches. Look-arounds, flags, fuzzy counts, and
    escapes other than ``\\b \\d \\s \\w`` and punctuation are not looked into, so the answer may be missing, never wrong.
    """
    if "[:" in pattern or "[[" in pattern:
        return ()
    tokens = _TOKEN.findall(pattern)
    at = 0

    def repeats() -> str | None:
        """Kind of the repeat that follows: None, ``some`` (once at least) or ``any``."""
        nonlocal at
        found = _REPEAT.fullmatch(tokens[at]) if at < len(tokens) else None
        if not found:
            return None
        at += 1
        sign, least = found[1], found[2]
        return "some" if sign == "+" or (least or "0").strip("0") else "any"

    def choice() -> tuple[str, ...]:
        nonlocal at
        branches = [sequence()]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            branches.append(sequence())
        return tuple(sorted(set().union(*branches))) if all(branches) else ()

    def sequence() -> tuple[str, ...]:
        nonlocal at
        known: list[tuple[str, ...]] = [()]
        run = ""
        while at < len(tokens) and tokens[at] not in "|)":
            token = tokens[at]
            at += 1
            if token in ("(", "(?:"):
                inner = choice()
                if at == len(tokens) or (at < len(tokens) and tokens[at] != ")"):
                    raise _Unclear
                at += 1
                known += [(run,)] if run else []
                run = ""
                if repeats() != "any":
                    known.append(inner)
                continue
            if _REPEAT.fullmatch(token) or token == "{" or re.fullmatch(r"\\[0-9A-Za-z]", token) and token[1] not in "bBdDsSwW":
                raise _Unclear
            plain = re.fullmatch("[0-9A-Za-z]", token) is not None
            repeat = repeats()
            if plain and repeat != "any":
                run += token.lower()
            if not plain or repeat:
                known += [(run,)] if run else []
                run = ""
        known += [(run,)] if run else []
        return max(known, key=lambda texts: (min(map(len, texts), default=0), -len(texts)))

    try:
        found = choice()
        return found if at == len(tokens) else ()
    except _Unclear:
        return ()


def required_text(pattern: str) -> str:
    """The one run of letters and digits that every match holds in any case; empty when none is certain."""
    found = required_literals(pattern)
    return found[0] if len(found) == 1 else ""


def candidate_finder(literals: Sequence[Sequence[str]]):
    """``find(text)``: ascending numbers of the patterns whose literals the text holds, and of those without any.

    All literals go into one automaton, so a text is read once however many patterns there are.
    """
    always = [i for i, texts in enumerate(literals) if not texts]
    owners: dict[str, list[int]] = {}
    for i, texts in enumerate(literals):
        for text in texts:
            owners.setdefault(text, []).append(i)
    automaton = ahocorasick.Automaton()
    for text, numbers in owners.items():
        automaton.add_word(text, (text, numbers))
    if owners:
        automaton.make_automaton()

    def find(text: str) -> list[int]:
        if not owners:
            return always
        held = {word: numbers for _, (word, numbers) in automaton.iter(text.translate(_FOLDED).lower())}
        return sorted({*always, *(i for numbers in held.values() for i in numbers)})

    return find


def pattern_blocks(patterns: DataFrame, name: str, pattern: str) -> list:
    """The patterns as broadcast blocks of at most ``PATTERN_BLOCK_BYTES`` each."""
    context, blocks, held, size = patterns.sparkSession.sparkContext, [], [], 0
    for row in patterns.select(name, pattern).toLocalIterator():
        held.append((row[0], row[1], required_literals(row[1])))
        size += len(row[1]) + 64
        if size > PATTERN_BLOCK_BYTES:
            blocks.append(context.broadcast(held))
            held, size = [], 0
    return [*blocks, context.broadcast(held)] if held else blocks


def _matched(blocks: list, parts: T.StructType):
    """From batches of different texts to rows (text, part, parts, names) of the patterns they match, part by part."""
    types = [to_arrow_type(f.dataType) for f in parts.fields]

    def run(batches):
        held = [entry for b in blocks for entry in b.value]
        find = candidate_finder([literals for _, _, literals in held])
        search: dict[int, Callable] = {}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(column, type=kind) for column, kind in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=parts.names)

        for texts in batches:
            for value in texts.column(0).to_pylist():
                found = []
                for i in find(value):
                    if i not in search:
                        search[i] = _compiled(held[i][1]).search
                    if search[i](value):
                        found.append(held[i][0])
                size = -(-len(found) // PART_NAMES)
                for part in range(size):
                    rows.append((value, part, size, found[part * PART_NAMES:(part + 1) * PART_NAMES]))
                    if len(rows) == PARTS_AT_ONCE:
                        yield batch()
        if rows:
            yield batch()

    return run


def regex_join(df: DataFrame, text: str, patterns: DataFrame, name: str, pattern: str) -> DataFrame:
    """One row per text and matching pattern (case ignored, ``.`` matches line breaks), adding column ``name``.

    The patterns are the stated query set: they travel in blocks of bounded size, and every different text meets every
    block once. An automaton of the literals that the patterns require names a text's candidates, and only those are
    compiled and run. Patterns without a certain literal are candidates of every text. Patterns that do not compile match
    nothing; ``valid_patterns`` returns them.

    What a text matches is written once, in parts of ``PART_NAMES`` names. The parts lie in lanes, at most ``PAIR_LANES``
    a text, and the rows with that text are dealt out by lane, so the pairs are made in as many tasks as there are shares,
    however few the texts are and however many patterns one of them matches. A row travels once a lane, not once a part,
    and no pair is shuffled or passes through Python.
    """
    spark = df.sparkSession
    usable = valid_patterns(patterns.filter(F.col(pattern).isNotNull()), pattern)[0]
    shape = T.StructType([
        T.StructField("_text", df.schema[text].dataType), T.StructField("_part", T.IntegerType()),
        T.StructField("_parts", T.IntegerType()), T.StructField("_names", T.ArrayType(patterns.schema[name].dataType))])
    texts = df.filter(F.col(text).isNotNull()).select(text).distinct()
    # Dealt by a stated number: patterns cost far more than the few bytes by which shuffles are sized.
    texts = texts.repartition(spark.sparkContext.defaultParallelism, text)
    parts = materialised(texts.mapInArrow(_matched(pattern_blocks(usable, name, pattern), shape), shape))
    lanes = F.least(F.col("_parts"), F.lit(PAIR_LANES))
    sizes = parts.filter("_part = 0").select(F.col("_text").alias("_sized"), lanes.alias("_lanes"))
    met = df.join(sizes, F.col(text) == F.col("_sized")).withColumn(
        "_wanted", F.explode(F.sequence(F.lit(0), F.col("_lanes") - 1))).select(*df.columns, "_wanted")
    placed = parts.select("_text", (F.col("_part") % lanes).alias("_lane"), "_names")
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PAIR_SHARES)
    pairs = met.repartition(shares).join(placed, (F.col(text) == F.col("_text")) & (F.col("_wanted") == F.col("_lane")))
    return pairs.select(*df.columns, F.explode("_names").alias(name))


# --- nearest date ----------------------------------------------------------------------------------------------

def nearest_match(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str,
                  tie: Sequence[Column], take: Sequence[str], missing: str = "1900-01-01") -> DataFrame:
    """For every left row the right row of the same key with the smallest date gap.

    Both sides are first reduced to one row per key and day, so however many rows share a key, the window below sees
    at most one row per calendar day. The two neighbours of a day are the only candidates; on equal gaps ``tie``
    decides between them. NULL dates count as ``missing``, NULL keys match nothing. Left rows without a partner are
    kept with NULLs.
    """
    fallback = F.lit(missing).cast("date")
    right_days = first_per_group(
        right.filter(F.col(key).isNotNull())
        .withColumn("_day", F.coalesce(F.col(right_date).cast("date"), fallback)),
        [key, "_day"], tie,
    )
    right_days = right_days.select(
        F.col(key).alias("_key"), "_day", F.struct("_day", *right.columns).alias("_row"), F.lit(True).alias("_has")
    )
    left_days = (
        left.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("_key"), F.coalesce(F.col(left_date).cast("date"), fallback).alias("_day")).distinct()
    )
    days = left_days.withColumn("_wanted", F.lit(True)).join(right_days, ["_key", "_day"], "full")
    window = Window.partitionBy("_key").orderBy("_day")
    before = F.last("_row", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    backwards = Window.partitionBy("_key").orderBy(F.desc("_day"))
    after = F.last("_row", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    near = days.select("_key", "_day", "_wanted", before.alias("_b"), after.alias("_a")).filter("_wanted")
    pairs = near.select("_key", F.col("_day").alias("_left_day"), F.explode(F.array_distinct(F.array_compact(
        F.array("_b", "_a")))).alias("_c"))
    best = pairs.select("_key", "_left_day", "_c.*").withColumn(
        "_gap", F.abs(F.datediff("_left_day", "_day")))
    best = first_per_group(best, ["_key", "_left_day"], [F.col("_gap"), *tie])
    best = best.select("_key", "_left_day", *[F.col(c).alias(f"match_{c}") for c in take])
    keyed = left.withColumn("_left_day", F.coalesce(F.col(left_date).cast("date"), fallback))
    return (
        keyed.join(best, (F.col(key) == F.col("_key")) & (keyed["_left_day"] == best["_left_day"]), "left")
        .drop("_key", "_left_day")
    )


# --- names -----------------------------------------------------------------------------------------------------

def alias_map(companies: DataFrame, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(key, canonical): spelling in lower case to the canonical name; a name wins over an alias."""
    names = companies.select(F.lower(name).alias("key"), F.col(name).alias("canonical"), F.lit(1).alias("_by"))
    others = companies.select(F.explode(aliases).alias("key"), F.col(name).alias("canonical"), F.lit(2).alias("_by"))
    both = names.unionByName(others.withColumn("key", F.lower("key"))).filter(F.col("key").isNotNull())
    return first_per_group(both, ["key"], [oldest("_by"), oldest("canonical")]).select("key", "canonical")


def canonical_name(df: DataFrame, spelling: str, names: DataFrame, out: str) -> DataFrame:
    """Canonical name of a spelling through ``alias_map``; an unknown spelling stays as it is."""
    joined = df.join(names, F.lower(F.col(spelling)) == names["key"], "left")
    return joined.withColumn(out, F.coalesce("canonical", F.col(spelling))).drop("key", "canonical")


def alias_cascade(values: DataFrame, value: str, companies: DataFrame, name: str = "name",
                  aliases: str = "aliases") -> tuple[DataFrame, DataFrame]:
    """Resolve values by exact name, then exact alias, then name in any case.

    Returns the values with column ``company`` (the value itself when nothing fits) and the new company names. Every
    look-up table holds one row per spelling, so no value is multiplied.
    """
    exact = companies.select(F.col(name).alias("_exact")).distinct()
    by_alias = companies.select(F.explode(aliases).alias("_alias"), F.col(name).alias("_by_alias")) \
        .groupBy("_alias").agg(F.min("_by_alias").alias("_by_alias"))
    by_case = companies.groupBy(F.lower(name).alias("_lower")).agg(F.min(name).alias("_by_case"))
    resolved = (
        values.join(exact, F.col(value) == F.col("_exact"), "left")
        .join(by_alias, F.col(value) == F.col("_alias"), "left")
        .join(by_case, F.lower(F.col(value)) == F.col("_lower"), "left")
        .withColumn("_known", F.coalesce("_exact", "_by_alias", "_by_case"))
    )
    new = resolved.filter(F.col("_known").isNull() & F.col(value).isNotNull()) \
        .select(F.col(value).alias(name)).distinct()
    out = resolved.withColumn("company", F.coalesce("_known", F.col(value)))
    return out.drop("_exact", "_alias", "_by_alias", "_lower", "_by_case", "_known"), new


def link_by_key(left: DataFrame, right: DataFrame, left_name: str, right_name: str, how: str = "left") -> DataFrame:
    """Join two name columns through their normalised key; rows without a key never meet and are not shuffled."""
    keyed_right = right.withColumn("_right_key", name_key(right_name)).filter(F.col("_right_key").isNotNull())
    keyed_left = left.withColumn("key", name_key(left_name))
    return keyed_left.join(keyed_right, F.col("key") == F.col("_right_key"), how).drop("_right_key")


def join_first(left: DataFrame, right: DataFrame, on: str, order: Sequence[Column]) -> DataFrame:
    """Left join with at most one right row per left row, the first by ``order``."""
    return left.join(first_per_group(right.filter(F.col(on).isNotNull()), [on], order), on, "left")


# --- rows from columns -----------------------------------------------------------------------------------------

def explode_split(df: DataFrame, text: str, out: str, separator: str | None = None) -> DataFrame:
    """One row per non-blank part of a delimited text."""
    parts = F.split(F.coalesce(text, F.lit("")), separator or LIST_SEPARATOR)
    return df.withColumn(out, F.explode(parts)).withColumn(out, F.trim(out)).filter(F.col(out) != "")


def explode_array(df: DataFrame, array: str | Column, out: str, mode: str = "inner",
                  default: str | None = None) -> DataFrame:
    """One row per element; rows without elements are dropped (``inner``), kept with NULL (``outer``) or kept with a
    default element (``default``)."""
    column = F.col(array) if isinstance(array, str) else array
    if mode == "inner":
        return df.withColumn(out, F.explode(column))
    if mode == "outer":
        return df.withColumn(out, F.explode_outer(column))
    filled = F.when(F.size(column) > 0, column).otherwise(F.array(F.lit(default)))
    return df.withColumn(out, F.explode(filled))


def unpivot_slots(df: DataFrame, slots: Sequence[dict[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Numbered column groups to rows: one row per group with any of the ``keep`` fields present.

    Texts are trimmed and blanks become NULL.
    """
    fields = list(slots[0])
    rows = [
        F.struct(F.lit(i).alias("slot"), *[F.nullif(F.trim(F.col(s[f]).cast("string")), F.lit("")).alias(f) for f in fields])
        for i, s in enumerate(slots, 1)
    ]
    used = {s[f] for s in slots for f in fields}
    rest = [c for c in df.columns if c not in used]
    out = df.select(*rest, F.explode(F.array(*rows)).alias("_s")).select(*rest, "_s.*")
    present = F.lit(not keep)
    for field in keep:
        present = present | F.col(field).isNotNull()
    return out.filter(present)
