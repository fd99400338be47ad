"""Registry of queries and the adapter views they share with their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealweave.catalog.adapters import ADAPTERS

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2024-01-31 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

_SPARK = {
    r"\bARR\(": "array(",
    r"\bJOINED\(([^,]+), ([^,]+)\)": r"listagg(\1, ', ') within group (order by \2)",
}
_DUCKDB = {
    r"\bARR\(": "list_value(",
    r"\bJOINED\(([^,]+), ([^,]+)\)": r"string_agg(\1, ', ' order by \2)",
}


def _dialect(sql: str, rules: dict[str, str]) -> str:
    for pattern, replacement in rules.items():
        sql = re.sub(pattern, replacement, sql)
    return sql


class Tables:
    """The driver's tables and the adapter views of one folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._base(name) if name in BASE_TABLES else self._adapter(name)
        return self._known[name]

    def _base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        local_times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in local_times}) if local_times else df

    def _adapter(self, name: str) -> DataFrame:
        sql = ADAPTERS[name]
        used = {t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
        return self.spark.sql(_dialect(sql, _SPARK), **used)


def _with_adapters(sql: str) -> str:
    """Check SQL with the adapter views it names put in front."""
    ordered: list[str] = []

    def need(names: list[str]) -> None:
        for name in names:
            if name in ADAPTERS and name not in ordered:
                need(re.findall(r"\{(\w+)\}", ADAPTERS[name]))
                ordered.append(name)

    need(re.findall(r"\b(?:from|join)\s+(\w+)", sql))
    views = [f"{name} as ({_dialect(_plain_text(ADAPTERS[name]), _DUCKDB)})" for name in ordered]
    body = sql.strip()
    if not views:
        return body
    if re.match(r"with\s+recursive\s", body):
        return f"with recursive {', '.join(views)}, {body[14:]}"
    if re.match(r"with\s", body):
        return f"with {', '.join(views)}, {body[5:]}"
    return f"with {', '.join(views)} {body}"


def _plain_text(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}")


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with DuckDB SQL giving the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(fn(Tables(spark, folder)))
        if check is not None:
            CHECKS[name] = _with_adapters(check)
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in types both engines print alike: whole numbers as bigint, decimals and floats as double, dates and
    times as text, text arrays joined."""
    cells = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, ", ")
        cells.append(c.alias(field.name))
    return df.select(*cells)


def ts(expr: str) -> str:
    """DuckDB text of a time, as ``plain`` prints it."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def dt(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


WEB = "ai|io|com|in|co|app|xyz|so|tech|one|club|dev|org|net|me"
LEGAL = "privatelimited|pvtltd|limited|ltd|inc|llp|technologies|technology|labs|hq|india"


def nk(expr: str) -> str:
    """DuckDB form of the name key."""
    inner = f"replace(lower(trim(coalesce({expr}, ''))), '&', 'and')"
    web = f"regexp_replace({inner}, '\\.({WEB})$', '')"
    letters = f"regexp_replace({web}, '[^a-z0-9]', '', 'g')"
    return f"nullif(regexp_replace({letters}, '({LEGAL})$', ''), '')"


def parts_of(expr: str, separator: str = r"\s*[,;\n]\s*") -> str:
    """DuckDB list of the trimmed, non-blank parts of a text."""
    return (f"list_filter(list_transform(string_split_regex(coalesce({expr}, ''), '{separator}'), "
            f"lambda x: trim(x)), lambda x: x <> '')")


def chunks_of(source: str) -> str:
    """DuckDB recursive steps cutting the texts of ``source`` (id, txt, size): the views up to ``cut`` (id, part, chunk,
    parts). Each step either writes one part or takes in one line."""
    piece = r"""coalesce(nullif(regexp_extract(left(s.rest, s.size), '(?s)^(.*[.!?])\s', 1), ''),
      nullif(regexp_extract(left(s.rest, s.size), '(?s)^(.*)\s', 1), ''), left(s.rest, s.size))"""
    return f"""
    src as ({source}),
    ln as (select id, size, i, trim(l) as line from src, unnest(string_split(txt, chr(10))) with ordinality as x(l, i) where trim(l) <> ''),
    nl as (select id, size, row_number() over (partition by id order by i) as i, line from ln),
    st as (
      select id, size, 1::bigint as i, line as rest, '' as buf, 0 as part, null::varchar as chunk from nl where i = 1
      union all
      select id, size, case when goes_on then i + 1 else i end, case when goes_on then following else rest end, buf, case when chunk is null then part else part + 1 end, chunk
      from (
        select s.id, s.size, s.i, s.part, n.line as following,
          case when s.rest is null then s.buf when length(s.rest) > s.size then case when s.buf <> '' then s.buf else {piece} end
            when s.buf <> '' and length(s.buf) + length(s.rest) + 1 > s.size then s.buf end as chunk,
          case when s.rest is null or length(s.rest) > s.size or (s.buf <> '' and length(s.buf) + length(s.rest) + 1 > s.size) then ''
            when s.buf = '' then s.rest else s.buf || chr(10) || s.rest end as buf,
          case when length(s.rest) > s.size and s.buf = '' then trim(substr(s.rest, length({piece}) + 1)) else s.rest end as rest,
          case when s.rest is null then false when length(s.rest) > s.size then s.buf = '' and trim(substr(s.rest, length({piece}) + 1)) = ''
            else not (s.buf <> '' and length(s.buf) + length(s.rest) + 1 > s.size) end as goes_on
        from st s left join nl n on n.id = s.id and n.i = s.i + 1 where s.rest is not null or s.buf <> '') z),
    cut as (select id, part, chunk, max(part) over (partition by id) as parts from st where chunk is not null)"""
