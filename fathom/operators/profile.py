"""Column types by vote over values, and column statistics. Text columns are judged in one pass of counters."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import coerce

KINDS = ("numeric", "bool", "date", "datetime", "dict", "list", "string", "mixed")
#: What counts as what.
BOOL = r"(?i)^(true|false|yes|no|0|1|y|n|t|f)$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
CURRENCY = r"^[\s]*[$€£¥]\s*[-+]?[\d,]+(\.\d+)?[\s]*$"
PERCENT = r"^[\s]*[-+]?\d+(\.\d+)?\s*%[\s]*$"
IDENTIFIER = r"^[A-Za-z0-9._:/-]{2,64}$"


def value_kind(column: Column, kind: T.DataType) -> Column:
    """The kind of one value; null and empty text have none."""
    if coerce.is_numeric(kind):
        return F.when(column.isNotNull(), "numeric")
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNotNull(), "bool")
    if isinstance(kind, T.DateType):
        return F.when(column.isNotNull(), "date")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.when(column.isNotNull(), "datetime")
    if isinstance(kind, T.ArrayType):
        return F.when(column.isNotNull(), "list")
    if isinstance(kind, T.StructType | T.MapType | T.VariantType):
        return F.when(column.isNotNull(), "dict")
    t = F.trim(column)
    return (
        F.when(column.isNull() | (column == ""), None).when(t.rlike(BOOL), "bool").when(t.startswith("{") & t.endswith("}") & F.try_parse_json(t).isNotNull(), "dict")
        .when(t.startswith("[") & t.endswith("]") & F.try_parse_json(t).isNotNull(), "list").when(t.rlike(coerce.STRICT), "numeric")
        .when(t.rlike(DATE) & t.try_cast("date").isNotNull(), "date").when(t.rlike(DATETIME) & t.try_cast("timestamp").isNotNull(), "datetime").otherwise("string")
    )


def kind_counts(df: DataFrame) -> DataFrame:
    """column, kind, n over all columns in one pass."""
    flat = df.agg(*[F.count_if(value_kind(F.col(f"`{f.name}`"), f.dataType) == k).alias(f"c{i * 7 + j}") for i, f in enumerate(df.schema) for j, k in enumerate(KINDS[:-1])])
    entries = [F.struct(F.lit(f.name).alias("column"), F.lit(k).alias("kind"), F.col(f"c{i * 7 + j}").alias("n")) for i, f in enumerate(df.schema) for j, k in enumerate(KINDS[:-1])]
    return flat.select(F.inline(F.array(*entries))).filter("n > 0")


def decide(counts: dict[str, int]) -> str:
    """The type of most values, unless they disagree too much. Ties go by the order of KINDS."""
    total = sum(counts.values())
    if not total:
        return "null"
    ranked = sorted(KINDS[:-1], key=lambda k: -counts.get(k, 0))
    best, second = (counts.get(k, 0) / total for k in ranked[:2])
    if best < 0.7 and second > 0.2 or ranked[0] in ("dict", "list") and second > 0.05:
        return "mixed"
    return ranked[0]


def column_types(df: DataFrame) -> dict[str, str]:
    found: dict[str, dict[str, int]] = {f.name: {} for f in df.schema}
    for r in kind_counts(df).collect():
        found[r["column"]][r["kind"]] = r["n"]
    return {c: decide(k) for c, k in found.items()}


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: n, nulls (empty text included), unique, and min, max, mean, median, std of numbers or the mean length of text."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    there = c.isNotNull() & (c != "") if isinstance(kind, T.StringType) else c.isNotNull()
    base = [F.count("*").alias("n"), F.count_if(~there).alias("nulls"), F.count_distinct(F.when(there, c)).alias("unique_count")]
    if coerce.is_numeric(kind):
        x = coerce.number(df, column)
        base += [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std")]
    elif isinstance(kind, T.StringType):
        base += [F.avg(F.when(there, F.length(c))).alias("avg_length")]
    return df.agg(*base)


def brief(df: DataFrame, types: dict[str, str]) -> dict[str, dict[str, Any]]:
    """For each column its range (and mean) if numbers, its range if dates, the number of its values if text; one pass over all."""
    wanted: list[tuple[str, str, Column]] = []
    for name, kind in types.items():
        c = F.col(f"`{name}`")
        if kind == "numeric":
            x = coerce.number(df, name)
            wanted += [(name, "min", F.min(x)), (name, "max", F.max(x)), (name, "mean", F.avg(x))]
        elif kind in ("date", "datetime"):
            wanted += [(name, "min", F.min(c.cast("string"))), (name, "max", F.max(c.cast("string")))]
        elif kind == "string":
            wanted.append((name, "unique", F.count_distinct(F.when(c.cast("string") != "", c))))
    if not wanted:
        return {}
    row = df.agg(*[x.alias(f"c{k}") for k, (*_, x) in enumerate(wanted)]).first()
    out: dict[str, dict[str, Any]] = {}
    for (name, figure, _), value in zip(wanted, row, strict=True):
        out.setdefault(name, {})[figure] = value
    return out


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """value, n: the most frequent values; ties by value."""
    return df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def value_entropy(df: DataFrame, column: str) -> DataFrame:
    """entropy of the values in bits."""
    counts = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("m"))
    return counts.agg((F.log2(F.sum("m")) - F.sum(F.col("m") * F.log2("m")) / F.sum("m")).alias("entropy"))


def tags(df: DataFrame, column: str, base: str) -> list[str]:
    """Meanings of a text column: categorical, identifier, free_text, currency, percent."""
    c = F.col(f"`{column}`")
    one = df.filter(c.isNotNull() & (c.cast("string") != "")).agg(F.count("*").alias("n"), F.count_distinct(c).alias("u"), F.avg(F.length(c.cast("string"))).alias("len"), F.avg(c.cast("string").rlike(CURRENCY).cast("int")).alias("cur"), F.avg(c.cast("string").rlike(PERCENT).cast("int")).alias("pct"), F.avg(c.cast("string").rlike(IDENTIFIER).cast("int")).alias("ident")).first()
    out = []
    if not one["n"]:
        return out
    if base in ("string", "date", "datetime", "bool") and one["u"] <= min(50, max(12, int(0.2 * one["n"]))):
        out.append("categorical")
    if base == "string" and one["u"] / one["n"] >= 0.9 and one["len"] <= 40 and one["ident"] == 1:
        out.append("identifier")
    if base == "string" and one["len"] >= 48:
        out.append("free_text")
    return out + [name for name, key in (("currency", "cur"), ("percent", "pct")) if base == "string" and one[key] >= 0.6]


def describe(df: DataFrame) -> dict[str, dict[str, Any]]:
    """Type, tags and statistics of every column."""
    out = {}
    for column, base in column_types(df).items():
        stats = column_stats(df, column).first().asDict()
        out[column] = {"type": base, **stats}
        if base in ("string", "date", "datetime", "bool"):
            out[column]["tags"] = tags(df, column, base)
            out[column]["top"] = [(r["value"], r["n"]) for r in top_values(df, column).collect()]
    return json.loads(json.dumps(out, default=str))
