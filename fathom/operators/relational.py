"""Paging, filtering, aggregating and grouping of one table. Frames in, frames out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import coerce, predicate
from fathom.policy import LIMITS

FUNCTIONS = ("sum", "mean", "median", "min", "max", "std", "count", "count_distinct")


def ordering(df: DataFrame, name: str | None, descending: bool = True, ties: Sequence[str] = ()) -> list[Column]:
    """Numbers: nulls last going up, first going down. Everything else by its text, null as the text None. Then the ties."""
    out = []
    if name in df.columns:
        if coerce.is_numeric(df.schema[name].dataType):
            x = coerce.number(df, name)
            out.append(x.desc_nulls_first() if descending else x.asc_nulls_last())
        else:
            x = F.coalesce(coerce.text(df, name), F.lit("None"))
            out.append(x.desc() if descending else x.asc())
    return [*out, *[F.col(f"`{t}`").asc() for t in ties if t in df.columns]]


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    keep = [c for c in columns or () if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in keep]) if keep else df


def page(df: DataFrame, offset: int = 0, limit: int = 25, sort_by: str | None = None, descending: bool = True, columns: Sequence[str] | None = None, ties: Sequence[str] = ("_row_id",)) -> DataFrame:
    """Rows offset ... offset+limit-1 of the sorted table; a page has 50 rows at most."""
    order = ordering(df, sort_by, descending, ties)
    sorted_df = df.orderBy(*order) if order else df
    return project((sorted_df.offset(offset) if offset else sorted_df).limit(min(limit, LIMITS.rows_per_page)), columns)


def query(df: DataFrame, where: str | dict, sort_by: str | None = None, descending: bool = True, limit: int = 25, columns: Sequence[str] | None = None, ties: Sequence[str] = ("_row_id",)) -> DataFrame:
    """The first rows that meet a predicate."""
    return page(predicate.where(df, where), 0, limit, sort_by, descending, columns, ties)


def aggregate(df: DataFrame, column: str, func: str) -> Column:
    """One of FUNCTIONS over a column. Numbers by the permissive rule; std is that of the population."""
    if column not in df.columns or func not in FUNCTIONS:
        raise ValueError(f"{func}({column})")
    raw, x = F.col(f"`{column}`"), coerce.number(df, column)
    if func == "count":
        return F.count(F.nullif(raw, F.lit(""))) if isinstance(df.schema[column].dataType, T.StringType) else F.count(raw)
    if func == "count_distinct":
        return F.count_distinct(raw)
    return {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_pop}[func](x)


def group(df: DataFrame, by: Sequence[str], aggregates: Sequence[dict], sort_by: str | None = None, descending: bool = True, limit: int | None = LIMITS.groups) -> DataFrame:
    """Groups by the columns themselves, sorted by their type. aggregates: {"column", "func", "alias"?}, 20 at most."""
    if not by or any(c not in df.columns for c in by) or not 0 < len(aggregates) <= LIMITS.aggregates:
        raise ValueError("unknown group column, or a number of aggregates that is not allowed")
    columns = [aggregate(df, a["column"], a["func"]).alias(a.get("alias") or f"{a['func']}_{a['column']}") for a in aggregates]
    out = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*columns)
    order = ordering(out, sort_by, descending, by)
    out = out.orderBy(*order)
    return out.limit(min(limit, LIMITS.groups)) if limit is not None else out
