"""Text and mixed values as numbers. Three rules that must not be mixed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what strict type inference takes for a number.
STRICT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: What a plain conversion takes for a number (no suffixes such as d and f, which Spark's cast would accept).
PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def finite(x: Column) -> Column:
    """A double, or null if it is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def plain_text(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(PLAIN), trimmed.try_cast("double"))


def strict(text: Column) -> Column:
    """Type inference: text that is a number and nothing else."""
    return plain_text(text)


def permissive(column: Column, kind: T.DataType) -> Column:
    """Aggregates and statistics: numbers as they are; null, empty text, booleans and non-finite values as null; other text
    is read as a number, and if it is none, again with everything but digits, signs, points and e taken out ("$1,234.5")."""
    if is_numeric(kind):
        return finite(column.cast("double"))
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("double")
    stripped = F.regexp_replace(column, r"[^0-9.+\-eE]", "")
    return finite(F.coalesce(plain_text(column), plain_text(stripped)))


def plain(column: Column, kind: T.DataType) -> Column:
    """Slices and grids: text is read as it stands."""
    if is_numeric(kind):
        return finite(column.cast("double"))
    if isinstance(kind, T.BooleanType):
        return column.cast("double")
    return finite(plain_text(column)) if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def number(df: DataFrame, name: str) -> Column:
    """df's column by the permissive rule."""
    return permissive(F.col(f"`{name}`"), df.schema[name].dataType)


def text(df: DataFrame, name: str) -> Column:
    """df's column as text; booleans as True and False."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    return F.when(column, "True").when(~column, "False") if isinstance(kind, T.BooleanType) else column.cast("string")


def bucket(value: Column, edges: list[float]) -> Column:
    """The first bucket whose upper edge is not below the value; the last one for values above all edges."""
    out = F.lit(len(edges) - 2)
    for k in range(len(edges) - 3, -1, -1):
        out = F.when(value <= edges[k + 1], k).otherwise(out)
    return out


def half_even(position: float) -> int:
    return round(position)
