"""A JSON predicate language, compiled to a two-valued Column: never null, so nothing is lost to three-valued logic.

    {"column": c, "op": o, "value": v} | {"and": [...]} | {"or": [...]}
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.policy import LIMITS

OPS = ("=", "!=", ">", "<", ">=", "<=", "contains", "in", "not_in")


class InvalidPredicate(ValueError):
    pass


def _number(value: Any) -> float | None:
    """The permissive rule for a literal."""
    if value is None or isinstance(value, bool):
        return None
    try:
        x = float(value)
    except (TypeError, ValueError):
        try:
            x = float("".join(c for c in str(value) if c in "0123456789.+-eE"))
        except ValueError:
            return None
    return x if x == x and abs(x) != float("inf") else None


def _leaf(df: DataFrame, node: dict) -> Column:
    op, value, name = node.get("op"), node.get("value"), node.get("column")
    if op not in OPS:
        raise InvalidPredicate(f"unknown operator {op!r}")
    known = name in df.columns
    raw = F.col(f"`{name}`") if known else F.lit(None).cast("string")
    numeric = known and coerce.is_numeric(df.schema[name].dataType)
    if op in ("in", "not_in"):
        values = value if isinstance(value, list) else [value]
        there = [v for v in values if v is not None]
        hit = F.coalesce(raw.isin(there), F.lit(False)) if there else F.lit(False)
        hit = hit | raw.isNull() if None in values else hit
        return hit if op == "in" else ~hit
    if op == "contains":
        return F.coalesce(F.contains(F.lower(raw.cast("string")), F.lower(F.lit(str(value)))), F.lit(False))
    left = coerce.number(df, name) if numeric else raw
    right = F.lit(_number(value)) if numeric else F.lit(value)
    if op == "=":
        return left.eqNullSafe(right)
    if op == "!=":
        return ~left.eqNullSafe(right)
    test = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
    return F.coalesce(test, F.lit(False))


def build(df: DataFrame, node: Any, depth: int = 0) -> Column:
    """The Column of a parsed predicate. `and` comes before `or` where both stand; an empty one is true, and false."""
    if depth > LIMITS.predicate_depth or not isinstance(node, dict):
        raise InvalidPredicate("too deep" if isinstance(node, dict) else "not an object")
    for word, empty in (("and", True), ("or", False)):
        if word in node:
            if not isinstance(node[word], list):
                raise InvalidPredicate(f"{word} needs a list")
            out = F.lit(empty)
            for part in node[word]:
                inner = build(df, part, depth + 1)
                out = out & inner if word == "and" else out | inner
            return out
    return _leaf(df, node)


def where(df: DataFrame, text: str | dict) -> DataFrame:
    """df's rows that meet a predicate."""
    try:
        node = json.loads(text) if isinstance(text, str) else text
    except json.JSONDecodeError as e:
        raise InvalidPredicate(str(e)) from e
    return df.filter(build(df, node)) if node else df


def slice_rows(df: DataFrame, column: str, op: str, value: Any) -> DataFrame:
    """The second filter, for slices: null never matches; numbers are equal within 1e-9; text can only be (un)equal."""
    if column not in df.columns or op not in ("=", "!=", ">", "<", ">=", "<="):
        return df.filter(F.lit(False))
    raw = F.col(f"`{column}`")
    x = coerce.plain(raw, df.schema[column].dataType)
    try:
        v = None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        v = None
    as_text = raw.cast("string") == F.lit(str(value))
    textual = {"=": as_text, "!=": ~as_text}.get(op, F.lit(False))
    if v is None:
        return df.filter(raw.isNotNull() & textual)
    near = F.abs(x - v) < 1e-9
    test = {"=": near, "!=": ~near, ">": x > v, "<": x < v, ">=": x >= v, "<=": x <= v}[op]
    return df.filter(raw.isNotNull() & F.when(x.isNotNull(), test).otherwise(textual))
