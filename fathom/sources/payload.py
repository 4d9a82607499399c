"""JSON payloads as rows: the largest list of objects, flattened, with embedded JSON parsed and embedded tables exploded."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Nesting:
    depth: int = 0
    nodes: int = 0
    leaves: int = 0
    lists: dict[int, list[int]] = field(default_factory=dict)
    branching: dict[int, float] = field(default_factory=dict)
    signature: str = ""


def nesting(data: Any, deepest: int = 12, longest: int = 200) -> Nesting:
    """The shape of a parsed payload."""
    out, paths, children = Nesting(), [], {}
    stack: list[tuple[Any, int, str]] = [(data, 0, "")]
    while stack:
        value, depth, path = stack.pop()
        out.nodes += 1
        out.depth = max(out.depth, depth)
        if isinstance(value, dict | list) and depth < deepest:
            if depth < 4 and path and path not in paths:
                paths.append(path)
            if isinstance(value, list):
                out.lists.setdefault(depth, []).append(len(value))
                items = [(v, f"{path}[]") for v in value[:longest]]
            else:
                items = [(v, f"{path}.{k}" if path else k) for k, v in value.items()]
            children.setdefault(depth, []).append(len(items))
            stack += [(v, depth + 1, p) for v, p in reversed(items)]
        else:
            out.leaves += 1
    out.branching = {d: sum(c) / len(c) for d, c in children.items()}
    out.signature = " > ".join(paths[:8])
    return out


def largest_list(data: Any, depth: int = 0) -> list[dict]:
    """The longest list of objects, down to three levels of objects; the first of equals."""
    if isinstance(data, list):
        return data if data and isinstance(data[0], dict) else []
    best: list[dict] = []
    if isinstance(data, dict) and depth <= 3:
        for value in data.values():
            found = largest_list(value, depth + 1)
            if len(found) > len(best):
                best = found
    return best


def embedded(value: Any) -> Any:
    """A text cell that is a JSON object or list, parsed."""
    if isinstance(value, str) and value.strip()[:1] + value.strip()[-1:] in ("{}", "[]"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def flat(row: dict, prefix: str = "") -> dict:
    """Nested objects as dotted names; lists stay."""
    out = {}
    for k, v in row.items():
        v = embedded(v)
        if isinstance(v, dict):
            out |= flat(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v
    return out


def exploded(rows: list[dict]) -> list[dict]:
    """Rows of a table inside a column, if enough of the first rows have one; the parents' scalars are carried along."""
    head = rows[:50]
    counts = {}
    for r in head:
        for k, v in r.items():
            if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                n, items = counts.get(k, (0, 0))
                counts[k] = (n + 1, items + len(v))
    fits = [k for k, (n, _) in counts.items() if n >= max(2, 0.3 * len(head))]
    if not fits:
        return rows
    column = max(fits, key=lambda k: counts[k])
    scalars = lambda r: {k: v for k, v in r.items() if not isinstance(v, list | dict)}
    return [scalars(r) | flat(x, f"{column}.") for r in rows if isinstance(r.get(column), list) for x in r[column] if isinstance(x, dict)]


def rows_of(data: Any) -> list[dict]:
    """The rows of a payload: a list of objects itself, or an object's largest one (of two rows at least)."""
    rows = data if isinstance(data, list) else largest_list(data)
    rows = [r for r in rows if isinstance(r, dict)]
    if not rows or isinstance(data, dict) and len(rows) < 2:
        return []
    return [flat(r) for r in exploded([flat(r) for r in rows])]


def flattened(df: DataFrame) -> DataFrame:
    """A frame with its structs as dotted columns, at any depth; arrays stay."""

    def leaves(schema: T.StructType, path: str, name: str):
        for f in schema:
            p, n = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, p + ".", n + ".")
            else:
                yield F.col(p).alias(n)

    return df.select(*leaves(df.schema, "", ""))


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON text column as columns `column.field` of the given types; what doesn't fit is null."""
    parsed = F.try_parse_json(F.col(f"`{column}`"))
    return df.withColumns({f"{column}.{name}": F.try_variant_get(parsed, f"$.{name}", kind) for name, kind in fields.items()})


def explode_json(df: DataFrame, column: str, item: str) -> DataFrame:
    """One row for each item of a JSON list in a text column, as a struct by its DDL; rows without a list are dropped."""
    return df.withColumn("__items", F.from_json(F.col(f"`{column}`"), f"array<{item}>")).filter("__items is not null").select("*", F.explode("__items").alias(f"{column}.item")).drop("__items")
