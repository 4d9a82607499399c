"""Datasets by content: ingest of payloads, tables and files, look-up, paging, and what it all costs."""

from __future__ import annotations

import asyncio
import contextlib
import contextvars
import functools
import hashlib
import json
import logging
import re
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import coerce, predicate
from fathom.operators import grid as grids
from fathom.operators import profile, relational
from fathom.policy import LIMITS, Limits
from fathom.runtime import stored
from fathom.sources import payload

ROW = "_row_id"
LOG = logging.getLogger(__name__)


@dataclass
class Dataset:
    key: str
    label: str
    fingerprint: str
    frame: DataFrame
    columns: list[str]
    types: dict[str, str]
    rows: int
    size: int
    nesting: payload.Nesting | None = None
    created: float = field(default_factory=time.time)
    used: int = 0
    _grid: Any = None
    _brief: dict[str, dict[str, Any]] = field(default_factory=dict)

    def brief(self, most: int) -> dict[str, dict[str, Any]]:
        """Figures of the first columns, computed when they are first asked for."""
        missing = [c for c in self.columns[:most] if c not in self._brief]
        if missing:
            found = profile.brief(self.typed(), {c: self.types[c] for c in missing})
            self._brief |= {c: found.get(c, {}) for c in missing}
        return self._brief

    def typed(self) -> DataFrame:
        """The rows with text columns as what the vote on their types says: numbers, dates. Statistics and the grid see these."""
        text = {f.name for f in self.frame.schema if isinstance(f.dataType, T.StringType)}

        def column(name: str) -> Column:
            c = F.col(f"`{name}`")
            kind = self.types.get(name) if name in text else None
            return (coerce.plain_text(c) if kind == "numeric" else F.trim(c).try_cast("date") if kind == "date" else c).alias(name)

        return self.frame.select(*[column(f.name) for f in self.frame.schema])

    def grid(self) -> grids.Grid | None:
        """The dataset's grid, made when it is first asked for; None where there is too little for one."""
        if self._grid is None and self.rows >= grids.MIN_ROWS:
            typed = self.typed()
            axes, fields = grids.identify_axes(typed.drop(ROW))
            if axes and fields:
                made = grids.build(typed, axes, fields)
                made.vertices = stored(made.vertices)
                self._grid = grids.kept(grids.with_wraps(made)) if made.vertices.count() >= grids.MIN_VERTICES else None
        return self._grid


def short_number(n: float) -> str:
    for size, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(n) >= size:
            return f"{n / size:.1f}{letter}"
    return f"{n:g}"


def in_short(figures: dict[str, Any]) -> str:
    """A column's figures behind its type: a range or a number of values."""
    if figures.get("unique") is not None:
        return f", {figures['unique']} unique"
    low, high = figures.get("min"), figures.get("max")
    if low is None:
        return ""
    return f", {low[:10]}..{high[:10]}" if isinstance(low, str) else f", {short_number(low)}..{short_number(high)}"


class Catalog:
    """A store of datasets for one session. One lock guards the book-keeping; plans run outside it."""

    def __init__(self, spark: SparkSession, limits: Limits = LIMITS):
        self.spark, self.limits = spark, limits
        self.datasets: dict[str, Dataset] = {}
        self.by_fingerprint: dict[str, str] = {}
        self.chars_in = self.chars_out = self.calls = 0
        self.lock = threading.RLock()

    # ingest

    def ingest(self, text: str, label: str = "data") -> str:
        """A payload as a summary; short or unusable ones come back as text."""
        if len(text) <= self.limits.ingest_chars:
            return text
        try:
            data = json.loads(text)
        except ValueError:
            return text[: self.limits.ingest_chars]
        rows = payload.rows_of(data)
        if len(rows) < self.limits.min_rows:
            return text[: self.limits.ingest_chars]
        if len(text) > self.limits.memory_bytes:
            return f"[too large: {len(text)} characters]"
        fingerprint = hashlib.sha256(text.encode()).hexdigest()
        with self.lock:
            if fingerprint in self.by_fingerprint:
                known = self.datasets[self.by_fingerprint[fingerprint]]
                known.used += 1
                return self._out(len(text), self.summary(known))
        columns = list(dict.fromkeys(k for r in rows[:100] for k in r))[: self.limits.columns]
        frame = self._frame(rows, columns)
        return self._out(len(text), self.summary(self._keep(frame, label, fingerprint, len(text), payload.nesting(data))))

    def _frame(self, rows: list[dict], columns: list[str]) -> DataFrame:
        """Rows with one type for each column: numbers as doubles (or longs), booleans, else text."""

        def kind(values: list) -> str:
            there = [v for v in values if v is not None]
            if there and all(isinstance(v, bool) for v in there):
                return "boolean"
            if there and all(isinstance(v, int | float) and not isinstance(v, bool) for v in there):
                return "long" if all(isinstance(v, int) and abs(v) < 2**63 for v in there) else "double"
            return "string"

        kinds = {c: kind([r.get(c) for r in rows]) for c in columns}
        cast = {"double": float, "long": int, "boolean": bool, "string": lambda v: v if isinstance(v, str) else json.dumps(v)}
        data = [(i, *[None if r.get(c) is None else cast[kinds[c]](r[c]) for c in columns]) for i, r in enumerate(rows)]
        return self.spark.createDataFrame(data, ", ".join([f"{ROW} long", *[f"`{c}` {kinds[c]}" for c in columns]]))

    def register(self, frame: DataFrame, label: str, order_by: Sequence[str] = ()) -> Dataset:
        """A table or file as a dataset. Rows are numbered by the given order, or in the order they are read."""
        if ROW not in frame.columns:
            from pyspark.sql import Window

            number = F.row_number().over(Window.orderBy(*order_by)) - 1 if order_by else F.monotonically_increasing_id()
            frame = frame.withColumn(ROW, number.cast("long"))
        plan = f"{label}|{frame.schema.simpleString()}|{frame._jdf.queryExecution().optimizedPlan().toString()}"
        return self._keep(frame, label, hashlib.sha256(plan.encode()).hexdigest(), 0, None)

    def _keep(self, frame: DataFrame, label: str, fingerprint: str, size: int, nest: payload.Nesting | None) -> Dataset:
        frame = frame.cache() if size else frame
        columns = [c for c in frame.columns if c != ROW]
        key = f"{re.sub(r'[^A-Za-z0-9]+', '_', label[:20]).strip('_').lower() or 'data'}_{fingerprint[:6]}"
        made = Dataset(key, label, fingerprint, frame, columns, profile.column_types(frame.drop(ROW)), frame.count(), size, nest)
        with self.lock:
            while self.datasets and (len(self.datasets) >= self.limits.datasets or self.used_bytes() + size > self.limits.memory_bytes):
                self.drop(min(self.datasets.values(), key=lambda d: (d.used, d.created)).key)
            self.datasets[key], self.by_fingerprint[fingerprint] = made, key
        return made

    def drop(self, key: str) -> None:
        with self.lock:
            gone = self.datasets.pop(key)
            self.by_fingerprint.pop(gone.fingerprint, None)
        if gone.size:
            gone.frame.unpersist()

    def used_bytes(self) -> int:
        return sum(d.size for d in self.datasets.values())

    # look-up

    def get(self, key: str) -> Dataset:
        with self.lock:
            if key not in self.datasets:
                raise KeyError(f"no dataset {key}")
            self.datasets[key].used += 1
            return self.datasets[key]

    def keys(self) -> list[dict[str, Any]]:
        return [{"key": d.key, "label": d.label, "rows": d.rows, "columns": d.columns[:10]} for d in self.datasets.values()]

    def summary(self, d: Dataset) -> str:
        head = [f"{d.key}: {short_number(d.rows)} rows, {len(d.columns)} columns"]
        figures = d.brief(self.limits.summary_columns)
        head += [f"  {c} ({d.types[c]}{in_short(figures[c])})" for c in d.columns[: self.limits.summary_columns]]
        head += [f"  and {len(d.columns) - self.limits.summary_columns} more columns"] if len(d.columns) > self.limits.summary_columns else []
        preview = [r for r in d.frame.orderBy(ROW).drop(ROW).limit(self.limits.preview_rows).toJSON().collect()]
        return "\n".join([*head, *[p[:400] for p in preview]])

    def _out(self, chars: int, text: str) -> str:
        with self.lock:
            self.chars_in, self.chars_out, self.calls = self.chars_in + chars, self.chars_out + len(text), self.calls + 1
        return text

    def context_stats(self) -> dict[str, Any]:
        return {"chars_in": self.chars_in, "chars_out": self.chars_out, "ratio": self.chars_in / max(self.chars_out, 1), "tokens": self.chars_out // 4, "calls": self.calls, "datasets": len(self.datasets), "bytes": self.used_bytes()}

    def log_summary(self) -> str:
        """One line for the log: calls, characters in and out, and the datasets with their rows and uses."""
        c = self.context_stats()
        held = ", ".join(f"{d.key}({d.rows} rows, {d.used} uses)" for d in self.datasets.values()) or "(empty)"
        line = f"{c['calls']} calls, {c['chars_in']} characters in, {c['chars_out']} out ({c['ratio']:.1f}x, about {c['tokens']} tokens), {c['datasets']} datasets of {c['bytes'] / 1e6:.1f} MB: {held}"
        LOG.info(line)
        return line

    # answers

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(True) for r in df.drop(ROW).collect()]

    def retrieve(self, key: str, offset: int = 0, limit: int = 25, sort_by: str | None = None, sort_desc: bool = True, columns: Sequence[str] | None = None) -> dict:
        d = self.get(key)
        order = sort_by or ROW
        rows = self._rows(relational.page(d.frame, offset, limit, order, sort_desc if sort_by else False, columns))
        return {"key": key, "total_rows": d.rows, "returned": len(rows), "rows": rows}

    def query(self, key: str, where: str | dict, sort_by: str | None = None, sort_desc: bool = True, limit: int = 25, columns: Sequence[str] | None = None) -> dict:
        d = self.get(key)
        try:
            found = predicate.where(d.frame, where)
        except predicate.InvalidPredicate as e:
            return {"error": str(e)}
        rows = self._rows(relational.page(found, 0, limit, sort_by or ROW, sort_desc if sort_by else False, columns))
        return {"key": key, "matched": found.count(), "returned": len(rows), "rows": rows}

    def aggregate(self, key: str, column: str, func: str) -> dict:
        d = self.get(key)
        try:
            value = d.frame.agg(relational.aggregate(d.frame, column, func)).first()[0]
        except ValueError as e:
            return {"error": str(e)}
        return {"key": key, "column": column, "func": func, "value": round(value, 4) if isinstance(value, float) else value}

    def group_by(self, key: str, by: Sequence[str], aggregates: str | Sequence[dict], sort_by: str | None = None, sort_desc: bool = True, limit: int = 50) -> dict:
        d = self.get(key)
        try:
            wanted = json.loads(aggregates) if isinstance(aggregates, str) else list(aggregates)
            groups = relational.group(d.frame, by, wanted, sort_by, sort_desc, None)
        except ValueError as e:
            return {"error": str(e)}
        return {"key": key, "groups": groups.count(), "rows": self._rows(groups.limit(min(limit, self.limits.groups)))}

    def schema(self, key: str) -> dict:
        d = self.get(key)
        return {"key": key, "rows": d.rows, "columns": profile.describe(d.frame.drop(ROW))}

    def __getattr__(self, name: str) -> Callable:
        """aingest, aretrieve, akeys, ...: the same off the event loop."""
        if name.startswith("a") and hasattr(type(self), name[1:]):
            return functools.partial(asyncio.to_thread, getattr(self, name[1:]))
        raise AttributeError(name)


_current: contextvars.ContextVar[Catalog | None] = contextvars.ContextVar("catalog", default=None)
_raw: contextvars.ContextVar[bool] = contextvars.ContextVar("raw", default=False)


def use(catalog: Catalog) -> Catalog:
    """Make this the catalog of the current context (a request)."""
    _current.set(catalog)
    return catalog


def current() -> Catalog | None:
    return _current.get()


@contextlib.contextmanager
def raw():
    """Results pass interception untouched."""
    token = _raw.set(True)
    try:
        yield
    finally:
        _raw.reset(token)


def intercept(label: str = "tool", catalog: Catalog | None = None) -> Callable:
    """A decorator: large results of a tool are ingested, and the summary is returned; on any failure, the result itself."""

    def decorate(fn: Callable) -> Callable:
        def shorten(result: Any) -> Any:
            store = catalog or current()
            if _raw.get() or store is None:
                return result
            if isinstance(result, DataFrame):
                return store.summary(store.register(result, label))
            try:
                text = result if isinstance(result, str) else json.dumps(result)
                return store.ingest(text, label) if len(text) > store.limits.ingest_chars else result
            except Exception:  # the tool's own answer is always better than none
                return result

        if asyncio.iscoroutinefunction(fn):

            @functools.wraps(fn)
            async def run_async(*args: Any, **kwargs: Any) -> Any:
                result = await fn(*args, **kwargs)
                return result if _raw.get() else await asyncio.to_thread(contextvars.copy_context().run, shorten, result)

            return run_async

        @functools.wraps(fn)
        def run(*args: Any, **kwargs: Any) -> Any:
            return shorten(fn(*args, **kwargs))

        return run

    return decorate
