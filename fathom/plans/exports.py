"""Exports: rows, CSV, Markdown, sheets, text chunks, artifacts. Text is made by the plan; files are written by Spark."""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.operators import profile, relational
from fathom.policy import LIMITS
from fathom.sources.catalog import ROW, Catalog, Dataset

CELL = 40
CHUNK_COLUMNS, CHUNK_ROWS, CHUNK_CHARS = 30, 2, 6000
MIME = {"csv": "text/csv", "markdown": "text/markdown", "json": "application/json", "jsonl": "application/x-ndjson"}


def chosen(d: Dataset, columns: Sequence[str] | None = None, sort_by: str | None = None, sort_desc: bool = True, offset: int = 0, limit: int = 200) -> DataFrame:
    order = relational.ordering(d.frame, sort_by or ROW, sort_desc if sort_by else False, (ROW,))
    rows = d.frame.orderBy(*order)
    rows = (rows.offset(offset) if offset else rows).limit(limit)
    return relational.project(rows, [c for c in columns or d.columns if c in d.columns])


def export_rows(d: Dataset, columns: Sequence[str] | None = None, sort_by: str | None = None, sort_desc: bool = True, offset: int = 0, limit: int = 200) -> list[dict]:
    return [r.asDict(True) for r in chosen(d, columns, sort_by, sort_desc, offset, min(limit, LIMITS.row_export)).collect()]


def export_csv(d: Dataset, columns: Sequence[str] | None = None, sort_by: str | None = None, sort_desc: bool = True, max_rows: int = 500, header: bool = True) -> str:
    rows = chosen(d, columns, sort_by, sort_desc, 0, min(max_rows, LIMITS.csv_rows))
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if header:
        writer.writerow(rows.columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows.collect()])
    return out.getvalue()


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as a CSV line, for any number of rows."""
    return df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))


def markdown_cell(column: Column) -> Column:
    text = F.regexp_replace(F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    return F.when(F.length(text) > CELL, F.concat(F.substring(text, 1, CELL - 1), F.lit("…"))).otherwise(text)


def markdown_lines(df: DataFrame) -> DataFrame:
    """Each row as a Markdown table line."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(f"`{c}`")) for c in df.columns]), F.lit(" |")).alias("line"))


def export_markdown(d: Dataset, columns: Sequence[str] | None = None, sort_by: str | None = None, sort_desc: bool = True, max_rows: int = 50) -> str:
    rows = chosen(d, columns, sort_by, sort_desc, 0, min(max_rows, LIMITS.markdown_rows))
    head = "| " + " | ".join(rows.columns) + " |"
    rule = "| " + " | ".join("---:" if coerce.is_numeric(rows.schema[c].dataType) else "---" for c in rows.columns) + " |"
    lines = [r["line"] for r in markdown_lines(rows).collect()]
    foot = [f"\n*Showing {len(lines)} of {d.rows} rows*"] if len(lines) < d.rows else []
    return "\n".join([head, rule, *lines, *foot])


def export_sheet(d: Dataset, columns: Sequence[str] | None = None, sort_by: str | None = None, sort_desc: bool = True, max_rows: int = 200) -> dict[str, Any]:
    rows = chosen(d, columns, sort_by, sort_desc, 0, min(max_rows, LIMITS.sheet_rows))
    values = [list(r) for r in rows.collect()]
    return {"headers": rows.columns, "values": values, "row_count": len(values), "total_rows": d.rows}


def described(d: Dataset, column: str, figures: dict[str, Any]) -> str:
    """Behind a column's type: its range and mean, or the number of its values and the three most frequent."""
    if figures.get("unique") is not None:
        return f", {figures['unique']} values, most often {', '.join(r['value'] for r in profile.top_values(d.frame, column, 3).collect())}"
    if figures.get("min") is None:
        return ""
    return f", {figures['min']} to {figures['max']}" + (f", mean {figures['mean']:g}" if figures.get("mean") is not None else "")


def chunk(d: Dataset) -> dict[str, Any]:
    """One text that describes a dataset, for an index of embeddings."""
    lines = [f"Dataset {d.label} ({d.key}): {d.rows} rows, {len(d.columns)} columns"]
    figures = d.brief(CHUNK_COLUMNS)
    lines += [f"- {c}: {d.types[c]}{described(d, c, figures[c])}" for c in d.columns[:CHUNK_COLUMNS]]
    lines += [json.dumps(r, default=str) for r in export_rows(d, limit=CHUNK_ROWS)]
    return {"id": d.key, "text": "\n".join(lines)[:CHUNK_CHARS], "metadata": {"rows": d.rows, "columns": d.columns[:20], "types": {c: d.types[c] for c in d.columns[:20]}, "fingerprint": d.fingerprint[:16]}}


def chunks(catalog: Catalog) -> list[dict[str, Any]]:
    return [chunk(d) for d in catalog.datasets.values()]


def artifact(d: Dataset, form: str = "csv", **options: Any) -> dict[str, Any]:
    """An export with its file name and MIME type."""
    if form not in MIME:
        raise ValueError(f"unknown format {form!r}")
    if form == "csv":
        content = export_csv(d, **options)
        count = content.count("\n") - 1
    elif form == "markdown":
        content = export_markdown(d, **options)
        count = min(options.get("max_rows", 50), d.rows)
    else:
        limit = options.pop("max_rows", 500)
        rows = export_rows(d, limit=limit, **options)
        count = len(rows)
        content = json.dumps(rows, default=str) if form == "json" else "\n".join(json.dumps(r, default=str) for r in rows)
    return {"filename": f"{d.key}.{'md' if form == 'markdown' else form}", "mime_type": MIME[form], "content": content, "row_count": count}


def write(df: DataFrame, path: str, form: str = "parquet", **options: Any) -> None:
    """A whole table as files: parquet, csv, json or orc."""
    df.drop(ROW).write.mode("overwrite").options(**options).format(form).save(path)


def estimated_tokens(column: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(column) / 4)


PROVIDERS = ("openai", "anthropic", "gemini", "xai")


def count_tokens(text: str, provider: str = "openai") -> int:
    """Tokens of a text: by tiktoken where its vocabulary is at hand, else estimated."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    if provider in ("openai", "xai"):
        try:
            import tiktoken

            return len(tiktoken.get_encoding("cl100k_base").encode(text))
        except Exception:  # no vocabulary here
            pass
    return math.ceil(len(text) / 4)
