"""Limits and thresholds of the engine, as frozen values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    ingest_chars: int = 3000
    preview_rows: int = 3
    summary_columns: int = 12
    rows_per_page: int = 50
    datasets: int = 50
    memory_bytes: int = 50 * 1024 * 1024
    min_rows: int = 3
    columns: int = 50
    aggregates: int = 20
    groups: int = 50
    csv_rows: int = 50_000
    sheet_rows: int = 10_000
    markdown_rows: int = 200
    row_export: int = 50_000
    predicate_depth: int = 20


LIMITS = Limits()
