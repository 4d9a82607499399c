"""Scale and symmetry."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.operators.moments import moments, numeric_fields
from fathom.operators.order import numbered, stretched


def in_order(df: DataFrame, names: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """__rn (from 1) and the fields as numbers."""
    order = [F.col(f"`{o}`").alias(f"__o{k}") for k, o in enumerate(order_by)]
    rows = df.select(*[coerce.number(df, f).alias(f) for f in names], *order)
    return numbered(rows, [f"__o{k}" for k in range(len(order))], "__rn").select("__rn", *names)


def renormalized(df: DataFrame, fields: Sequence[str] | None, order_by: Sequence[str], scale: int, rows: DataFrame | None = None) -> DataFrame:
    """Means of blocks of 2**(scale-1) rows in order; the last, incomplete block is left out. rows: in_order, if it is there already."""
    names = numeric_fields(df, fields, 10)
    size = 2 ** (scale - 1)
    rows = in_order(df, names, order_by) if rows is None else rows
    blocks = rows.groupBy(F.floor((F.col("__rn") - 1) / size).alias("__b")).agg(F.count("*").alias("__m"), *[F.avg(f).alias(f) for f in names])
    return blocks.filter(F.col("__m") == size).select(*names)


def renormalization_flow(df: DataFrame, fields: Sequence[str] | None, order_by: Sequence[str], max_scale: int = 5) -> list[dict[str, Any]]:
    """Mean and largest |correlation|, and mean standard deviation, at each scale."""
    names = numeric_fields(df, fields, 10)
    out, rows = [], in_order(df, names, order_by)
    for scale in range(1, max_scale + 1):
        m = moments(renormalized(df, names, order_by, scale, rows), names)
        if m.n < 5:
            break
        off = abs(m.corr[np.triu_indices(len(names), 1)])
        out.append({"scale": scale, "n": m.n, "mean_corr": float(off.mean()) if len(off) else 0.0, "max_corr": float(off.max()) if len(off) else 0.0, "mean_std": float(m.std.mean())})
    return out


def exchangeable(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """field_a, field_b, distance: the largest gap between values of the same rank, as a share of the largest value; permutation
    symmetry holds below 0.1. Rows that lack a field are left out; values meet by rank."""
    names = numeric_fields(df, fields, 15)
    rows = df.select(*[coerce.number(df, f).alias(f"v{k}") for k, f in enumerate(names)]).dropna()
    ranked = None
    for k in range(len(names)):
        one = numbered(rows.select(f"v{k}"), [f"v{k}"])
        ranked = one if ranked is None else ranked.join(one, "rn")
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    top = [F.max(F.abs(f"v{k}")).alias(f"t{k}") for k in range(len(names))]
    gaps = ranked.agg(*top, *[F.max(F.abs(F.col(f"v{a}") - F.col(f"v{b}"))).alias(f"g{a}_{b}") for a, b in pairs])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"g{a}_{b}"), F.greatest(f"t{a}", f"t{b}")), F.lit(0.0))
    return gaps.select(F.inline(F.array(*[F.struct(F.lit(names[a]).alias("field_a"), F.lit(names[b]).alias("field_b"), share(a, b).alias("distance")) for a, b in pairs]))).withColumn("exchangeable", F.col("distance") < 0.1)


def symmetry(df: DataFrame, fields: Sequence[str] | None, order_by: Sequence[str]) -> DataFrame:
    """field, n, translation (variation of the steps), log_skew of |x|, skew; reflection holds below 0.2."""
    names = numeric_fields(df, fields, 15)
    w = Window.partitionBy("__b").orderBy("__rn")
    rows = stretched(in_order(df, names, order_by), "__rn", 1, 0)
    rows = rows.select(*[F.col(f"`{f}`") for f in names], "__own", *[(F.col(f"`{f}`") - F.lag(f"`{f}`").over(w)).alias(f"{f}__d") for f in names]).filter("__own")
    entries = []
    aggregates = []
    for f in names:
        positive = F.when(F.col(f) != 0, F.log(F.abs(f)))
        aggregates += [F.count(f).alias(f"{f}__n"), F.stddev_pop(f"{f}__d").alias(f"{f}__ds"), F.avg(F.abs(f"{f}__d")).alias(f"{f}__da"), F.skewness(f).alias(f"{f}__s"), F.skewness(positive).alias(f"{f}__l")]
        entries.append(F.struct(F.lit(f).alias("field"), F.col(f"{f}__n").alias("n"), F.coalesce(F.try_divide(f"{f}__ds", f"{f}__da"), F.lit(0.0)).alias("translation"), F.coalesce(F.col(f"{f}__l"), F.lit(0.0)).alias("log_skew"), F.coalesce(F.col(f"{f}__s"), F.lit(0.0)).alias("skew")))
    out = rows.agg(*aggregates).select(F.inline(F.array(*entries)))
    return out.withColumn("reflection", F.abs("skew") < 0.2)
