"""Insights towards an objective: drivers, surprises, regimes, branches, and what would have to change."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.operators.moments import edges_of, numbers, numeric_fields

MIN_PAIRS = 30


def driver_fits(df: DataFrame, target: str, drivers: Sequence[str]) -> DataFrame:
    """driver, n, slope, intercept, r2 of each univariate fit, from one aggregation."""
    y = coerce.number(df, target)
    aggregates, entries = [], []
    for k, d in enumerate(drivers):
        x = F.when(y.isNotNull(), coerce.number(df, d))
        yy = F.when(x.isNotNull(), y)
        aggregates += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"mx{k}"), F.avg(yy).alias(f"my{k}"), F.var_pop(x).alias(f"vx{k}"), F.var_pop(yy).alias(f"vy{k}"), F.covar_pop(x, yy).alias(f"c{k}")]
        slope = F.try_divide(F.col(f"c{k}"), F.nullif(F.col(f"vx{k}"), F.lit(0.0)))
        r2 = F.try_divide(F.col(f"c{k}") * F.col(f"c{k}"), F.nullif(F.col(f"vx{k}") * F.col(f"vy{k}"), F.lit(0.0)))
        entries.append(F.struct(F.lit(k).alias("place"), F.lit(d).alias("driver"), F.col(f"n{k}").alias("n"), slope.alias("slope"), (F.col(f"my{k}") - slope * F.col(f"mx{k}")).alias("intercept"), r2.alias("r2")))
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def best_driver(df: DataFrame, target: str, drivers: Sequence[str]) -> dict[str, Any] | None:
    rows = driver_fits(df, target, drivers).filter((F.col("n") >= MIN_PAIRS) & F.col("r2").isNotNull()).orderBy(F.col("r2").desc(), "place").limit(1).collect()
    return rows[0].asDict() if rows else None


def surprises(df: DataFrame, target: str, driver: str, slope: float, intercept: float, top_k: int = 5, key: Sequence[str] = ("_row_id",)) -> DataFrame:
    """The rows furthest from the fit, with their residual and its z."""
    ties = [k for k in key if k in df.columns]
    rows = numbers(df, [target, driver], *ties).withColumn("residual", F.col(f"`{target}`") - (F.col(f"`{driver}`") * slope + intercept))
    joined = rows.crossJoin(F.broadcast(rows.agg(F.stddev_pop("residual").alias("__s"))))  # one row
    out = joined.withColumn("z", F.coalesce(F.try_divide("residual", F.nullif("__s", F.lit(0.0))), F.lit(0.0))).drop("__s")
    return out.orderBy(F.abs("residual").desc(), *ties).limit(top_k)


def regimes(df: DataFrame, target: str, driver: str, bins: int = 6) -> DataFrame:
    """bucket, low, high, n, mean of the target, jump to the next bucket (the mean of an empty one is 0)."""
    rows = numbers(df, [target, driver])
    edges = edges_of(rows, driver, bins)
    if not edges:
        return rows.sparkSession.createDataFrame([], "bucket int, n long, mean double, jump double")
    frame = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket"))
    means = rows.groupBy(coerce.bucket(F.col(f"`{driver}`"), edges).alias("bucket")).agg(F.count("*").alias("n"), F.avg(f"`{target}`").alias("mean"))
    out = frame.join(F.broadcast(means), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))  # a row for each bucket
    return out.withColumn("jump", F.lead("mean").over(Window.orderBy("bucket")) - F.col("mean"))


def boundaries(df: DataFrame, target: str, driver: str, bins: int = 6, z: float = 1.5) -> list[dict[str, Any]]:
    import numpy as np

    rows = regimes(df, target, driver, bins).orderBy("bucket").collect()
    jumps = np.array([r["jump"] for r in rows if r["jump"] is not None])
    spread = jumps.std() if len(jumps) else 0
    return [{"after": r["bucket"], "jump": r["jump"]} for r in rows if r["jump"] is not None and spread and abs(r["jump"] - jumps.mean()) / spread >= z]


def branch_spread(df: DataFrame, target: str, context: Sequence[str] | None = None, bins: int = 4, min_rows: int = 5) -> DataFrame:
    """bucket of the target, n, divergence: the mean over columns of (max - min) / |mean|."""
    names = [c for c in numeric_fields(df, context, 9) if c != target][:8]
    rows = df.select(coerce.number(df, target).alias("__t"), *[coerce.number(df, c).alias(c) for c in names]).filter("__t is not null")
    edges = edges_of(rows, "__t", bins)
    spread = [F.try_divide(F.max(f"`{c}`") - F.min(f"`{c}`"), F.nullif(F.abs(F.avg(f"`{c}`")), F.lit(0.0))) for c in names]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in spread), F.lit(0.0))
    there = sum((s.isNotNull().cast("int") for s in spread), F.lit(0))
    return rows.groupBy(coerce.bucket(F.col("__t"), edges).alias("bucket")).agg(F.count("*").alias("n"), F.try_divide(total, there).alias("divergence")).filter(F.col("n") >= min_rows)


def counterfactual(model: dict[str, Any], current: float, wanted: float) -> dict[str, Any]:
    """Which way the driver would have to move, and to what, for the target to be as wanted."""
    m = model["slope"]
    if not m:
        return {"advice": "none"}
    return {"driver": model["driver"], "advice": "increase" if (wanted - current) * m > 0 else "decrease", "required": (wanted - model["intercept"]) / m}


def insights(df: DataFrame, objective: dict[str, Any] | None = None, top_k: int = 5) -> dict[str, Any]:
    """All of it for the objective's target, or the first numeric column."""
    objective = objective or {}
    numeric = numeric_fields(df, None, 50)
    target = objective.get("target") if objective.get("target") in df.columns else (numeric[0] if numeric else None)
    if target is None:
        return {"error": "no numeric column"}
    best = best_driver(df, target, [c for c in numeric if c != target])
    if best is None:
        return {"target": target, "driver": None}
    out = {"target": target, "driver": best, "surprises": [r.asDict() for r in surprises(df, target, best["driver"], best["slope"], best["intercept"], top_k).collect()], "boundaries": boundaries(df, target, best["driver"]), "branches": [r.asDict() for r in branch_spread(df, target).collect()]}
    if objective.get("value") is not None:
        current = df.agg(F.avg(coerce.number(df, target))).first()[0]
        out["counterfactual"] = counterfactual(best, current, float(objective["value"]))
    return out
