"""Data quality: distributions, outliers, first digits, collinearity, dimension."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.moments import chi2_tail, moments, numbers, numeric_fields

QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def distribution(df: DataFrame, field: str) -> DataFrame:
    """One row: n, mean, median, std, skew, excess kurtosis (all of the population), quantiles (interpolated), Jarque-Bera."""
    rows = numbers(df, [field]).withColumnRenamed(field, "x")
    one = rows.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.coalesce(F.skewness("x"), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis("x"), F.lit(0.0)).alias("kurtosis"), F.percentile("x", list(QUANTILES)).alias("q"),
    )
    jb = F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4)
    return one.select("n", "mean", "median", "std", "lo", "hi", "skew", "kurtosis", *[F.col("q")[k].alias(f"p{round(q * 100)}") for k, q in enumerate(QUANTILES)], jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"))


def histogram(df: DataFrame, field: str, bins: int = 15) -> DataFrame:
    """Equal-width bins: bin, count."""
    rows = numbers(df, [field]).withColumnRenamed(field, "x")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)).cast("int"), F.lit(bins - 1))).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))  # ends is one row


def shape(skew: float, kurtosis: float) -> str:
    if abs(skew) < 0.5 and abs(kurtosis) < 1:
        return "near_normal"
    if abs(skew) >= 1:
        return "right_skewed" if skew > 0 else "left_skewed"
    return "heavy_tailed" if kurtosis >= 1 else "light_tailed" if kurtosis <= -1 else "moderately_skewed"


def outliers(df: DataFrame, fields: Sequence[str] | None = None, method: str = "both", threshold: float = 3.0, key: str = "_row_id", top: int = 50) -> DataFrame:
    """The rows with the largest sum of |z| over the fields where they are outliers by z-score or 1.5 interquartile ranges."""
    names = numeric_fields(df, fields, 20)
    rows = df.select(F.col(key).alias(key), *[F.col(f"`{f}`").cast("double").alias(f) for f in names])
    stats = rows.agg(*[x for f in names for x in (F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"), F.percentile(f, [0.25, 0.75]).alias(f"{f}__q"))])
    joined = rows.crossJoin(F.broadcast(stats))  # stats is one row
    severity, flagged = F.lit(0.0), F.lit(0)
    for f in names:
        z = F.coalesce(F.abs(F.try_divide(F.col(f) - F.col(f"{f}__m"), F.col(f"{f}__s"))), F.lit(0.0))
        spread = F.col(f"{f}__q")[1] - F.col(f"{f}__q")[0]
        outside = (F.col(f) < F.col(f"{f}__q")[0] - 1.5 * spread) | (F.col(f) > F.col(f"{f}__q")[1] + 1.5 * spread)
        hit = F.coalesce({"zscore": z > threshold, "iqr": outside}.get(method, (z > threshold) | outside), F.lit(False))
        severity, flagged = severity + F.when(hit, z).otherwise(0.0), flagged + hit.cast("int")
    out = joined.select(key, severity.alias("severity"), flagged.alias("n_fields")).filter("n_fields > 0")
    return out.orderBy(F.col("severity").desc(), key).limit(top)


def first_digits(df: DataFrame, field: str) -> DataFrame:
    """digit, n, expected share by Benford's law; zero is left out."""
    x = F.abs(F.col(field))
    digit = F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int")
    digit = F.least(F.greatest(digit, F.lit(1)), F.lit(9))
    return numbers(df, [field]).filter(x > 0).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).withColumn("expected", F.log10(1 + 1.0 / F.col("digit")))


def benford(df: DataFrame, field: str) -> dict[str, Any]:
    counts = {r["digit"]: r["n"] for r in first_digits(df, field).collect()}
    n = sum(counts.values())
    if n < 50:
        return {"error": "too few values"}
    chi2 = sum((counts.get(d, 0) - n * math.log10(1 + 1 / d)) ** 2 / (n * math.log10(1 + 1 / d)) for d in range(1, 10))
    p = chi2_tail(chi2, 8)
    return {"n": n, "counts": counts, "chi2": chi2, "p_value": p, "verdict": "conforms" if p > 0.10 else "suspicious" if p > 0.01 else "fails"}


def vif(df: DataFrame, fields: Sequence[str] | None = None) -> list[dict[str, Any]]:
    """Variance inflation: the diagonal of the inverse correlation matrix, 999 at most."""
    names = numeric_fields(df, fields, 20)
    m = moments(df, names)
    out = []
    for f in names:
        _, _, r2 = m.fit(f, [g for g in names if g != f])
        v = 999.0 if r2 >= 1 - 1 / 999 else 1 / (1 - r2)
        out.append({"field": f, "vif": v, "collinear": v > 10})
    return sorted(out, key=lambda r: -r["vif"])


def effective_dimension(df: DataFrame, fields: Sequence[str] | None = None, sample: int = 1000, neighbours: int = 5, seed: int = 42, method: str = "both") -> dict[str, Any]:
    """Participation ratio of the spectrum and, where the method is "mle" or "both", the Levina-Bickel estimate on a bounded sample
    chosen by hash."""
    if method not in ("both", "mle", "participation_ratio"):
        raise ValueError(f"unknown method {method!r}")
    names = numeric_fields(df, fields, 30)
    m = moments(df, names)
    values = np.linalg.eigvalsh(m.corr)[::-1]
    ratio = float(values.sum() ** 2 / (values**2).sum())
    out = {"fields": names, "samples": m.n, "spectrum": values.tolist(), "cumulative": (np.cumsum(values) / values.sum()).tolist(), "participation_ratio": ratio, "redundancy": len(names) / ratio if ratio > 0.1 else None}
    if method == "participation_ratio":
        return out
    points = hashed_sample(df, names, sample, seed)
    scale = points.std(axis=0)
    z = (points - points.mean(axis=0)) / np.where(scale > 0, scale, 1)
    mle = 0.0
    if len(z) > neighbours:
        d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2))
        near = np.sort(d, axis=1)[:, 1 : neighbours + 1]
        good = near[(near > 0).all(axis=1)]
        if len(good):
            logs = np.log(good[:, -1:] / good[:, :-1]).sum(axis=1)
            mle = float(np.mean((neighbours - 1) / logs[logs > 0])) if (logs > 0).any() else 0.0
    return out | {"levina_bickel": mle, "levina_bickel_sample": len(points)}


def hashed_sample(df: DataFrame, fields: Sequence[str], n: int, seed: int = 42) -> np.ndarray:
    """At most n complete rows, by hash order: the same ones however the table is partitioned."""
    rows = numbers(df, fields)
    got = rows.orderBy(F.xxhash64(*[F.col(f"`{f}`") for f in fields], F.lit(seed)), *[F.col(f"`{f}`") for f in fields]).limit(n).collect()
    return np.array([list(r) for r in got], float).reshape(len(got), len(fields))
