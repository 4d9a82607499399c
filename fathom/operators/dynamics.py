"""Ordered series. Every operator takes the columns that order it; `partition_by` makes it a set of series, dealt by series."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.operators.order import numbered, stretched


def series(df: DataFrame, field: str, order_by: Sequence[str], partition_by: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """rn (from 1), v and the other fields, in order, where v is a number."""
    keys = [F.col(f"`{p}`").alias(p) for p in partition_by]
    rows = df.select(*keys, coerce.number(df, field).alias("v"), *[coerce.number(df, a).alias(a) for a in also], *[F.col(f"`{o}`").alias(f"__o{k}") for k, o in enumerate(order_by)]).filter("v is not null")
    order = [f"__o{k}" for k in range(len(order_by))]
    if not partition_by:
        return numbered(rows, order).select("rn", "v", *also)
    return rows.select(*partition_by, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order)).alias("rn"), "v", *also)


def around(rows: DataFrame, partition_by: Sequence[str], low: int, high: int) -> tuple[DataFrame, list[str]]:
    """rows as windows from `low` to `high` need them, and what these are partitioned by: the series, or stretches of the only one.
    Rows that stand there for other rows' windows alone have __own false."""
    if partition_by:
        return rows.withColumn("__own", F.lit(True)), list(partition_by)
    return stretched(rows, "rn", max(0, -low), max(0, high)), ["__b"]


def over(keys: Sequence[str], low: int, high: int):
    return Window.partitionBy(*keys).orderBy("rn").rowsBetween(low, high)


def autocorrelation(df: DataFrame, field: str, order_by: Sequence[str], max_lag: int = 20) -> DataFrame:
    """lag, acf (divided by n), beyond (outside 2/sqrt(n)). Lags meet by an equi-join of row numbers, so rows stay spread."""
    rows = series(df, field, order_by)
    stats = rows.agg(F.avg("v").alias("mu"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    centred = rows.crossJoin(F.broadcast(stats)).select("rn", (F.col("v") - F.col("mu")).alias("d"), "var", "n")  # stats is one row
    later = centred.select("d", "var", "n", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "rn").withColumn("at", F.col("rn") - F.col("lag")).drop("rn")
    pairs = later.join(centred.select(F.col("rn").alias("at"), F.col("d").alias("e")), "at")
    out = pairs.groupBy("lag").agg((F.sum(F.col("d") * F.col("e")) / F.nullif(F.max("n") * F.max("var"), F.lit(0.0))).alias("acf"), F.max("n").alias("n"))
    return out.select("lag", F.coalesce("acf", F.lit(0.0)).alias("acf"), (F.abs("acf") > 2 / F.sqrt("n")).alias("beyond"))


def changepoint_candidates(df: DataFrame, field: str, order_by: Sequence[str], min_segment: int = 10, threshold: float = 2.0, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rows where the mean of the next stretch differs from that of the last by more than `threshold` standard deviations."""
    rows = series(df, field, order_by, partition_by)
    everything = Window.partitionBy(*partition_by) if partition_by else None
    std = F.stddev_pop("v").over(everything) if everything else None
    wide, keys = around(rows, partition_by, -min_segment, min_segment - 1)
    last, following = over(keys, -min_segment, -1), over(keys, 0, min_segment - 1)
    marked = wide.select(*partition_by, "rn", F.avg("v").over(last).alias("before"), F.avg("v").over(following).alias("after"), F.count("v").over(last).alias("b"), F.count("v").over(following).alias("a"), "__own", *([std.alias("std")] if everything else [])).filter("__own")
    if not everything:
        marked = marked.crossJoin(F.broadcast(rows.agg(F.stddev_pop("v").alias("std"))))  # one row
    shift = F.try_divide(F.abs(F.col("after") - F.col("before")), F.col("std"))
    return marked.filter((F.col("a") == min_segment) & (F.col("b") == min_segment)).select(*partition_by, "rn", (F.col("after") - F.col("before")).alias("shift"), shift.alias("z")).filter(F.col("z") > threshold)


def changepoints(df: DataFrame, field: str, order_by: Sequence[str], min_segment: int = 10, threshold: float = 2.0) -> list[dict[str, Any]]:
    """Candidates in order, each at least a stretch after the last one taken."""
    out: list[dict[str, Any]] = []
    for r in changepoint_candidates(df, field, order_by, min_segment, threshold).orderBy("rn").toLocalIterator():
        if not out or r["rn"] - out[-1]["at"] >= min_segment:
            out.append({"at": r["rn"], "shift": r["shift"], "z": r["z"]})
    return out


def rolling(df: DataFrame, field: str, order_by: Sequence[str], window: int = 20, other: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """rn, mean, std, min, max (and corr with another field) of each full window that starts at a row."""
    rows = series(df, field, order_by, partition_by, [other] if other else [])
    rows, keys = around(rows, partition_by, 0, window - 1)
    w = over(keys, 0, window - 1)
    columns = [F.avg("v").over(w).alias("mean"), F.stddev_pop("v").over(w).alias("std"), F.min("v").over(w).alias("min"), F.max("v").over(w).alias("max")]
    if other:
        scale = F.stddev_pop("v").over(w) * F.stddev_pop(other).over(w)
        columns.append(F.coalesce(F.try_divide(F.covar_pop("v", other).over(w), F.nullif(scale, F.lit(0.0))), F.lit(0.0)).alias("corr"))
    return rows.select(*partition_by, "rn", *columns, F.count("v").over(w).alias("__n"), "__own").filter((F.col("__n") == window) & F.col("__own")).drop("__n", "__own")


def rolling_summary(df: DataFrame, field: str, order_by: Sequence[str], window: int = 20, other: str | None = None) -> DataFrame:
    """One row over all full windows: windows, trend_slope (of their means along the order), volatility (autocorrelation of their
    deviations at lag 1) and, with another field, sign_changes and stability of the correlation."""
    found = rolling(df, field, order_by, window, other)
    w = Window.partitionBy("__b").orderBy("rn")
    steps = stretched(found, "rn", 1, 0).withColumn("before", F.lag("std").over(w)).withColumn("turned", F.col("corr") * F.lag("corr").over(w) < 0 if other else F.lit(False)).filter("__own")
    mean = steps.agg(F.avg("std").alias("__mean"))  # one row
    apart = (F.col("std") - F.col("__mean")) * (F.col("before") - F.col("__mean"))
    out = steps.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("windows"), F.coalesce(F.regr_slope("mean", F.col("rn").cast("double")), F.lit(0.0)).alias("trend_slope"), F.coalesce(F.try_divide(F.sum(apart) / F.count("*"), F.nullif(F.var_pop("std"), F.lit(0.0))), F.lit(0.0)).alias("volatility"), F.count_if("turned").alias("sign_changes"))
    return out.withColumn("stability", 1 - F.col("sign_changes") / F.greatest("windows", F.lit(1))) if other else out.drop("sign_changes")


def acf_summary(df: DataFrame, field: str, order_by: Sequence[str], max_lag: int = 20) -> dict[str, Any]:
    """The autocorrelations by lag, the lags beyond chance, the period (lag of the first peak beyond it) and whether the first five lags
    fall by more than 0.3, as a stationary series' do."""
    rows = sorted(autocorrelation(df, field, order_by, max_lag).collect(), key=lambda r: r["lag"])  # max_lag rows
    acf = [r["acf"] for r in rows]
    peaks = (r["lag"] for a, r, b in zip(rows, rows[1:], rows[2:], strict=False) if r["acf"] > max(a["acf"], b["acf"]) and r["acf"] > 0 and r["beyond"])
    fall = abs(acf[0] - acf[4]) if len(acf) > 4 else 1.0
    return {"lags": [r.asDict() for r in rows], "significant": [r["lag"] for r in rows if r["beyond"]], "period": next(peaks, None), "stationary": fall > 0.3}


def ergodicity(df: DataFrame, field: str, order_by: Sequence[str], windows: Sequence[int] = (10, 25, 50, 100)) -> DataFrame:
    """window, chunks, spread (standard deviation of chunk means, strides of half a window), ratio to what independence gives."""
    rows = series(df, field, order_by)
    out = None
    for w in windows:
        means = rolling_mean(rows, w).filter((F.col("rn") - 1) % max(w // 2, 1) == 0)
        one = means.agg(F.lit(w).alias("window"), F.count("*").alias("chunks"), F.stddev_pop("mean").alias("spread"))
        out = one if out is None else out.unionByName(one)
    return out


def rolling_mean(rows: DataFrame, window: int) -> DataFrame:
    rows, keys = around(rows, (), 0, window - 1)
    w = over(keys, 0, window - 1)
    return rows.select("rn", F.avg("v").over(w).alias("mean"), F.count("v").over(w).alias("__n"), "__own").filter((F.col("__n") == window) & F.col("__own")).drop("__n", "__own")


def ergodic(df: DataFrame, field: str, order_by: Sequence[str], windows: Sequence[int] = (10, 25, 50, 100)) -> dict[str, Any]:
    rows = sorted(ergodicity(df, field, order_by, windows).filter("chunks > 1").collect(), key=lambda r: r["window"])
    first = rows[0] if rows else None
    ratios = [(r["spread"] / first["spread"]) / math.sqrt(first["window"] / r["window"]) if first["spread"] else 1.0 for r in rows]
    return {"ratios": ratios, "ergodic": all(0.5 < x < 2 for x in ratios)}


def first_zero(rows: DataFrame, n: int, step: int = 64) -> int:
    """The first lag below n / 3 whose autocorrelation over all rows is not positive, or 1; lags are looked at step by step."""
    mu = rows.agg(F.avg("v")).first()[0]
    centred = rows.select("rn", (F.col("v") - float(mu)).alias("d")).cache()
    try:
        low, last = 1, n // 3 - 1
        while low <= last:
            lags = F.sequence(F.lit(low), F.lit(min(low + step - 1, last)))
            later = centred.select("d", F.explode(lags).alias("lag"), "rn").select("d", "lag", (F.col("rn") - F.col("lag")).alias("at"))
            pairs = later.join(centred.select(F.col("rn").alias("at"), F.col("d").alias("e")), "at")
            found = pairs.groupBy("lag").agg(F.sum(F.col("d") * F.col("e")).alias("c")).filter("c <= 0").agg(F.min("lag")).first()[0]
            if found is not None:
                return int(found)
            low += step
        return 1
    finally:
        centred.unpersist()


def delayed(rows: DataFrame, dimension: int, tau: int) -> DataFrame:
    """at (from 0) and e, the delay vector that begins there, of all rows that have one; rows meet by number."""
    spread = rows.select("v", F.explode(F.sequence(F.lit(0), F.lit(dimension - 1))).alias("j"), "rn")
    spread = spread.select((F.col("rn") - 1 - F.col("j") * tau).alias("at"), F.struct("j", "v").alias("x"))
    grouped = spread.filter("at >= 0").groupBy("at").agg(F.array_sort(F.collect_list("x")).alias("x")).filter(F.size("x") == dimension)
    return grouped.select("at", F.col("x.v").alias("e"))


def nearest(vectors: DataFrame, probes: int, apart: int) -> list[tuple[int, int, float]]:
    """For each of the first vectors: its place, that of the nearest of all vectors more than `apart` places away, and the distance."""
    first = vectors.filter(F.col("at") < probes).select(F.col("at").alias("p"), F.col("e").alias("q"))
    gap = F.sqrt(F.aggregate(F.zip_with("e", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    pairs = vectors.crossJoin(F.broadcast(first)).filter(F.abs(F.col("at") - F.col("p")) > apart)  # `probes` rows at most
    near = pairs.groupBy("p").agg(F.min(F.struct(gap.alias("d"), F.col("at"))).alias("m"))
    return [(r["p"], r["at"], r["d"]) for r in near.select("p", "m.at", "m.d").orderBy("p").collect()]


def phase_space(df: DataFrame, field: str, order_by: Sequence[str], max_dimension: int = 10, tau: int | None = None, probes: int = 200) -> dict[str, Any]:
    """Delay (first zero of the autocorrelation), embedding dimension (false neighbours below 5 %), largest Lyapunov slope.

    All rows count: the autocorrelation is theirs, and neighbours are searched among all delay vectors. As in the reference, they
    are searched for the first `probes` vectors (half as many for the slope) only."""
    rows = series(df, field, order_by).cache()
    try:
        n = rows.count()
        if n < 20:
            return {"error": "too few rows"}
        if tau is None:
            tau = first_zero(rows, n)
        values = lambda at: {r["rn"] - 1: r["v"] for r in rows.join(F.broadcast(df.sparkSession.createDataFrame([(int(k) + 1,) for k in at], "rn long")), "rn").collect()}
        dimension = max_dimension
        for m in range(1, max_dimension):
            count = min(probes, n - (m - 1) * tau)
            if count < 20:
                dimension = m
                break
            near = [(p, q, d) for p, q, d in nearest(delayed(rows, m, tau), count, 0) if d >= 1e-12 and max(p, q) + m * tau < n]
            v = values({k + m * tau for p, q, _ in near for k in (p, q)}) if near else {}
            false = sum(abs(v[p + m * tau] - v[q + m * tau]) / d > 15 for p, q, d in near)
            if false / count < 0.05:
                dimension = m
                break
        length = n - (dimension - 1) * tau
        logs: list[tuple[int, float]] = []
        if length >= 30:
            near = [(p, q, d) for p, q, d in nearest(delayed(rows, dimension, tau), min(probes // 2, length - 10), tau) if d >= 1e-12]
            steps = [(k, p + k, q + k, d) for p, q, d in near for k in range(1, 11) if max(p, q) + k < length]
            v = values({a + j * tau for _, p, q, _ in steps for a in (p, q) for j in range(dimension)}) if steps else {}
            for k, p, q, d in steps:
                far = math.sqrt(sum((v[p + j * tau] - v[q + j * tau]) ** 2 for j in range(dimension)))
                if far > 1e-12:
                    logs.append((k, math.log(far / d)))
        slope = float(np.polyfit(*np.array(logs).T, 1)[0]) if len({k for k, _ in logs}) > 1 else 0.0
    finally:
        rows.unpersist()
    return {"tau": tau, "dimension": dimension, "lyapunov": slope, "label": "chaotic" if slope > 0.05 else "stable" if slope < -0.05 else "periodic"}


def recurrence(df: DataFrame, fields: Sequence[str], order_by: Sequence[str], threshold: float | None = None, embedding: int = 3, most: int = 500) -> dict[str, Any]:
    """Recurrence rate, determinism, laminarity, trapping time and diagonal entropy of at most `most` states. One field is embedded
    over all rows; then states are taken evenly spaced, as in the reference."""
    rows = series(df, fields[0], order_by, (), fields[1:])
    states = delayed(rows, embedding, 1) if len(fields) == 1 else rows.select((F.col("rn") - 1).alias("at"), F.array("v", *[F.col(f"`{f}`") for f in fields[1:]]).alias("e"))
    n = states.count()
    if n > most:
        chosen = df.sparkSession.createDataFrame([(int(k),) for k in np.linspace(0, n - 1, most, dtype=int)], "at long")
        states = states.join(F.broadcast(chosen), "at")
    x = np.array([r["e"] for r in states.orderBy("at").collect()], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    cut = float(np.percentile(d, 10)) if threshold is None else threshold
    r = (d <= cut) & ~np.eye(len(x), dtype=bool)

    def lines(m: np.ndarray) -> list[int]:
        edge = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        return (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist()

    diagonal = np.array([n for k in range(1, len(x)) for n in lines(np.diagonal(r, k)) if n >= 2])
    vertical = np.array([n for k in range(len(x)) for n in lines(r[:, k]) if n >= 2])
    p = np.unique(diagonal, return_counts=True)[1] / max(len(diagonal), 1)
    total = max(int(r.sum()), 1)
    return {"threshold": cut, "rate": float(r.mean()), "determinism": float(2 * diagonal.sum() / total), "laminarity": float(vertical.sum() / total), "trapping_time": float(vertical.mean()) if len(vertical) else 0.0, "entropy": float(-(p * np.log(p)).sum()) if len(p) else 0.0}


def coarse(rows: DataFrame, scale: int, column: Column | None = None) -> DataFrame:
    """Means of blocks of `scale` rows; an incomplete last block is left out."""
    out = rows.groupBy(F.floor((F.col("rn") - 1) / scale).alias("block")).agg(F.avg(column if column is not None else "v").alias("v"), F.count("*").alias("m"))
    return out.filter(F.col("m") == scale).drop("m")


def sample_entropy(df: DataFrame, field: str, order_by: Sequence[str], max_scale: int = 10, dimension: int = 2, tolerance: float = 0.15) -> DataFrame:
    """scale, matches of `dimension` and of one more value, entropy. Templates are n - dimension for both; near values meet by a
    join of grid cells as wide as the tolerance, never all with all."""
    rows = series(df, field, order_by)
    out = None
    for scale in range(1, max_scale + 1):
        values = coarse(rows, scale)
        stats = values.agg(F.stddev_pop("v").alias("s"), F.count("*").alias("n")).first()
        r, n = tolerance * (stats["s"] or 0.0), stats["n"] or 0
        if n <= dimension + 1 or r <= 0:
            continue
        w = Window.partitionBy("__b").orderBy("block")
        t = stretched(values, "block", 0, dimension).select("block", "__own", *[F.lead("v", k).over(w).alias(f"x{k}") for k in range(dimension + 1)]).filter("__own").drop("__own").dropna()
        cell = F.floor(F.col("x0") / r)
        left = t.withColumn("cell", cell)
        right = t.select(F.col("block").alias("block2"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(dimension + 1)], F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        near = [F.abs(F.col(f"x{k}") - F.col(f"y{k}")) <= r for k in range(dimension + 1)]
        short = near[0]
        for x in near[1:dimension]:
            short = short & x
        one = left.join(right, "cell").filter((F.col("block2") > F.col("block")) & short).agg(F.count("*").alias("b"), F.count_if(near[dimension]).alias("a")).select(F.lit(scale).alias("scale"), "b", "a")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("entropy", -F.log(F.try_divide(F.col("a").cast("double"), F.col("b"))))
