"""Causal screening: graph search, transfer entropy, adjusted effects, synthetic controls."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.operators.moments import binned, edges_of, moments, normal_cdf, numbers, numeric_fields
from fathom.operators.order import numbered, stretched
from fathom.operators.screening import partial


def causal_graph(df: DataFrame, fields: Sequence[str] | None = None, alpha: float = 0.05, max_conditioning: int = 3) -> dict[str, Any]:
    """PC search on Fisher-z tests of partial correlations; colliders are oriented, then what follows from them."""
    names = numeric_fields(df, fields, 15)
    m = moments(df, names)
    near = {a: set(names) - {a} for a in names}
    apart: dict[frozenset, set] = {}
    for size in range(max_conditioning + 1):
        for a, b in itertools.combinations(names, 2):
            if b not in near[a]:
                continue
            for given in itertools.combinations(sorted(near[a] - {b}), size):
                r = partial(m, a, b, given)
                z = abs(math.atanh(max(min(r, 0.999999), -0.999999))) * math.sqrt(max(m.n - size - 3, 1))
                if 2 * (1 - normal_cdf(z)) > alpha:
                    near[a].discard(b)
                    near[b].discard(a)
                    apart[frozenset((a, b))] = set(given)
                    break
    arrows: set[tuple[str, str]] = set()
    for a, b in itertools.combinations(names, 2):
        if b not in near[a]:
            for c in near[a] & near[b]:
                if c not in apart.get(frozenset((a, b)), set()):
                    arrows |= {(a, c), (b, c)}
    changed = True
    while changed:
        changed = False
        for a, b in list(arrows):
            for c in near[b] - {a}:
                if c not in near[a] and (b, c) not in arrows and (c, b) not in arrows:
                    arrows.add((b, c))
                    changed = True
    edges = [(a, b) for a, b in itertools.combinations(names, 2) if b in near[a]]
    return {"n": m.n, "directed": sorted(x for x in arrows if x[::-1] not in arrows), "undirected": sorted(e for e in edges if (e in arrows) == (e[::-1] in arrows))}


def transfer_counts(df: DataFrame, source: str, target: str, order_by: Sequence[str], lag: int = 1, bins: int = 8) -> DataFrame:
    """future, past, driver (bins of the target, its past and the source's past), m."""
    return moved_counts(bins_in_order(df, source, target, order_by, bins), source, target, lag)


def bins_in_order(df: DataFrame, source: str, target: str, order_by: Sequence[str], bins: int) -> DataFrame:
    """rn (from 1) and the two fields as quantile buckets."""
    rows = numbers(df, [source, target], *order_by)
    bucket = lambda f: coerce.bucket(F.col(f"`{f}`"), edges_of(rows, f, bins)).alias(f)
    order = [f"__o{k}" for k in range(len(order_by))]
    kept = rows.select(bucket(source), bucket(target), *[F.col(f"`{o}`").alias(n) for o, n in zip(order_by, order, strict=True)])
    return numbered(kept, order).select("rn", source, target)


def moved_counts(rows: DataFrame, source: str, target: str, lag: int) -> DataFrame:
    w = Window.partitionBy("__b").orderBy("rn")
    moved = stretched(rows, "rn", lag, 0).select(F.col(target).alias("future"), F.lag(target, lag).over(w).alias("past"), F.lag(source, lag).over(w).alias("driver"), "__own")
    return moved.filter("__own").drop("__own").dropna().groupBy("future", "past", "driver").agg(F.count("*").alias("m"))


def transfer_entropy(df: DataFrame, source: str, target: str, order_by: Sequence[str], max_lag: int = 5, bins: int = 8) -> DataFrame:
    """lag, te_forward, te_backward in nats."""
    out, rows = None, bins_in_order(df, source, target, order_by, bins)
    for lag in range(1, max_lag + 1):
        sides = []
        for a, b, name in ((source, target, "te_forward"), (target, source, "te_backward")):
            c = moved_counts(rows, a, b, lag)
            w = lambda *k: F.sum("m").over(Window.partitionBy(*k))  # noqa: E731  over bins**3 cells
            q = c.select("m", w("past", "driver").alias("pd"), w("future", "past").alias("fp"), w("past").alias("p"), w(F.lit(1)).alias("t"))
            sides.append(q.agg(F.sum(F.col("m") / F.col("t") * F.log(F.col("m") * F.col("p") / (F.col("pd") * F.col("fp")))).alias(name)))
        one = sides[0].crossJoin(sides[1]).select(F.lit(lag).alias("lag"), "te_forward", "te_backward")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def transfer_significance(df: DataFrame, source: str, target: str, order_by: Sequence[str], lag: int, bins: int = 8, surrogates: int = 100, seed: int = 42) -> DataFrame:
    """observed, p_value: the transfer entropy at the lag, and the share of shuffled sources that reach it. Each shuffle is the
    order of a seeded hash of row number and shuffle; all are numbered at once, so no shuffle is brought into one task."""
    rows = bins_in_order(df, source, target, order_by, bins).dropna()
    kept = numbered(rows, ["rn"], "at").drop("rn")
    n = kept.count()
    copies = kept.select(F.explode(F.sequence(F.lit(0), F.lit(surrogates - 1))).alias("s"), F.col(source).alias("driver"), F.xxhash64(F.lit(seed), "at", "s").alias("h"), "at")
    moved = numbered(copies, ["s", "h", "at"], "rank").select("s", "driver", (F.col("rank") - 1 - F.col("s") * n + 1).alias("at"))
    own = kept.select(F.lit(-1).alias("s"), F.col(source).alias("driver"), (F.col("at") + lag).alias("at")).filter(F.col("at") <= n)
    w = Window.partitionBy("__b").orderBy("at")
    past = stretched(kept, "at", lag, 0).select("at", F.col(target).alias("future"), F.lag(target, lag).over(w).alias("past"), "__own").filter("__own").drop("__own").dropna()
    cells = own.unionByName(moved).join(past, "at").groupBy("s", "future", "past", "driver").agg(F.count("*").alias("m"))
    total = lambda *k: F.sum("m").over(Window.partitionBy("s", *k))  # noqa: E731  over bins**3 cells of each shuffle
    q = cells.select("s", "m", total("past", "driver").alias("pd"), total("future", "past").alias("fp"), total("past").alias("p"), total().alias("t"))
    each = q.groupBy("s").agg(F.sum(F.col("m") / F.col("t") * F.log(F.col("m") * F.col("p") / (F.col("pd") * F.col("fp")))).alias("te"))
    seen = F.max(F.when(F.col("s") < 0, F.col("te")))
    return each.agg(seen.alias("observed"), F.collect_list(F.when(F.col("s") >= 0, F.col("te"))).alias("x")).select("observed", (F.size(F.filter("x", lambda v: v >= F.col("observed"))) / F.lit(surrogates)).alias("p_value"))


def transfer_summary(df: DataFrame, source: str, target: str, order_by: Sequence[str], max_lag: int = 5, bins: int = 8, surrogates: int = 100) -> dict[str, Any]:
    """All lags, the best one, the net flow's direction there and the chance of a shuffled source to do as well."""
    lags = sorted(transfer_entropy(df, source, target, order_by, max_lag, bins).collect(), key=lambda r: r["lag"])  # max_lag rows
    best = max(lags, key=lambda r: (r["te_forward"], -r["lag"]))
    net = best["te_forward"] - best["te_backward"]
    p = transfer_significance(df, source, target, order_by, best["lag"], bins, surrogates).first()["p_value"]
    direction = f"{source} -> {target}" if net > 0.01 else f"{target} -> {source}" if net < -0.01 else "no_clear_direction"
    return {"lags": [r.asDict() for r in lags], "best_lag": best["lag"], "net_flow": net, "direction": direction, "p_value": p}


def effect(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str] = (), method: str = "regress", draws: int = 200, seed: int = 42) -> dict[str, Any]:
    """The treatment's coefficient with the confounders adjusted for, the naive one, and a bootstrap interval from weighted
    moments: every row gets Poisson weights from its hash, so one pass serves all draws."""
    if method != "regress":
        raise ValueError("only regress")
    names = [outcome, treatment, *confounders]
    m = moments(df, names)
    adjusted, naive = float(m.fit(outcome, [treatment, *confounders])[1][0]), float(m.fit(outcome, [treatment])[1][0])
    rows = numbers(df, names)
    columns = [(F.col(f"`{f}`") - float(mu)) for f, mu in zip(names, m.mean, strict=True)]
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    estimates = []
    for low in range(0, draws, 20):
        sums = []
        for d in range(low, min(low + 20, draws)):
            u = (F.pmod(F.xxhash64(*[F.col(f"`{f}`") for f in names], F.lit(seed * 100_003 + d)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
            w = F.lit(8)
            for k in range(7, -1, -1):
                w = F.when(u < float(cuts[k]), k).otherwise(w)
            sums += [F.sum(w), *[F.sum(w * c) for c in columns], *[F.sum(w * columns[i] * columns[j]) for i in range(len(names)) for j in range(i, len(names))]]
        got = rows.agg(*sums).first()
        width = 1 + len(names) + len(names) * (len(names) + 1) // 2
        for k in range(0, len(got), width):
            n, mean = got[k], np.array(got[k + 1 : k + 1 + len(names)], float)
            cov = np.zeros((len(names), len(names)))
            cov[np.triu_indices(len(names))] = got[k + 1 + len(names) : k + width]
            cov = cov + cov.T - np.diag(np.diag(cov))
            cov = cov / n - np.outer(mean / n, mean / n)
            estimates.append(float((np.linalg.pinv(cov[1:, 1:]) @ cov[1:, 0])[0]))
    return {"n": m.n, "effect": adjusted, "naive": naive, "bias": naive - adjusted, "low": float(np.percentile(estimates, 2.5)), "high": float(np.percentile(estimates, 97.5))}


def synthetic_control(df: DataFrame, outcome: str, time: str, unit: str, treated: str, intervention: Any, donors: Sequence[str] | None = None, ties: Sequence[str] = ("_row_id",)) -> dict[str, Any]:
    """Donor weights (least squares before the intervention, clipped at 0, summing to 1) and the impact after it."""
    order = F.struct(*[F.col(t) for t in ties if t in df.columns]) if any(t in df.columns for t in ties) else F.lit(1)
    rows = df.select(F.col(f"`{time}`").alias("t"), coerce.text(df, unit).alias("u"), coerce.number(df, outcome).alias("y"), order.alias("o")).dropna()
    units = list(donors) if donors else [r[0] for r in rows.select("u").distinct().orderBy("u").collect() if r[0] != treated][:200]
    wide = rows.filter(F.col("u").isin([treated, *units])).groupBy("t").pivot("u", [treated, *units]).agg(F.max_by("y", "o")).orderBy("t").dropna().collect()
    t = [r["t"] for r in wide]
    y = np.array([r[treated] for r in wide], float)
    x = np.array([[r[u] for u in units] for r in wide], float)
    before = np.array([v < intervention for v in t])
    if before.sum() < 3 or before.all():
        return {"error": "too few periods"}
    w = np.maximum(np.linalg.lstsq(x[before], y[before], rcond=None)[0], 0)
    w = w / w.sum() if w.sum() > 0 else np.full(len(units), 1 / len(units))
    gap = y - x @ w
    return {"weights": dict(zip(units, w.tolist(), strict=True)), "rmse_before": float(np.sqrt((gap[before] ** 2).mean())), "impacts": [{"time": a, "impact": float(b)} for a, b in zip(np.array(t, object)[~before], gap[~before], strict=True)][:50], "cumulative": float(gap[~before].sum())}


__all__ = ["binned", "causal_graph", "effect", "synthetic_control", "transfer_counts", "transfer_entropy"]
