"""What drives a column: shapes, interactions, sparse models, importance, bottlenecks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.moments import Moments, binned, moments, numbers

GAIN = 0.02


def polynomial(df: DataFrame, x: str, y: str, max_degree: int = 3) -> dict[str, Any]:
    """r2 of degrees 1 to 3 from power moments; a degree is accepted if it gains more than 0.02."""
    rows = numbers(df, [x, y])
    ends = rows.agg(F.avg(f"`{x}`"), F.stddev_pop(f"`{x}`")).first()
    z = (F.col(f"`{x}`") - (ends[0] or 0.0)) / (ends[1] or 1.0)  # centred, so that powers stay apart
    powers = [f"p{k}" for k in range(1, min(max_degree, 3) + 1)]
    m = moments(rows.select(F.col(f"`{y}`").alias("y"), *[F.pow(z, F.lit(k + 1)).alias(p) for k, p in enumerate(powers)]), ["y", *powers])
    r2 = [m.fit("y", powers[: k + 1])[2] for k in range(len(powers))]
    best = 1
    for k in range(1, len(r2)):
        if r2[k] - r2[best - 1] > GAIN:
            best = k + 1
    return {"n": m.n, "r2": r2, "degree": best}


def interactions(df: DataFrame, target: str, candidates: Sequence[str], top_k: int = 5) -> list[dict[str, Any]]:
    """Pairs by how much their product adds to both; one aggregation for all products."""
    names = list(candidates)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = numbers(df, [target, *names])
    wide = rows.select("*", *[(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}*{b}") for a, b in pairs])
    m = moments(wide, [target, *names, *[f"{a}*{b}" for a, b in pairs]])
    out = []
    for a, b in pairs:
        alone = m.fit(target, [a])[2], m.fit(target, [b])[2]
        both, joint = m.fit(target, [a, b])[2], m.fit(target, [a, b, f"{a}*{b}"])[2]
        gain = joint - both
        out.append({"a": a, "b": b, "r2_a": alone[0], "r2_b": alone[1], "r2_additive": both, "r2_joint": joint, "strength": gain, "kind": "synergy" if gain > GAIN else "suppression" if both - sum(alone) < -GAIN else "additive"})
    return sorted(out, key=lambda r: -r["strength"])[:top_k]


def lasso(corr: np.ndarray, target: np.ndarray, alpha: float, rounds: int = 500) -> np.ndarray:
    """Coordinate descent on standardised moments."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            rest = target[j] - corr[j] @ w + corr[j, j] * w[j]
            w[j] = np.sign(rest) * max(abs(rest) - alpha, 0) / max(corr[j, j], 1e-12)
        if abs(w - before).max() < 1e-8:
            break
    return w


def sparse_drivers(df: DataFrame, target: str, candidates: Sequence[str], alpha: float | None = None, max_features: int = 10, folds: int = 5, key: str | None = None) -> dict[str, Any]:
    """A sparse linear model on standardised columns. Without alpha, 20 of them compete by error on held-out folds (dealt by hash);
    the moments of each fold come from one pass per fold."""
    names = list(candidates)
    rows = numbers(df, [target, *names])
    m = moments(rows, [target, *names])
    c = m.corr
    if alpha is None:
        fold = F.pmod(F.xxhash64(*[F.col(f"`{f}`") for f in [target, *names]]), F.lit(folds))
        parts = [moments(rows.filter(fold == k), [target, *names]) for k in range(folds)]
        grid = np.geomspace(max(abs(c[0, 1:]).max(), 1e-6), 1e-3 * max(abs(c[0, 1:]).max(), 1e-6), 20)
        losses = []
        for a in grid:
            loss = 0.0
            for held in parts:
                rest = complement(m, held)
                w = lasso(rest.corr[1:, 1:], rest.corr[0, 1:], a)
                h = held.corr
                loss += 1 - 2 * w @ h[0, 1:] + w @ h[1:, 1:] @ w
            losses.append(loss)
        alpha = float(grid[int(np.argmin(losses))])
    w = lasso(c[1:, 1:], c[0, 1:], alpha)
    order = [k for k in np.argsort(-abs(w)) if w[k] != 0][:max_features]
    return {"n": m.n, "alpha": alpha, "drivers": [{"driver": names[k], "weight": float(w[k])} for k in order], "r2": float(2 * w @ c[0, 1:] - w @ c[1:, 1:] @ w)}


def complement(whole: Moments, part: Moments) -> Moments:
    """The moments of the rows that are not in the part."""
    n = whole.n - part.n
    raw = lambda m: m.n * (m.cov + np.outer(m.mean, m.mean))
    mean = (whole.n * whole.mean - part.n * part.mean) / max(n, 1)
    return Moments(whole.fields, n, mean, (raw(whole) - raw(part)) / max(n, 1) - np.outer(mean, mean))


def importance(df: DataFrame, target: str, candidates: Sequence[str]) -> list[dict[str, Any]]:
    """The loss of r2 when a column is made useless and the model fitted anew: what shuffling it estimates, without the noise."""
    names = list(candidates)
    m = moments(df, [target, *names])
    full = m.fit(target, names)[2]
    out = [{"driver": d, "importance": full - m.fit(target, [x for x in names if x != d])[2]} for d in names]
    return sorted(out, key=lambda r: -r["importance"])


def bottleneck(df: DataFrame, inputs: Sequence[str], target: str, beta: float = 1.0, n_clusters: int = 5, bins: int = 8, rounds: int = 100) -> dict[str, Any]:
    """Hard information bottleneck: states of binned inputs are put into clusters that keep what they say about the target.
    The driver sees the table of states and target bins, not the rows."""
    rows = binned(df, [*inputs, target], bins)
    table = rows.groupBy(F.concat_ws("|", *[F.col(f"`{f}`").cast("string") for f in inputs]).alias("state"), F.col(f"`{target}`").alias("t")).agg(F.count("*").alias("m")).orderBy("state", "t").collect()
    states = sorted({r["state"] for r in table})
    joint = np.zeros((len(states), bins))
    for r in table:
        joint[states.index(r["state"]), r["t"]] += r["m"]
    joint /= joint.sum()
    p = joint.sum(axis=1)
    given = joint / p[:, None]
    k = min(n_clusters, len(states))
    of = np.arange(len(states)) % k
    for _ in range(rounds):
        weight = np.array([p[of == c].sum() for c in range(k)])
        center = np.array([joint[of == c].sum(axis=0) / w if w else np.full(bins, 1 / bins) for c, w in enumerate(weight)])
        kl = (given[:, None, :] * (np.log(given[:, None, :] + 1e-12) - np.log(center[None] + 1e-12))).sum(axis=2)
        new = np.argmin(kl - np.log(weight + 1e-12)[None] / max(beta, 1e-9), axis=1)
        if (new == of).all():
            break
        of = new

    def information(q: np.ndarray) -> float:
        a, b = q.sum(axis=1, keepdims=True), q.sum(axis=0, keepdims=True)
        return float((q[q > 0] * np.log((q / (a * b + 1e-300))[q > 0])).sum())

    merged = np.array([joint[of == c].sum(axis=0) for c in range(k) if (of == c).any()])
    whole = information(joint)
    return {"states": len(states), "clusters": len(merged), "information": whole, "preserved": information(merged) / whole if whole > 0 else 1.0, "assignment": dict(zip(states, of.tolist(), strict=True))}
