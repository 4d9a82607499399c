"""Regression and screening on shared moments, and ranking of stored rows against a goal."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import coerce, predicate
from fathom.operators.moments import Moments, moments, numeric_fields, numbers

WEIGHTS = {"partial": 0.45, "raw": 0.35, "coefficient": 0.20}


def regress(df: DataFrame, target: str, drivers: Sequence[str]) -> dict[str, Any]:
    """Least squares of target on all drivers: coefficients (largest first), r2, adjusted r2."""
    m = moments(df, [target, *drivers])
    if m.n < len(drivers) + 2:
        return {"error": "too few complete rows"}
    intercept, coef, r2 = m.fit(target, drivers)
    if not coef.any() and r2 == 0:
        return {"error": "singular"}
    rows = [{"driver": d, "coefficient": float(c), "correlation": float(m.corr[0, m.fields.index(d)])} for d, c in zip(drivers, coef, strict=True)]
    adjusted = 1 - (1 - r2) * (m.n - 1) / max(m.n - len(drivers) - 1, 1)
    return {"n": m.n, "intercept": intercept, "r2": r2, "adjusted_r2": adjusted, "drivers": sorted(rows, key=lambda r: -abs(r["coefficient"]))}


def partial(m: Moments, a: str, b: str, controls: Sequence[str]) -> float:
    """Correlation of a and b with the controls held constant, from the inverse correlation matrix."""
    c = m.of(list(dict.fromkeys([a, b, *controls]))).corr
    p = np.linalg.pinv(c)
    scale = p[0, 0] * p[1, 1]
    return float(np.clip(-p[0, 1] / np.sqrt(scale), -1, 1)) if scale > 0 else 0.0


def partial_correlation(df: DataFrame, a: str, b: str, controls: Sequence[str]) -> dict[str, Any]:
    m = moments(df, [a, b, *controls])
    raw, held = float(m.corr[0, 1]), partial(m, a, b, controls)
    return {"n": m.n, "raw": raw, "partial": held, "change": held - raw}


def pca(df: DataFrame, fields: Sequence[str] | None = None, n_components: int = 3) -> dict[str, Any]:
    """Components of the z-scored fields; eigenvalues carry n/(n-1), as a sample covariance of z-scores does."""
    names = numeric_fields(df, fields, 10)
    m = moments(df, names)
    values, vectors = np.linalg.eigh(m.corr * m.n / max(m.n - 1, 1))
    order = np.argsort(values)[::-1][:n_components]
    out = []
    for k in order:
        vector = vectors[:, k] * np.sign(vectors[np.argmax(abs(vectors[:, k])), k])
        top = sorted(zip(names, vector.tolist(), strict=True), key=lambda x: -abs(x[1]))[:5]
        out.append({"eigenvalue": float(values[k]), "share": float(values[k] / max(values.sum(), 1e-300)), "loadings": top, "vector": vector.tolist()})
    return {"n": m.n, "fields": names, "components": out, "mean": m.mean.tolist(), "std": m.std.tolist()}


def pca_scores(df: DataFrame, fields: Sequence[str] | None = None, n_components: int = 3) -> DataFrame:
    """Rows on the components, as linear combinations inside the plan."""
    found = pca(df, fields, n_components)
    rows = numbers(df, found["fields"])
    z = [(F.col(f"`{f}`") - mean) / (std or 1.0) for f, mean, std in zip(found["fields"], found["mean"], found["std"], strict=True)]
    return rows.select(*[sum((w * c for w, c in zip(comp["vector"], z, strict=True)), F.lit(0.0)).alias(f"pc{k + 1}") for k, comp in enumerate(found["components"])])


def dependency_screen(df: DataFrame, target: str, candidates: Sequence[str], controls: Sequence[str] = (), top_k: int = 8) -> list[dict[str, Any]]:
    """Candidates ranked by partial and raw correlation and standardised coefficient."""
    out = []
    for c in list(candidates)[:50]:
        m = moments(df, [target, c, *controls])
        if m.n < len(controls) + 5:
            continue
        held, raw = partial(m, target, c, controls), float(m.corr[0, 1])
        _, coef, _ = m.fit(target, [c, *controls])
        out.append({"candidate": c, "n": m.n, "partial": held, "raw": raw, "coefficient": float(coef[0]), "score": WEIGHTS["partial"] * abs(held) + WEIGHTS["raw"] * abs(raw) + WEIGHTS["coefficient"] * min(abs(float(coef[0])), 1)})
    return sorted(out, key=lambda r: -r["score"])[:top_k]


def solve(df: DataFrame, target: str, goal: dict, constraints: Sequence[dict] = (), top_k: int = 5, ties: Sequence[str] = ("_row_id",), shown: Sequence[str] = ()) -> DataFrame:
    """Stored rows (the columns `shown` and the target, if any are named) ranked against a goal: {"mode" or "direction": maximize | minimize | hit_target | range, "target", "min", "max"}."""
    mode = goal.get("mode") or goal.get("direction") or "maximize"
    rows = predicate.where(df, {"and": list(constraints)})
    x = coerce.number(df, target)
    if mode == "range":
        wanted = (float(goal["min"]) + float(goal["max"])) / 2
    elif mode == "hit_target":
        wanted = float(goal["target"])
    score = {"maximize": x, "minimize": -x}.get(mode)
    score = -F.abs(x - wanted) if score is None else score
    order = [F.col("score").desc(), *[F.col(t).asc() for t in ties if t in df.columns]]
    kept = [c for c in dict.fromkeys([*shown, target, *ties]) if c in df.columns] if shown else df.columns
    found = rows.withColumn("score", score).filter("score is not null").orderBy(*order).limit(top_k)
    return found.select(*[F.col(f"`{c}`") for c in kept], "score")
