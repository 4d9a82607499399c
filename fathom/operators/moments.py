"""Shared second moments: one aggregation gives every linear statistic its numbers; the driver gets columns**2 of them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.operators.order import running


def numbers(df: DataFrame, fields: Sequence[str], *more: str) -> DataFrame:
    """The fields as doubles, in rows where all of them are numbers; `more` columns are carried along."""
    out = df.select(*[coerce.number(df, f).alias(f) for f in fields], *[F.col(f"`{m}`").alias(m) for m in more if m not in fields])
    return out.dropna(subset=list(fields))


def numeric_fields(df: DataFrame, fields: Sequence[str] | None, most: int) -> list[str]:
    """The fields asked for, or the first numeric ones."""
    return list(fields)[:most] if fields else [f.name for f in df.schema if coerce.is_numeric(f.dataType)][:most]


@dataclass
class Moments:
    fields: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray  # of the population

    def of(self, names: Sequence[str]) -> Moments:
        at = [self.fields.index(f) for f in names]
        return Moments(list(names), self.n, self.mean[at], self.cov[np.ix_(at, at)])

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    @property
    def corr(self) -> np.ndarray:
        """Correlations; 0 where a column is constant, clamped to [-1, 1]."""
        scale = np.outer(self.std, self.std)
        out = np.divide(self.cov, scale, out=np.zeros_like(self.cov), where=scale > 0)
        np.fill_diagonal(out, 1)
        return np.clip(out, -1, 1)

    def fit(self, target: str, drivers: Sequence[str]) -> tuple[float, np.ndarray, float]:
        """Intercept, coefficients and r2 of least squares; r2 is 0 where the system is singular."""
        y, x = self.fields.index(target), [self.fields.index(d) for d in drivers]
        if not x or not self.cov[y, y]:
            return float(self.mean[y]), np.zeros(len(x)), 0.0
        a, b = self.cov[np.ix_(x, x)], self.cov[x, y]
        scale = np.sqrt(np.maximum(np.diag(a), 0))
        if (scale == 0).any() or np.linalg.cond(a / np.outer(scale, scale)) > 1e12:
            return float(self.mean[y]), np.zeros(len(x)), 0.0
        coef = np.linalg.solve(a, b)
        return float(self.mean[y] - coef @ self.mean[x]), coef, float(coef @ b / self.cov[y, y])


def moments(df: DataFrame, fields: Sequence[str]) -> Moments:
    """n, means and population covariances over the complete rows, in one aggregation."""
    fields = list(dict.fromkeys(fields))
    rows = numbers(df, fields)
    pairs = [(i, j) for i in range(len(fields)) for j in range(i, len(fields))]
    c = [F.col(f"`{f}`") for f in fields]
    got = rows.agg(F.count("*"), *[F.avg(x) for x in c], *[F.covar_pop(c[i], c[j]) for i, j in pairs]).first()
    k = len(fields)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, got[1 + k :], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return Moments(fields, got[0], np.array([v or 0.0 for v in got[1 : 1 + k]]), cov)


def normal_cdf(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def chi2_tail(x: float, dof: float) -> float:
    """Wilson-Hilferty."""
    if x <= 0 or dof <= 0:
        return 1.0
    return 1 - normal_cdf(((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))


def f_tail(f: float, d1: float, d2: float) -> float:
    """Wilson-Hilferty for F."""
    if f <= 0 or d1 <= 0 or d2 <= 0:
        return 1.0
    a, b, r = 2 / (9 * d1), 2 / (9 * d2), f ** (1 / 3)
    return 1 - normal_cdf((r * (1 - b) - (1 - a)) / math.sqrt(b * r * r + a))


def edges_of(df: DataFrame, field: str, bins: int) -> list[float]:
    """Nearest-rank quantile edges of a column of doubles: positions rounded half to even."""
    n = df.filter(F.col(field).isNotNull()).count()
    if not n:
        return []
    want = [round((n - 1) * b / bins) for b in range(bins + 1)]
    ranked = running(df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("m")), field, "m", "upto")
    rows = ranked.filter(F.expr(" or ".join(f"(upto - m <= {w} and upto > {w})" for w in sorted(set(want))))).select(field, "m", "upto").collect()
    value = {w: next(r[0] for r in rows if r["upto"] - r["m"] <= w < r["upto"]) for w in set(want)}
    return [value[w] for w in want]


def binned(df: DataFrame, fields: Sequence[str], bins: int) -> DataFrame:
    """numbers(df, fields) with each field as its quantile bucket."""
    rows = numbers(df, fields)
    return rows.select(*[coerce.bucket(F.col(f"`{f}`"), edges_of(rows, f, bins)).alias(f) for f in fields])


def entropy(counts: np.ndarray) -> float:
    """Shannon entropy in nats."""
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())
