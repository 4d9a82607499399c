"""Dependence between columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import coerce
from fathom.operators.moments import binned, chi2_tail, entropy, f_tail, moments, numbers, numeric_fields
from fathom.operators.order import numbered, running
from fathom.operators.quality import hashed_sample


def average_rank(df: DataFrame, field: str, out: str) -> DataFrame:
    """df with the rank of each row, ties sharing their mean. Ranks come from running sums over the counts of different values."""
    counts = df.groupBy(F.col(f"`{field}`").alias("__v")).agg(F.count("*").alias("__m"))
    ranked = running(counts, "__v", "__m", "__upto").select("__v", (F.col("__upto") - (F.col("__m") - 1) / 2.0).alias(out))
    return df.join(ranked, df[field] == ranked["__v"]).drop("__v")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson; 0 where a column is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))), F.lit(0.0))


def rank_correlations(df: DataFrame, fields: Sequence[str] | None = None, method: str = "spearman") -> DataFrame:
    """field_a, field_b, n, pearson, spearman, nonlinear (they differ by more than 0.15)."""
    if method != "spearman":
        raise ValueError("only spearman")
    names = numeric_fields(df, fields, 15)
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            rows = average_rank(average_rank(numbers(df, [a, b]), a, "ra"), b, "rb")
            one = rows.agg(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.count("*").alias("n"), safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("pearson"), safe_corr(F.col("ra"), F.col("rb")).alias("spearman"))
            out = one if out is None else out.unionByName(one)
    return out.withColumn("nonlinear", F.abs(F.col("spearman") - F.col("pearson")) > 0.15)


def categories(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """Columns a and b as categories: quantile buckets of numeric columns, text of others."""
    numeric = [f for f in (a, b) if coerce.is_numeric(df.schema[f].dataType)]
    rows = df.select(*[coerce.number(df, f).alias(f) if f in numeric else coerce.text(df, f).alias(f) for f in (a, b)]).dropna()
    from fathom.operators.moments import edges_of

    return rows.select(*[(coerce.bucket(F.col(f"`{f}`"), edges_of(rows, f, bins)) if f in numeric else F.col(f"`{f}`")).alias(f) for f in (a, b)])


def contingency(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Cells a, b, observed, expected; empty cells stand as well, for they have expected counts. This is the table in full; chi_squared
    needs the observed cells only."""
    cells = categories(df, a, b, bins).groupBy(a, b).agg(F.count("*").alias("observed"))
    rows, columns = cells.groupBy(a).agg(F.sum("observed").alias("r")), cells.groupBy(b).agg(F.sum("observed").alias("c"))
    total = cells.agg(F.sum("observed").alias("t"))
    full = rows.crossJoin(F.broadcast(columns)).crossJoin(F.broadcast(total))  # margins: categories, not rows
    return full.join(cells, [a, b], "left").select(a, b, F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("r") * F.col("c") / F.col("t")).alias("expected"))


def chi_squared(df: DataFrame, a: str, b: str, bins: int = 10) -> dict[str, Any]:
    """From the cells that occur: an empty cell adds what it was expected to hold, and all of them together the rest of the rows."""
    cells = categories(df, a, b, bins).groupBy(a, b).agg(F.count("*").alias("observed")).cache()
    try:
        rows, columns = cells.groupBy(a).agg(F.sum("observed").alias("r")), cells.groupBy(b).agg(F.sum("observed").alias("c"))
        ka, kb, n = rows.count(), columns.count(), cells.agg(F.sum("observed")).first()[0] or 0
        expected = F.col("r") * F.col("c") / F.lit(float(max(n, 1)))
        seen = cells.join(rows, a).join(columns, b).agg(F.sum(F.pow(F.col("observed") - expected, 2) / expected), F.sum(expected)).first()
    finally:
        cells.unpersist()
    chi2 = seen[0] + max(0.0, n - seen[1]) if n and ka > 1 and kb > 1 else 0.0
    dof = max(ka - 1, 0) * max(kb - 1, 0)
    low = min(ka, kb) - 1
    return {"chi2": chi2, "n": n, "dof": dof, "p_value": chi2_tail(chi2, dof), "cramers_v": math.sqrt(chi2 / (n * low)) if n and low > 0 else 0.0}


def anova_groups(df: DataFrame, group: str, target: str) -> DataFrame:
    """Groups of two members or more: group, n, mean, std."""
    rows = df.select(coerce.text(df, group).alias("group"), coerce.number(df, target).alias("x")).dropna()
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).filter("n >= 2")


def anova(df: DataFrame, group: str, target: str) -> dict[str, Any]:
    one = anova_groups(df, group, target).agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("mean")), F.sum(F.col("n") * F.pow("mean", F.lit(2))), F.sum(F.col("n") * F.pow("std", F.lit(2)))).first()
    k, n = one[0], one[1] or 0
    if k < 2 or n <= k:
        return {"error": "too few groups"}
    between, within = one[3] - one[2] ** 2 / n, one[4]
    f = (between / (k - 1)) / (within / (n - k)) if within > 0 else float("inf")
    return {"k": k, "n": n, "f": f, "p_value": f_tail(f, k - 1, n - k) if within > 0 else 0.0, "eta_squared": between / (between + within) if between + within else 0.0}


def mutual_information(df: DataFrame, fields: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """field_a, field_b, mi (nats, between quantile buckets), nmi (divided by the smaller entropy)."""
    names = numeric_fields(df, fields, 15)
    rows = binned(df, names, bins)
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            cells = rows.groupBy(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).agg(F.count("*").alias("m"))
            w = lambda *c: F.sum("m").over(Window.partitionBy(*c))  # noqa: E731  over cells: bins * bins
            shares = cells.select("a", "b", "m", w("a").alias("ma"), w("b").alias("mb"), w(F.lit(1)).alias("t"))
            p, pa_, pb = F.col("m") / F.col("t"), F.col("ma") / F.col("t"), F.col("mb") / F.col("t")
            one = shares.agg(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.sum(p * F.log(p / (pa_ * pb))).alias("mi"), (-F.sum(p * F.log(pa_))).alias("ha"), (-F.sum(p * F.log(pb))).alias("hb"))
            out = one if out is None else out.unionByName(one)
    least = F.least("ha", "hb")
    return out.select("field_a", "field_b", "mi", F.coalesce(F.try_divide("mi", F.nullif(least, F.lit(0.0))), F.lit(0.0)).alias("nmi"))


def hsic(df: DataFrame, a: str, b: str, kernel: str = "gaussian", n_permutations: int = 100, sample: int = 500, seed: int = 42) -> dict[str, Any]:
    """Kernel independence with median bandwidths and a permutation p-value, on a bounded sample chosen by hash."""
    if kernel != "gaussian":
        raise ValueError("only the gaussian kernel")
    x = hashed_sample(df, [a, b], sample, seed)
    n = len(x)
    if n < 5:
        return {"error": "too few rows"}

    def gram(v: np.ndarray) -> np.ndarray:
        d = (v[:, None] - v[None, :]) ** 2
        middle = np.median(d[d > 0]) if (d > 0).any() else 1.0
        return np.exp(-d / middle)

    h = np.eye(n) - 1 / n
    k, q = h @ gram(x[:, 0]) @ h, gram(x[:, 1])
    stat = float((k * q).sum() / n**2)
    rng = np.random.default_rng(seed)
    more = sum((k * q[np.ix_(p, p)]).sum() / n**2 >= stat for p in (rng.permutation(n) for _ in range(n_permutations)))
    return {"n": n, "hsic": stat, "p_value": (more + 1) / (n_permutations + 1)}


def tail_dependence(df: DataFrame, a: str, b: str, thresholds: Sequence[float] = (0.01, 0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """threshold, lower and upper: shares of joint tails of rank/(n+1), divided by the threshold."""
    rows = average_rank(average_rank(numbers(df, [a, b]), a, "ra"), b, "rb")
    n = rows.count()
    u, v = F.col("ra") / (n + 1), F.col("rb") / (n + 1)
    counts = rows.agg(*[F.count_if((u <= t) & (v <= t)).alias(f"l{k}") for k, t in enumerate(thresholds)], *[F.count_if((u > 1 - t) & (v > 1 - t)).alias(f"u{k}") for k, t in enumerate(thresholds)])
    entries = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"l{k}") / (n * t)).alias("lower"), (F.col(f"u{k}") / (n * t)).alias("upper")) for k, t in enumerate(thresholds)])
    return counts.select(F.inline(entries))


def banded_kendall(df: DataFrame, a: str, b: str, order_by: Sequence[str], band: int = 500) -> DataFrame:
    """concordant, discordant and tau over pairs of rows less than `band` apart in the given order.

    Rows of one stretch of `band` meet those of their own and the next stretch only, so the work is rows * band, dealt by stretch.
    """
    order = [F.col(f"`{o}`").alias(f"__o{k}") for k, o in enumerate(order_by)]
    rows = numbered(df.select(coerce.number(df, a).alias("x"), coerce.number(df, b).alias("y"), *order), [f"__o{k}" for k in range(len(order))], "i").select("i", "x", "y").dropna()
    left = rows.withColumn("s", F.floor(F.col("i") / band))
    right = rows.select(F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.array(F.floor(F.col("i") / band), F.floor(F.col("i") / band) - 1)).alias("s"))
    sign = F.signum((F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y")))
    pairs = left.join(right, "s").filter((F.col("j") > F.col("i")) & (F.col("j") < F.col("i") + band))
    out = pairs.agg(F.count_if(sign > 0).alias("concordant"), F.count_if(sign < 0).alias("discordant"))
    return out.withColumn("tau", F.coalesce(F.try_divide(F.col("concordant") - F.col("discordant"), F.col("concordant") + F.col("discordant")), F.lit(0.0)))


def entropy_of(df: DataFrame, field: str) -> float:
    return entropy(np.array([r[0] for r in df.groupBy(field).count().select("count").collect()], float))


__all__ = ["anova", "anova_groups", "average_rank", "banded_kendall", "chi_squared", "contingency", "hsic", "moments", "mutual_information", "rank_correlations", "tail_dependence"]
