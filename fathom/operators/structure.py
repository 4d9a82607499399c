"""Clusters, spectra, sources, graphs and topology of rows. What has no form in aggregates works on a bounded sample by hash."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.moments import moments, numbers, numeric_fields
from fathom.operators.quality import hashed_sample


def z_scores(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    m = moments(df, fields)
    return numbers(df, fields).select(*[((F.col(f"`{f}`") - float(mu)) / (float(s) or 1.0)).alias(f) for f, mu, s in zip(fields, m.mean, m.std, strict=True)])


def cluster(df: DataFrame, fields: Sequence[str] | None = None, k: int | None = None, max_k: int = 8, seed: int = 42, sample: int = 500) -> dict[str, Any]:
    """k-means on z-scores over all rows; silhouette on a sample chooses k if it is not given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    names = numeric_fields(df, fields, 15)
    z = VectorAssembler(inputCols=names, outputCol="v").transform(z_scores(df, names)).select("v").cache()
    points = hashed_sample(z_scores(df, names), names, sample, seed)
    best: dict[str, Any] | None = None
    for n in [k] if k else range(2, max_k + 1):
        model = KMeans(k=n, seed=seed, featuresCol="v", maxIter=50).fit(z)
        centers = np.array(model.clusterCenters())
        score = silhouette(points, ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1))
        if best is None or score > best["silhouette"]:
            best = {"k": n, "silhouette": score, "sizes": list(model.summary.clusterSizes), "centers": centers.tolist(), "fields": names}
    z.unpersist()
    return best


def silhouette(points: np.ndarray, label: np.ndarray) -> float:
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(label):
        same = (label == own) & (np.arange(len(label)) != i)
        others = [d[i, label == c].mean() for c in set(label.tolist()) if c != own]
        if same.any() and others:
            a, b = d[i, same].mean(), min(others)
            out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if out else 0.0


def spectral(df: DataFrame, fields: Sequence[str] | None = None, n_neighbors: int = 10, n_components: int = 5, sample: int = 500, seed: int = 42) -> dict[str, Any]:
    """Eigenvalues of the normalised Laplacian of the nearest-neighbour graph of a sample, the gap and the halves of its Fiedler vector."""
    names = numeric_fields(df, fields, 15)
    x = hashed_sample(z_scores(df, names), names, sample, seed)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : n_neighbors + 1]
    a = np.zeros_like(d)
    a[np.arange(len(x))[:, None], near] = 1
    a = np.maximum(a, a.T)
    root = 1 / np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    values, vectors = np.linalg.eigh(np.eye(len(x)) - root[:, None] * a * root[None])
    gaps = np.diff(values[: n_components + 1])
    return {"n": len(x), "eigenvalues": values[:n_components].tolist(), "gap_at": int(np.argmax(gaps)) + 1, "fiedler_sizes": [int((vectors[:, 1] >= 0).sum()), int((vectors[:, 1] < 0).sum())]}


def sources(df: DataFrame, fields: Sequence[str] | None = None, n_sources: int | None = None, seed: int = 42, rounds: int = 200) -> dict[str, Any]:
    """Independent components (fixed-point iteration with tanh, one after the other) of all rows, whitened; each step is one
    aggregation, and the driver gets a few numbers from it."""
    names = numeric_fields(df, fields, 15)
    m = moments(df, names)
    scale = np.where(m.std > 0, m.std, 1)
    values, vectors = np.linalg.eigh(m.cov / np.outer(scale, scale))
    keep = values > 1e-10
    white = vectors[:, keep] / np.sqrt(values[keep])
    x = z_scores(df, names).cache()
    k = white.shape[1]

    def along(w: np.ndarray) -> Column:
        """The projection of a row on w, given in whitened coordinates."""
        return sum((F.col(f"`{f}`") * float(c) for f, c in zip(names, white @ w, strict=True)), F.lit(0.0))

    rng = np.random.default_rng(seed)
    found: list[np.ndarray] = []
    out = []
    try:
        for _ in range(min(n_sources or k, k)):
            w = rng.normal(size=k)
            w /= np.linalg.norm(w)
            for _ in range(rounds):
                g = F.tanh(F.col("s"))
                got = x.withColumn("s", along(w)).agg(F.avg(1 - g * g), *[F.avg(F.col(f"`{f}`") * g) for f in names]).first()
                new = np.array(got[1:], float) @ white - float(got[0]) * w
                for f in found:
                    new -= (new @ f) * f
                new /= max(np.linalg.norm(new), 1e-12)
                done = abs(abs(new @ w) - 1) < 1e-8
                w = new
                if done:
                    break
            found.append(w)
            kurtosis = x.select(F.kurtosis(along(w))).first()[0]
            out.append({"kurtosis": float(kurtosis or 0.0), "weights": sorted(zip(names, (white @ w).tolist(), strict=True), key=lambda t: -abs(t[1]))[:5]})
    finally:
        x.unpersist()
    return {"n": m.n, "sources": out}


def graphical_model(df: DataFrame, fields: Sequence[str] | None = None, method: str = "threshold", alpha: float = 0.01) -> dict[str, Any]:
    """Partial correlations from the inverse of (covariance + alpha I); edges above 2/sqrt(n)."""
    if method != "threshold":
        raise ValueError("only threshold")
    names = numeric_fields(df, fields, 20)
    m = moments(df, names)
    p = np.linalg.inv(m.cov + alpha * np.eye(len(names)))
    d = np.sqrt(np.diag(p))
    part = -p / np.outer(d, d)
    cut = 2 / np.sqrt(max(m.n, 1))
    edges = [{"a": names[i], "b": names[j], "partial": float(part[i, j])} for i in range(len(names)) for j in range(i + 1, len(names)) if abs(part[i, j]) > cut]
    return {"n": m.n, "edges": sorted(edges, key=lambda e: -abs(e["partial"]))}


def topology(df: DataFrame, fields: Sequence[str] | None = None, max_dimension: int = 1, max_points: int = 200, seed: int = 42) -> dict[str, Any]:
    """Components and cycles of the neighbourhood graph of a sample as its radius grows; deaths of components are the edges of
    the minimum spanning tree."""
    if max_dimension != 1:
        raise ValueError("components and graph cycles only")
    names = numeric_fields(df, fields, 10)
    x = hashed_sample(z_scores(df, names), names, max_points, seed)
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    parent = list(range(n))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    deaths = []
    for e in order:
        a, b = find(i[e]), find(j[e])
        if a != b:
            parent[a] = b
            deaths.append(float(d[i[e], j[e]]))
    trace = []
    for r in np.linspace(0, d.max() if n else 0, 50):
        edges, b0 = int((d[i, j] <= r).sum()), n - int(sum(t <= r for t in deaths))
        trace.append({"radius": float(r), "b0": b0, "b1": max(0, edges - n + b0)})
    return {"n": n, "deaths": deaths, "trace": trace}
