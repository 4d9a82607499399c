"""Iterative work on a grid: components, rings, paths, basins, traces, and spectra of its Laplacian.

Rounds of joins while the grid is large; what a grid of at most ON_DRIVER vertices needs is finished on the driver, as are the
dense spectra, which are refused above DENSE vertices.
"""

from __future__ import annotations

import functools
import heapq
from collections import defaultdict
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.grid import Grid, coverage, critical_points, curvature, highest_curvature, lowest_density, most_negative_ricci, with_neighbours
from fathom.runtime import stored

ON_DRIVER, DENSE = 20_000, 2_000


def components(grid: Grid) -> DataFrame:
    """vid, component (smallest vid)."""
    return spread(grid.vertices.select("vid"), grid.edges())


def spread(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vid, component: labels spread along edges (both directions), with a jump to the label's label each round, until nothing changes."""
    label = vertices.select("vid", F.col("vid").alias("component"))
    edges = stored(edges.select("src", "dst").distinct())
    while True:
        near = edges.join(label.withColumnRenamed("vid", "dst"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        step = label.join(near, label["vid"] == near["src"], "left").select("vid", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.alias("a").join(step.select(F.col("vid").alias("component"), F.col("component").alias("top")), "component").select("vid", F.least("component", "top").alias("component"))
        rows = stored(jump)
        settled = rows.join(label.withColumnRenamed("component", "old"), "vid").filter("component <> old").isEmpty()
        label = rows
        if settled:
            return label


def betti(grid: Grid) -> dict[str, int]:
    """b0 components, b1 independent cycles."""
    b0 = components(grid).select("component").distinct().count()
    e = grid.edges().filter("src < dst").select("src", "dst").distinct().count()
    return {"b0": b0, "b1": max(0, e - grid.vertices.count() + b0)}


def orbit(grid: Grid, vid: int, radius: int) -> DataFrame:
    """vid, distance for all vertices up to `radius` hops away: the frontier is joined with the edges, round by round."""
    edges = stored(grid.edges().select("src", "dst").distinct())
    reached = edges.sparkSession.createDataFrame([(vid, 0)], "vid int, distance int")
    front = reached
    for d in range(1, radius + 1):
        new = edges.join(front.select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid")).distinct().join(reached, "vid", "left_anti").withColumn("distance", F.lit(d))
        front = stored(new)
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def local(grid: Grid, name: str | None = None) -> tuple[dict[int, float], dict[int, list[int]]]:
    """A grid of bounded size on the driver: values and neighbours."""
    n = grid.vertices.count()
    if n > ON_DRIVER:
        raise ValueError(f"{n} vertices; at most {ON_DRIVER}")
    rows = grid.vertices.select("vid", (F.col(f"`{name}`") if name else F.lit(0.0)).alias("x")).collect()
    near: dict[int, list[int]] = defaultdict(list)
    for r in grid.edges().select("src", "dst").distinct().orderBy("src", "dst").collect():
        near[r["src"]].append(r["dst"])
    return {r["vid"]: r["x"] if r["x"] is not None else 0.0 for r in rows}, near


def geodesic(grid: Grid, start: int, end: int, name: str | None = None) -> dict[str, Any]:
    """The cheapest way: one a hop, or the change of the field and a little."""
    value, near = local(grid, name)
    best, came, queue = {start: 0.0}, {}, [(0.0, start)]
    while queue:
        cost, v = heapq.heappop(queue)
        if v == end:
            break
        if cost > best[v]:
            continue
        for u in near[v]:
            c = cost + (abs(value[u] - value[v]) + 1e-6 if name else 1.0)
            if c < best.get(u, float("inf")):
                best[u], came[u] = c, v
                heapq.heappush(queue, (c, u))
    if end not in best:
        return {"reachable": False}
    path = [end]
    while path[-1] != start:
        path.append(came[path[-1]])
    path.reverse()
    return {"reachable": True, "cost": best[end], "path": path, "deltas": [value[b] - value[a] for a, b in zip(path, path[1:])]}


def next_hops(grid: Grid, name: str, descend: bool = True) -> DataFrame:
    """vid, next: the lowest (or highest) neighbour, or the vertex itself if none is lower (higher)."""
    e = with_neighbours(grid, [name])
    sign = 1 if descend else -1
    best = e.groupBy(F.col("src").alias("vid")).agg(F.min(F.struct((sign * F.col(f"`{name}__n`")).alias("x"), F.col("dst"))).alias("b"), F.first(sign * F.col(f"`{name}`")).alias("own"))
    moves = best.select("vid", F.when(F.col("b.x") < F.col("own"), F.col("b.dst")).otherwise(F.col("vid")).alias("next"))
    return grid.vertices.select("vid").join(moves, "vid", "left").select("vid", F.coalesce("next", "vid").alias("next"))


def basins(grid: Grid, name: str, descend: bool = True) -> DataFrame:
    """vid, extremum: pointer doubling over the next hops until all have arrived."""
    hop = stored(next_hops(grid, name, descend))
    while True:
        step = hop.join(hop.select(F.col("vid").alias("next"), F.col("next").alias("after")), "next")
        step = stored(step.select("vid", F.col("after").alias("next"), (F.col("after") != F.col("next")).alias("moved")))
        hop = step.drop("moved")
        if step.filter("moved").isEmpty():
            return hop.withColumnRenamed("next", "extremum")


def trace(grid: Grid, start: int, name: str, ascend: bool = True, max_steps: int = 25) -> list[int]:
    """A greedy ridge (or valley) without going back."""
    value, near = local(grid, name)
    path, seen = [start], {start}
    sign = 1 if ascend else -1
    for _ in range(max_steps):
        options = [u for u in near[path[-1]] if u not in seen]
        if not options:
            break
        best = max(options, key=lambda u: (sign * value[u], -u))
        if sign * value[best] <= sign * value[path[-1]]:
            break
        path.append(best)
        seen.add(best)
    return path


def persistence(grid: Grid, name: str, most: int = 20) -> list[dict[str, float]]:
    """Births and deaths of sublevel components: the younger one dies."""
    value, near = local(grid, name)
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for v in sorted(value, key=lambda v: (value[v], v)):
        parent[v] = v
        for u in near[v]:
            if u in parent:
                a, b = find(u), find(v)
                if a != b:
                    old, young = sorted((a, b), key=lambda r: (value[r], r))
                    parent[young] = old
                    if value[v] > value[young]:
                        out.append({"birth": value[young], "death": value[v], "persistence": value[v] - value[young]})
    return sorted(out, key=lambda p: -p["persistence"])[:most]


def laplacian(grid: Grid) -> tuple[list[int], np.ndarray]:
    value, near = local(grid)
    if len(value) > DENSE:
        raise ValueError(f"{len(value)} vertices; at most {DENSE}")
    order = sorted(value)
    at = {v: i for i, v in enumerate(order)}
    a = np.zeros((len(order), len(order)))
    for v, us in near.items():
        for u in us:
            a[at[v], at[u]] = 1
    return order, np.diag(a.sum(axis=1)) - a


def lowest_modes(lap: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n smallest eigenvalues with their vectors, one fewer than vertices at most."""
    values, vectors = np.linalg.eigh(lap)
    n = max(1, min(n, len(lap) - 1))
    return values[:n], vectors[:, :n]


def heat_kernel(grid: Grid, name: str | None = None, n_eigen: int = 20, top_k: int = 10) -> dict[str, Any]:
    """Heat kernel signatures at four times between the fastest and the slowest mode's; bottlenecks, vertices that keep less heat than
    their neighbours at the shortest time; and vertices of low, middle and high signature over all times."""
    order, lap = laplacian(grid)
    values, vectors = lowest_modes(lap, n_eigen)
    fast, slow = max(float(values[-1]), 1e-6), max(float(values[1]) if len(values) > 1 else 1e-6, 1e-6)
    times = [0.1 / fast, 1 / fast, 1 / slow, 10 / slow]
    kept = np.stack([vectors**2 @ np.exp(-values * t) for t in times], axis=1)
    link = lap < 0
    degree = link.sum(axis=1)
    around = np.where(degree > 0, link @ kept[:, 0] / np.maximum(degree, 1), 0.0)
    neck = np.where(around > 1e-12, np.maximum(0, 1 - kept[:, 0] / np.maximum(around, 1e-12)), 0.0)
    spread_of = kept.std(axis=0)
    score = ((kept - kept.mean(axis=0)) / np.where(spread_of < 1e-12, 1, spread_of)).mean(axis=1)
    level = np.where(score < -0.5, "low", np.where(score > 0.5, "high", "mid"))
    about = {r["vid"]: r for r in grid.vertices.select("vid", "density", (F.col(f"`{name}`") if name else F.lit(None)).alias("value")).collect()}  # DENSE at most
    necks = [i for i in np.argsort(-neck, kind="stable")[:top_k] if neck[i] >= 1e-6]
    return {
        "vertices": len(order),
        "modes": len(values),
        "times": times,
        "signatures": {v: kept[i].tolist() for i, v in enumerate(order)},
        "bottlenecks": [{"vid": order[i], "bottleneck": float(neck[i]), "density": about[order[i]]["density"], "value": about[order[i]]["value"]} for i in necks],
        "clusters": {k: [order[i] for i in np.flatnonzero(level == k)] for k in ("low", "mid", "high") if (level == k).any()},
        "spectral_gap": float(values[1]) if len(values) > 1 else 0.0,
    }


CONNECTED = ((1e-6, "disconnected"), (0.5, "weakly_connected"), (2.0, "moderately_connected"), (float("inf"), "strongly_connected"))


def spectrum(grid: Grid, n_eigen: int = 15, n_clusters: int | None = None) -> dict[str, Any]:
    """Eigenvalues, connectivity, halves of the Fiedler vector, and clusters around the vertices that are furthest apart on the unit
    sphere of the first modes; their number is where the widest gap lies, between 2 and 8."""
    order, lap = laplacian(grid)
    values, vectors = lowest_modes(lap, n_eigen)
    second = float(values[1]) if len(values) > 1 else 0.0
    wide = range(1, min(len(values) - 1, 10))
    k = n_clusters or min(8, max(2, max(((values[i + 1] - values[i], i + 1) for i in wide), default=(0, 2))[1]))
    sizes: list[int] = []
    if 2 <= k <= len(values):
        x = vectors[:, 1:k]
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(length < 1e-12, 1, length)
        seeds = [0]
        while len(seeds) < k:
            seeds.append(int(np.argmax(np.min([np.linalg.norm(x - x[s], axis=1) for s in seeds], axis=0))))
        sizes = np.bincount(np.argmin([np.linalg.norm(x - x[s], axis=1) for s in seeds], axis=0), minlength=k).tolist()
    fiedler = vectors[:, 1] if len(values) > 1 else vectors[:, 0]
    label = next(name for bound, name in CONNECTED if second < bound)
    return {"eigenvalues": values.tolist(), "connectivity": second, "label": label, "fiedler_sizes": [int((fiedler >= 0).sum()), int((fiedler < 0).sum())], "k": k, "clusters": sizes}


def harmonics(grid: Grid, name: str, n_modes: int = 10, top_k: int = 10) -> dict[str, Any]:
    """The field on the first modes: their energies and shares, how many of them hold 90 % of it, the share of the field's whole
    energy they hold (smoothness), and the vertices they explain least."""
    order, lap = laplacian(grid)
    value, _ = local(grid, name)
    x = np.array([value[v] for v in order])
    values, vectors = lowest_modes(lap, n_modes)
    weight = vectors.T @ x
    energy = weight**2
    share = energy / energy.sum() if energy.sum() >= 1e-12 else energy
    smooth = vectors @ weight
    rest = x - smooth
    enough = int(np.argmax(np.cumsum(share) >= 0.9 - 1e-12)) + 1 if share.sum() >= 0.9 else len(share)
    odd = [i for i in np.argsort(-abs(rest), kind="stable")[:top_k] if abs(rest[i]) >= 1e-9]
    return {
        "eigenvalues": values.tolist(),
        "energy": energy.tolist(),
        "share": share.tolist(),
        "modes_for_90": enough,
        "label": "smooth_dominated" if enough <= 3 else "moderately_complex" if enough <= 6 else "highly_structured",
        "smoothness": float(energy.sum() / max((x**2).sum(), 1e-300)),
        "anomalies": [{"vid": order[i], "observed": float(x[i]), "smooth": float(smooth[i]), "residual": float(rest[i])} for i in odd],
    }


def diffusion(grid: Grid, landmarks: Sequence[int] | None = None, time: float = 1.0, n_landmarks: int = 8, n_eigen: int = 15) -> list[dict[str, Any]]:
    """Pairwise diffusion distances of landmarks over the first modes, those of the components left out; close and far ones are named."""
    order, lap = laplacian(grid)
    values, vectors = lowest_modes(lap, n_eigen)
    chosen = [order.index(v) for v in landmarks] if landmarks else list(range(0, len(order), max(1, len(order) // max(1, min(n_landmarks, len(order))))))[:n_landmarks]
    x = vectors[chosen] * np.where(values < 1e-9, 0.0, np.exp(-values * time))
    pairs = [(i, j, float(np.sqrt(((x[i] - x[j]) ** 2).sum()))) for i in range(len(chosen)) for j in range(i + 1, len(chosen))]
    mean = np.mean([d for *_, d in pairs]) if pairs else 0.0
    return [{"a": order[chosen[i]], "b": order[chosen[j]], "distance": d, "kind": "close" if d <= 0.3 * mean else "far" if d >= 2 * mean else "middle"} for i, j, d in pairs]


def reeb(grid: Grid, name: str, n_levels: int = 20) -> dict[str, Any]:
    """Components within quantile slabs of the field, linked where an edge joins neighbouring slabs."""
    value, near = local(grid, name)
    cuts = np.quantile(list(value.values()), np.linspace(0, 1, n_levels + 1))
    slab = {v: int(np.clip(np.searchsorted(cuts, x, "right") - 1, 0, n_levels - 1)) for v, x in value.items()}
    node: dict[int, int] = {}
    sizes: list[tuple[int, int]] = []
    for v in sorted(value):
        if v in node:
            continue
        node[v], stack, n = len(sizes), [v], 0
        while stack:
            w = stack.pop()
            n += 1
            for u in near[w]:
                if u not in node and slab[u] == slab[w]:
                    node[u] = len(sizes)
                    stack.append(u)
        sizes.append((slab[v], n))
    arcs = sorted({(node[v], node[u]) for v in near for u in near[v] if slab[v] < slab[u]})
    down, up = defaultdict(int), defaultdict(int)
    for a, b in arcs:
        up[a] += 1
        down[b] += 1
    kinds = ["birth" if not down[k] else "merge" if down[k] > 1 else "split" if up[k] > 1 else "regular" for k in range(len(sizes))]
    return {"nodes": [{"slab": s, "size": n, "kind": kind} for (s, n), kind in zip(sizes, kinds, strict=True)], "arcs": arcs}


def multiscale(grid: Grid, vid: int, radii: Sequence[int]) -> DataFrame:
    """radius, vertices within it, for each different radius: one search to the largest."""
    wanted = sorted({int(r) for r in radii if int(r) >= 1})
    found = orbit(grid, vid, wanted[-1])
    return found.select(F.explode(F.array(*[F.lit(r) for r in wanted])).alias("radius"), "distance").filter("distance <= radius").groupBy("radius").agg(F.count("*").alias("vertices"))


def figures(points: DataFrame, *by: str) -> DataFrame:
    """Of points with value, curvature and density: how many, the means, and the range of the value."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.avg("curvature").alias("mean_curvature"), F.avg("density").alias("mean_density"), F.avg("value").alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def surroundings(grid: Grid, vid: int, radius: int, name: str | None = None) -> DataFrame:
    """vid, distance, value, curvature, density of all vertices up to `radius` hops away."""
    value = (F.col(f"`{name}`") if name else F.lit(None).cast("double")).alias("value")
    about = grid.vertices.select("vid", "density", value).join(curvature(grid), "vid")
    return about.join(orbit(grid, vid, radius), "vid").select("vid", "distance", "value", "curvature", "density")


def shells(grid: Grid, vid: int, radius: int, name: str | None = None) -> DataFrame:
    """distance and the figures of the vertices at it."""
    return figures(surroundings(grid, vid, radius, name), "distance")


def orbit_views(grid: Grid, vid: int, radii: Sequence[int], name: str | None = None, resolution: int = 16, mode: str = "disk") -> list[dict[str, Any]]:
    """For each different radius the figures of the centre, the zone (the ring at the radius, or the disk) and its shells, and the
    vertices of the zone with the largest value (curvature where no field is named); one search to the largest radius."""
    wanted = sorted({int(r) for r in radii if int(r) >= 1})
    if not wanted or mode not in ("ring", "disk"):
        raise ValueError("radii from 1, and ring or disk")
    found = stored(surroundings(grid, vid, wanted[-1], name))
    rows = [r.asDict() for r in figures(found, "distance").orderBy("distance").collect()]  # a row for each distance
    strength = F.abs("value" if name else "curvature")
    out = []
    for radius in wanted:
        zone = found.filter(F.col("distance") == radius if mode == "ring" else F.col("distance") <= radius)
        best = zone.filter(strength.isNotNull()).orderBy(strength.desc(), "vid").limit(max(3, min(resolution, 12))).drop("distance")
        whole = figures(zone).first()
        out.append({"center": vid, "radius": radius, "mode": mode, "center_summary": rows[0], "zone": whole.asDict() if whole else {"points": 0}, "shells": [r for r in rows if r["distance"] <= radius], "highlights": [r.asDict() for r in best.collect()]})
    return out


def product_topology(kinds: Sequence[str]) -> dict[str, Any]:
    """Of the axes: I (interval), C (circle), X (circle that reverses)."""
    c, x, i = (list(kinds).count(k) for k in "CXI")
    if x == 0 and c:
        return {"name": "cylinder", "genus": 0, "orientable": True, "euler": 0} if c == 1 else {"name": "torus", "genus": 1, "orientable": True, "euler": 0}
    if x and (c or x > 1 and not i):
        return {"name": "klein_bottle", "genus": 2, "orientable": False, "euler": 0}
    if x and i:
        return {"name": "mobius_band", "genus": 1, "orientable": False, "euler": 0}
    return {"name": "bounded_patch", "genus": 0, "orientable": True, "euler": 2}


def face_edges(grid: Grid) -> DataFrame:
    """src < dst, faces: the sides of the unit squares whose four corners occur, and how many squares meet in each. Squares close
    around an axis that wraps."""
    v = grid.vertices.select("vid", "p0", "p1")
    up = [(F.col(f"p{k}") + 1) % grid.sizes[k] if grid.wraps[k] else F.col(f"p{k}") + 1 for k in (0, 1)]
    corner = lambda name, p0, p1: v.select(F.col("vid").alias(name), F.col("p0").alias(p0), F.col("p1").alias(p1))
    squares = v.select(F.col("vid").alias("a"), "p0", "p1", up[0].alias("q0"), up[1].alias("q1"))
    squares = squares.join(corner("b", "q0", "p1"), ["q0", "p1"]).join(corner("c", "q0", "q1"), ["q0", "q1"]).join(corner("d", "p0", "q1"), ["p0", "q1"])
    side = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
    return squares.select(F.inline(F.array(side("a", "b"), side("b", "c"), side("c", "d"), side("d", "a")))).groupBy("src", "dst").agg(F.count("*").alias("faces"))


def face_topology(grid: Grid) -> dict[str, Any] | None:
    """The complex of unit squares on two axes of two values or more: its counts, Euler characteristic, boundary, genus and how far
    the squares cover the grid; None for other grids."""
    if len(grid.axes) != 2 or min(grid.sizes) < 2:
        return None
    (m, n), (wrap0, wrap1) = grid.sizes, grid.wraps
    possible = (m if wrap0 else m - 1) * (n if wrap1 else n - 1)
    sides = stored(face_edges(grid))
    e, f, rim, many = sides.agg(F.count("*"), F.coalesce(F.sum("faces"), F.lit(0)) / 4, F.count_if(F.col("faces") == 1), F.count_if(F.col("faces") > 2)).first()
    ends = lambda s: s.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    v, f = ends(sides).count(), int(f)
    loops = 0
    if rim:
        border = sides.filter("faces = 1").select("src", "dst")
        loops = spread(ends(border), border.unionByName(border.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).select("component").distinct().count()
    occupied = grid.vertices.count() / (m * n)
    euler = v - e + f
    genus = (2 - loops - euler) / 2
    sure = min(1.0, 0.55 * f / possible + 0.45 * occupied) * (0.5 if many else 1.0) if f else 0.0
    return {
        "mode": "graph_heuristic" if not f else "nonmanifold_complex" if many else "validated_2d_faces",
        "faces": f, "possible_faces": possible, "face_coverage": f / possible, "occupancy": occupied, "face_vertices": v, "face_edges": e,
        "boundary_edges": rim, "boundary_loops": loops, "euler": euler if f else None, "genus": genus if f else None, "crosscaps": 2 - loops - euler if f else None,
        "confidence": sure, "torus": bool(f) and not rim and euler == 0 and genus == 1, "manifold": bool(f) and not many, "nonmanifold_edges": many,
    }


def surface(grid: Grid, top: int = 5) -> dict[str, Any]:
    """What a grid is as a whole: axes and how they close, counts, topology and its name, and its outstanding vertices."""
    kinds = ["X" if w and x else "C" if w else "I" for w, x in zip(grid.wraps, grid.flips or [False] * len(grid.axes), strict=True)]
    product, faces = product_topology(kinds), face_topology(grid)
    name = "graph_only" if not faces or not faces["faces"] else product["name"] if faces["manifold"] else "nonmanifold_complex"
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  `top` rows at most
    named = [critical_points(grid, f).select(F.lit(f).alias("field"), "kind") for f in grid.fields[:top]]
    kind_counts = functools.reduce(DataFrame.unionByName, named).groupBy("field", "kind").agg(F.count("*").alias("vertices"))
    return {
        "name": name,
        "axes": [{"column": a, "size": n, "ordered": o, "wraps": k != "I", "reversing": k == "X"} for a, n, o, k in zip(grid.axes, grid.sizes, grid.ordered, kinds, strict=True)],
        "fields": grid.fields,
        "product": product,
        "handles": kinds.count("C"),
        "crosscaps": kinds.count("X"),
        "betti": betti(grid),
        "coverage": coverage(grid).first().asDict(),
        "faces": faces,
        "critical_points": rows(kind_counts),
        "highest_curvature": rows(highest_curvature(grid, top)),
        "lowest_density": rows(lowest_density(grid, top)),
        "most_negative_ricci": rows(most_negative_ricci(grid, top)),
    }
