"""Grids as a whole, their spectra and views, each against plain NumPy on small shapes."""

import itertools

import numpy as np
import pytest

from fathom.operators import dependency, grid, paths
from fathom.runtime import stored

VALUES = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6]


@pytest.fixture(scope="module")
def line(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(VALUES)], "i int, v double")
    return fixed(grid.build(df, ["i"], ["v"], [True]))


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(a, b, float((a * 7 + b * 5) % 11)) for a in range(4) for b in range(4) if (a, b) != (3, 3)]
    return fixed(grid.build(spark.createDataFrame(rows, "a int, b int, v double"), ["a", "b"], ["v"]))


def fixed(g):
    g.vertices = stored(g.vertices)
    g._edges = stored(g.edges())
    return g


def path_modes(n, m):
    """The path's eigenvalues and vectors in closed form."""
    k = np.arange(m)
    vectors = np.cos(np.pi * np.outer(np.arange(n) + 0.5, k) / n)
    return 2 - 2 * np.cos(np.pi * k / n), vectors / np.linalg.norm(vectors, axis=0)


def test_spectra_of_a_path(line):
    values, vectors = path_modes(6, 5)
    assert np.allclose(paths.spectrum(line)["eigenvalues"], values)
    assert paths.spectrum(line)["label"] == "weakly_connected" and sum(paths.spectrum(line)["clusters"]) == 6
    x = np.array(VALUES)
    weight = vectors.T @ x
    h = paths.harmonics(line, "v", 5)
    assert np.allclose(h["energy"], weight**2) and np.allclose(h["share"], weight**2 / (weight**2).sum())
    assert {a["vid"]: a["residual"] for a in h["anomalies"]} == pytest.approx(dict(enumerate(x - vectors @ weight)))
    for d in paths.diffusion(line, time=0.5):
        want = np.sqrt((np.exp(-2 * values[1:] * 0.5) * (vectors[d["a"], 1:] - vectors[d["b"], 1:]) ** 2).sum())
        assert d["distance"] == pytest.approx(want)
    kernel = paths.heat_kernel(line, "v")
    kept = np.stack([vectors**2 @ np.exp(-values * t) for t in (0.1 / values[-1], 1 / values[-1], 1 / values[1], 10 / values[1])], axis=1)
    assert np.allclose([kernel["signatures"][v] for v in range(6)], kept)
    necks = {v: 1 - kept[v, 0] / np.mean([kept[u, 0] for u in (v - 1, v + 1) if 0 <= u < 6]) for v in range(6)}
    assert {b["vid"]: b["bottleneck"] for b in kernel["bottlenecks"]} == pytest.approx({v: x for v, x in necks.items() if x >= 1e-6})
    assert sum(map(len, kernel["clusters"].values())) == 6


def test_persistence_and_levels(line):
    found = {(p["birth"], p["death"]) for p in paths.persistence(line, "v")}
    assert found == {(1.5, 4.0), (2.6, 9.0)}  # minima 1, 1.5 and 2.6; the first never dies
    levels = paths.reeb(line, "v", 2)  # below and from the median 2.8: 3 | 1 | 4 | 1.5 | 9 | 2.6
    assert len(levels["nodes"]) == 6 and len(levels["arcs"]) == 5
    assert sorted(n["slab"] for n in levels["nodes"]) == [0, 0, 0, 1, 1, 1]


def test_vector_field(sheet):
    value = {(r.p0, r.p1): (r.vid, r.v) for r in sheet.vertices.collect()}
    want = {}
    for (a, b), (vid, x) in value.items():
        around = [value[c] for axis in (0, 1) for d in (-1, 1) if (c := (a + d * (axis == 0), b + d * (axis == 1))) in value]
        g = [y - x for axis in (0, 1) for _, y in sorted(n for n in around if (value_at(value, n[0])[0] != a) == (axis == 0))]
        turns = sum((p > 0) != (q > 0) for p, q in zip(g, g[1:] + g[:1]))
        want[vid] = (sum(g) / len(g), turns / len(g) if len(g) >= 3 else 0.0)
    got = {r.vid: r for r in grid.vector_field(sheet, "v").collect()}
    assert {v: r.divergence for v, r in got.items()} == pytest.approx({v: d for v, (d, _) in want.items()})
    assert {v: r.curl for v, r in got.items()} == pytest.approx({v: c for v, (_, c) in want.items()})
    d = np.array([x for x, _ in want.values()])
    for v, (x, c) in want.items():
        z = (x - d.mean()) / d.std()
        flow = "source" if z > 1.5 else "sink" if z < -1.5 else None
        assert got[v].kind == (("saddle" if flow else "vortex") if c > 0.6 else flow or "regular")


def value_at(value, vid):
    return next(c for c, (v, _) in value.items() if v == vid)


def squares(cells, sizes, wraps):
    """Sides of unit squares with their number of squares, one square after the other."""
    sides = {}
    for a, b in itertools.product(range(sizes[0]), range(sizes[1])):
        if (a + 1 >= sizes[0] and not wraps[0]) or (b + 1 >= sizes[1] and not wraps[1]):
            continue
        p, q = (a + 1) % sizes[0], (b + 1) % sizes[1]
        ring = [(a, b), (p, b), (p, q), (a, q)]
        if all(c in cells for c in ring):
            for k in range(4):
                side = frozenset((ring[k], ring[k - 1]))
                sides[side] = sides.get(side, 0) + 1
    return sides


@pytest.mark.parametrize("wraps,hole", [((False, False), None), ((True, True), None), ((True, False), (1, 1))])
def test_face_topology(spark, wraps, hole):
    cells = {(a, b) for a in range(4) for b in range(4)} - {hole}
    g = fixed(grid.build(spark.createDataFrame([(*c, 1.0) for c in sorted(cells)], "a int, b int, v double"), ["a", "b"], ["v"], wraps=wraps))
    sides = squares(cells, (4, 4), wraps)
    got = paths.face_topology(g)
    v, e, f = len(set().union(*sides)), len(sides), sum(sides.values()) // 4
    assert (got["face_vertices"], got["face_edges"], got["faces"], got["euler"]) == (v, e, f, v - e + f)
    assert got["boundary_edges"] == sum(n == 1 for n in sides.values()) and got["nonmanifold_edges"] == 0
    if not hole:
        assert got["boundary_loops"] == (0 if all(wraps) else 1)
    assert got["torus"] == (wraps == (True, True))
    if not hole:
        assert got["confidence"] == pytest.approx(1.0) and got["genus"] == (1 if all(wraps) else 0)


def test_surface_and_views(sheet):
    s = paths.surface(sheet)
    assert s["name"] == "bounded_patch" and s["coverage"]["vertices"] == 15 and s["betti"]["b0"] == 1
    assert s["product"] == {"name": "bounded_patch", "genus": 0, "orientable": True, "euler": 2}
    assert [paths.product_topology(k)["name"] for k in ("IC", "CC", "IX", "CX", "XX")] == ["cylinder", "torus", "mobius_band", "klein_bottle", "klein_bottle"]
    at = {r.vid: (r.p0, r.p1, r.v) for r in sheet.vertices.collect()}
    (ring,) = paths.orbit_views(sheet, 0, [2], "v", mode="ring")
    values = {v: x for v, (a, b, x) in at.items() if a + b == 2}
    assert ring["zone"]["points"] == 3 and ring["zone"]["mean_value"] == pytest.approx(np.mean(list(values.values())))
    assert [h["vid"] for h in ring["highlights"]] == sorted(values, key=lambda v: (-abs(values[v]), v))
    assert [x["points"] for x in ring["shells"]] == [1, 2, 3]
    small, large = paths.orbit_views(sheet, 0, [3, 1, 3])
    assert (small["radius"], small["zone"]["points"], large["zone"]["points"]) == (1, 3, 10)


def test_numbered_in_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7, k // 7, float(k)) for k in range(50)], "a int, b int, v double")
    once = grid.build(rows, ["a", "b"], ["v"]).vertices.orderBy("vid").collect()
    monkeypatch.setattr(grid, "ONE_TASK", 10)
    ranges = grid.build(rows, ["a", "b"], ["v"]).vertices
    assert ranges.schema["vid"].dataType.simpleString() == "int"
    assert ranges.orderBy("vid").collect() == once


def test_chi_squared_from_observed_cells(spark):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 6, 300), r.integers(0, 9, 300)
    a[:60], b[:60] = 6, 9  # and many empty cells
    table = np.zeros((7, 10))
    np.add.at(table, (a, b), 1)
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / 300
    got = dependency.chi_squared(spark.createDataFrame([(f"a{x}", f"b{y}") for x, y in zip(a, b)], "a string, b string"), "a", "b")
    assert got["chi2"] == pytest.approx(((table - expected) ** 2 / expected).sum()) and got["dof"] == 54 and got["n"] == 300
    assert dependency.chi_squared(spark.createDataFrame([], "a string, b string"), "a", "b")["chi2"] == 0
