"""A table as a graph on a grid: vertices are the combinations of axis values that occur, with averaged fields; edges join
neighbours along ordered axes, and all values of a categorical axis. Frames in, frames out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import coerce
from fathom.operators.order import numbered
from fathom.runtime import stored

#: Cells of the full grid up to which its vertices are numbered in one task.
ONE_TASK = 100_000
MAX_AXES, MAX_FIELDS, MIN_ROWS, MIN_VERTICES = 6, 20, 10, 4


@dataclass
class Grid:
    axes: list[str]
    ordered: list[bool]
    fields: list[str]
    vertices: DataFrame  # vid, a0.., p0.. (place on the axis), fields, density
    sizes: list[int]
    wraps: list[bool] = field(default_factory=list)
    flips: list[bool] = field(default_factory=list)  # of the axes that wrap: those that reverse
    _edges: DataFrame | None = None

    def edges(self) -> DataFrame:
        """src, dst, axis: every edge in both directions, made once."""
        if self._edges is None:
            self._edges = edges(self)
        return self._edges


def identify_axes(df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns of text, date or boolean with 2 ... 6 sqrt(n) values become axes, with one numeric column at most that scores
    best by coverage, repetition and entropy and leaves the grid dense; other numeric columns become fields."""
    discrete = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.DateType | T.BooleanType)]
    numeric = [f.name for f in df.schema if coerce.is_numeric(f.dataType)]
    one = df.agg(F.count("*").alias("__n"), *[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in discrete + numeric], *[F.count(F.col(f"`{c}`")).alias(f"{c}__c") for c in numeric]).first()
    n = one["__n"]
    most = max(2, int(6 * math.sqrt(n)))
    axes = [c for c in discrete if 2 <= one[c] <= most]
    product = math.prod(one[c] for c in axes)
    best, best_score = None, 0.0
    for c in numeric:
        u = one[c]
        if 2 <= u <= most and n / max(product * u, 1) >= 0.3:
            counts = [r["count"] for r in df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`")).count().collect()]  # `most` rows at most
            total = sum(counts)
            h = -sum(k / total * math.log(k / total) for k in counts) / math.log(u)
            score = one[f"{c}__c"] / n * math.log1p(n / u) * (0.5 + 0.5 * h) * math.log1p(u)
            if score > best_score:
                best, best_score = c, score
    if best:
        axes.append(best)
    fields = [c for c in numeric if c not in axes]
    if not fields:
        back = [c for c in axes if c in numeric]
        if back:
            largest = max(back, key=lambda c: one[c])
            axes.remove(largest)
            fields = [largest]
    return sorted(axes, key=lambda c: one[c])[:MAX_AXES], fields[:MAX_FIELDS]


def build(df: DataFrame, axes: Sequence[str], fields: Sequence[str], ordered: Sequence[bool] | None = None, wraps: Sequence[bool] | None = None) -> Grid:
    """The grid on these axes. Ordered by default: numeric and date axes. Vertex ids follow the text of the axis values."""
    ordered = list(ordered) if ordered is not None else [coerce.is_numeric(df.schema[a].dataType) or isinstance(df.schema[a].dataType, T.DateType) for a in axes]
    rows = df.select(*[F.col(f"`{a}`").alias(f"a{k}") for k, a in enumerate(axes)], *[coerce.plain(F.col(f"`{f}`"), df.schema[f].dataType).alias(f) for f in fields]).dropna(subset=[f"a{k}" for k in range(len(axes))])
    cells = rows.groupBy(*[f"a{k}" for k in range(len(axes))]).agg(*[F.avg(f"`{f}`").alias(f) for f in fields], F.count("*").alias("density"))
    sizes = []
    for k in range(len(axes)):
        places = cells.select(f"a{k}").distinct().withColumn(f"p{k}", F.row_number().over(Window.orderBy(f"a{k}")) - 1)  # a row for each value of the axis
        sizes.append(places.count())
        cells = cells.join(F.broadcast(places) if sizes[-1] <= 100_000 else places, f"a{k}")
    places = [f"p{k}" for k in range(len(axes))]
    if math.prod(sizes) <= ONE_TASK:
        cells = cells.withColumn("vid", F.row_number().over(Window.orderBy(*places)) - 1)
    else:
        cells = numbered(cells, places, "__rn").withColumn("vid", (F.col("__rn") - 1).cast("int"))
    vertices = cells.select("vid", *[f"a{k}" for k in range(len(axes))], *places, *[F.col(f"`{f}`") for f in fields], "density")
    return Grid(list(axes), ordered, list(fields), vertices, sizes, list(wraps or [False] * len(axes)), [False] * len(axes))


def kept(grid: Grid) -> Grid:
    """The same grid with its vertices and edges stored, for what asks for them more than once."""
    held = replace(grid, vertices=stored(grid.vertices), _edges=None)
    held._edges = stored(edges(held))
    return held


def with_wraps(grid: Grid) -> Grid:
    """The same grid, its ordered axes of four values or more joined end to end where both ends look alike."""
    found = [wraps_around(grid, a) if o and n >= 4 else {"wraps": False, "reversing": False} for a, o, n in zip(grid.axes, grid.ordered, grid.sizes, strict=True)]
    return replace(grid, wraps=[w["wraps"] for w in found], flips=[w["reversing"] for w in found], _edges=None)


def edges(grid: Grid) -> DataFrame:
    """Equi-joins on all other places: along an ordered axis also on the next place (a missing value in between breaks the link)."""
    out = None
    k_axes = range(len(grid.axes))
    v = grid.vertices.select("vid", *[f"p{k}" for k in k_axes])
    for axis in k_axes:
        others = [f"p{k}" for k in k_axes if k != axis]
        left = v.select(F.col("vid").alias("src"), *others, F.col(f"p{axis}").alias("p"))
        right = v.select(F.col("vid").alias("dst"), *others, F.col(f"p{axis}").alias("q"))
        if grid.ordered[axis]:
            following = F.col("p") + 1
            if grid.wraps[axis]:
                following = following % grid.sizes[axis]
            up = left.withColumn("q", following).join(right, [*others, "q"]).select("src", "dst").filter("src <> dst")
            found = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        elif others:
            found = left.join(right, others).filter("src <> dst").select("src", "dst")
        else:
            found = left.crossJoin(right).filter("src <> dst").select("src", "dst")  # one axis: at most 6 sqrt(n) values
        found = found.withColumn("axis", F.lit(axis))
        out = found if out is None else out.unionByName(found)
    return out


def with_neighbours(grid: Grid, fields: Sequence[str]) -> DataFrame:
    """src, dst, axis, and the fields at both ends (f, f__n)."""
    v = grid.vertices.select("vid", *[F.col(f"`{f}`") for f in fields])
    near = v.select(F.col("vid").alias("dst"), *[F.col(f"`{f}`").alias(f"{f}__n") for f in fields])
    return grid.edges().join(v.withColumnRenamed("vid", "src"), "src").join(near, "dst")


def curvature(grid: Grid) -> DataFrame:
    """vid, curvature: mean over fields of |value - mean of neighbours| / max(|mean of neighbours|, 1)."""
    fields = grid.fields
    means = with_neighbours(grid, fields).groupBy("src").agg(*[F.avg(f"`{f}__n`").alias(f"{f}__m") for f in fields])
    joined = grid.vertices.join(means, grid.vertices["vid"] == means["src"], "left")
    parts = [F.abs(F.col(f"`{f}`") - F.col(f"`{f}__m`")) / F.greatest(F.abs(f"`{f}__m`"), F.lit(1.0)) for f in fields]
    total, n = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return joined.select("vid", F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("curvature"))


def degrees(grid: Grid) -> DataFrame:
    counts = grid.edges().groupBy("src").agg(F.count_distinct("dst").alias("degree"))
    return grid.vertices.select("vid").join(counts, F.col("vid") == F.col("src"), "left").select("vid", F.coalesce("degree", F.lit(0)).alias("degree"))


def ricci(grid: Grid) -> DataFrame:
    """vid, ricci: mean over edges of 4 - degree - degree of the other end; 0 for a vertex by itself."""
    d = degrees(grid)
    e = grid.edges().select("src", "dst").distinct()
    j = e.join(d.select(F.col("vid").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("vid").alias("dst"), F.col("degree").alias("b")), "dst")
    means = j.groupBy("src").agg(F.avg(4 - F.col("a") - F.col("b")).alias("ricci"))
    return d.join(means, F.col("vid") == F.col("src"), "left").select("vid", F.coalesce("ricci", F.lit(0.0)).alias("ricci"))


def morse(grid: Grid, name: str) -> DataFrame:
    """vid, above, below (neighbours), kind: minimum, maximum, saddle or regular."""
    e = with_neighbours(grid, [name])
    up, down = F.col(f"`{name}__n`") > F.col(f"`{name}`") + 1e-12, F.col(f"`{name}__n`") < F.col(f"`{name}`") - 1e-12
    c = e.groupBy(F.col("src").alias("vid")).agg(F.count_if(up).alias("above"), F.count_if(down).alias("below"))
    kind = F.when((F.col("below") == 0) & (F.col("above") > 0), "minimum").when((F.col("above") == 0) & (F.col("below") > 0), "maximum").when((F.col("above") >= 2) & (F.col("below") >= 2), "saddle").otherwise("regular")
    return c.withColumn("kind", kind)


def interaction(grid: Grid, a: str, b: str) -> DataFrame:
    """n, interaction: mean of the product of both differences along edges, divided by the mean of its size."""
    e = with_neighbours(grid, [a, b])
    p = (F.col(f"`{a}__n`") - F.col(f"`{a}`")) * (F.col(f"`{b}__n`") - F.col(f"`{b}`"))
    return e.agg(F.count(p).alias("n"), F.coalesce(F.try_divide(F.avg(p), F.nullif(F.avg(F.abs(p)), F.lit(0.0))), F.lit(0.0)).alias("interaction"))


def vector_field(grid: Grid, name: str) -> DataFrame:
    """vid, divergence: sum of the differences to the neighbours by their number; z; curl: share of the neighbours, in the order of
    axis and vid, whose difference has another sign than the next one's (the first follows the last; 0 below three); kind: source
    or sink (saddle where the curl is above 0.6), else vortex by the curl, else regular."""
    x, y = F.col(f"`{name}`"), F.col(f"`{name}__n`")
    e = with_neighbours(grid, [name]).filter(x.isNotNull()).select(F.col("src").alias("vid"), "axis", "dst", (y - x).alias("g"), (y > x).alias("up"))
    ring = Window.partitionBy("vid").orderBy("axis", "dst")
    following = F.first("up", ignorenulls=True).over(ring.rowsBetween(1, Window.unboundedFollowing))
    first = F.first("up", ignorenulls=True).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turns = e.withColumn("turn", F.col("up") != F.coalesce(following, first))
    curl = F.when(F.count("up") >= 3, F.count_if("turn") / F.count("up")).otherwise(0.0)
    d = turns.groupBy("vid").agg((F.coalesce(F.sum("g"), F.lit(0.0)) / F.count("*")).alias("divergence"), curl.alias("curl"))
    one = d.agg(F.avg("divergence").alias("__m"), F.stddev_pop("divergence").alias("__s"))
    z = F.when(F.col("__s") > 1e-12, (F.col("divergence") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    flow = F.when(F.col("z") > 1.5, "source").when(F.col("z") < -1.5, "sink")
    kind = F.when(F.col("curl") > 0.6, F.when(flow.isNull(), "vortex").otherwise("saddle")).otherwise(F.coalesce(flow, F.lit("regular")))
    return d.crossJoin(F.broadcast(one)).select("vid", "divergence", z.alias("z"), "curl").withColumn("kind", kind)


def walk_axis(grid: Grid, axis: str, name: str) -> DataFrame:
    """value of the axis, mean, min and max of the field over vertices (not weighted by density)."""
    k = grid.axes.index(axis)
    return grid.vertices.groupBy(F.col(f"a{k}").alias("value")).agg(F.avg(f"`{name}`").alias("mean"), F.min(f"`{name}`").alias("min"), F.max(f"`{name}`").alias("max"), F.count("*").alias("vertices"))


def frontier(grid: Grid, a: Column, b: Column, name: str | None = None, limit: int = 200) -> DataFrame:
    """Edges between a vertex that meets a and one that meets b (a comes first if both hold): vid_a, vid_b, jump of the field."""
    side = F.when(a, "a").when(b, "b")
    v = grid.vertices.select("vid", side.alias("side"), (F.col(f"`{name}`") if name else F.lit(None).cast("double")).alias("x")).filter("side is not null")
    e = grid.edges().select("src", "dst").distinct()
    left, right = v.filter("side = 'a'").select(F.col("vid").alias("src"), F.col("x").alias("xa")), v.filter("side = 'b'").select(F.col("vid").alias("dst"), F.col("x").alias("xb"))
    return e.join(left, "src").join(right, "dst").select(F.col("src").alias("vid_a"), F.col("dst").alias("vid_b"), (F.col("xb") - F.col("xa")).alias("jump")).orderBy("vid_a", "vid_b").limit(min(limit, 500))


def navigate(grid: Grid, vid: int, name: str) -> DataFrame:
    """dst, axis, gradient of each neighbour, steepest first."""
    e = grid.edges().filter(F.col("src") == vid)
    v = grid.vertices.select("vid", F.col(f"`{name}`").alias("x"))
    here = v.filter(F.col("vid") == vid).select(F.col("x").alias("x0"))
    return e.join(v, e["dst"] == v["vid"]).crossJoin(F.broadcast(here)).select("dst", "axis", (F.col("x") - F.col("x0")).alias("gradient")).orderBy(F.abs("gradient").desc(), "dst")


def highest_curvature(grid: Grid, top: int = 5) -> DataFrame:
    return curvature(grid).orderBy(F.col("curvature").desc(), "vid").limit(top)


def lowest_density(grid: Grid, top: int = 5) -> DataFrame:
    return grid.vertices.select("vid", "density").orderBy("density", "vid").limit(top)


def most_negative_ricci(grid: Grid, top: int = 5) -> DataFrame:
    return ricci(grid).orderBy("ricci", "vid").limit(top)


def critical_points(grid: Grid, name: str) -> DataFrame:
    """vid, kind: the minima, maxima and saddles of a field."""
    return morse(grid, name).filter("kind <> 'regular'").select("vid", "kind")


def coverage(grid: Grid) -> DataFrame:
    """One row: vertices, edges, isolated, density figures, occupied share of the full grid."""
    d = degrees(grid).agg(F.count("*").alias("vertices"), (F.sum("degree") / 2).cast("long").alias("edges"), F.count_if(F.col("degree") == 0).alias("isolated"))
    v = grid.vertices.agg(F.min("density").alias("min_density"), F.max("density").alias("max_density"), F.avg("density").alias("mean_density"))
    return d.crossJoin(v).withColumn("occupied", F.col("vertices") / float(math.prod(grid.sizes)))


def faces(grid: Grid) -> DataFrame:
    """Two axes: v, e, f (unit squares with all corners), euler."""
    if len(grid.axes) != 2:
        raise ValueError("two axes")
    v = grid.vertices.select("p0", "p1")
    shift = lambda d0, d1: v.select((F.col("p0") - d0).alias("p0"), (F.col("p1") - d1).alias("p1"))
    squares = v.join(shift(1, 0), ["p0", "p1"], "left_semi").join(shift(0, 1), ["p0", "p1"], "left_semi").join(shift(1, 1), ["p0", "p1"], "left_semi")
    lines = v.join(shift(1, 0), ["p0", "p1"], "left_semi").select(F.lit(1).alias("x")).unionByName(v.join(shift(0, 1), ["p0", "p1"], "left_semi").select(F.lit(1).alias("x")))
    out = v.agg(F.count("*").alias("v")).crossJoin(lines.agg(F.count("*").alias("e"))).crossJoin(squares.agg(F.count("*").alias("f")))  # one row each
    return out.withColumn("euler", F.col("v") - F.col("e") + F.col("f"))


def wrap(grid: Grid, axis: str) -> DataFrame:
    """For each field the means of the lowest and highest fifth of an ordered axis; similarity, and whether the sign flips."""
    k = grid.axes.index(axis)
    n = grid.sizes[k]
    share = max(1, int(n * 0.2))
    p = F.col(f"p{k}")
    entries = [F.struct(F.lit(f).alias("field"), F.avg(F.when(p < share, F.coalesce(F.col(f"`{f}`"), F.lit(0.0)))).alias("low"), F.avg(F.when(p >= n - share, F.coalesce(F.col(f"`{f}`"), F.lit(0.0)))).alias("high")) for f in grid.fields]
    out = grid.vertices.agg(F.array(*entries).alias("x")).select(F.inline("x"))
    size = F.abs("low") + F.abs("high")
    return out.withColumn("similarity", F.when(size > 0, 1 - F.abs(F.abs("low") - F.abs("high")) / size).otherwise(1.0)).withColumn("flips", F.col("low") * F.col("high") < 0)


def wraps_around(grid: Grid, axis: str) -> dict[str, Any]:
    rows = wrap(grid, axis).collect()
    mean = sum(r["similarity"] for r in rows) / max(len(rows), 1)
    flips = sum(r["flips"] for r in rows)
    wrapped = grid.ordered[grid.axes.index(axis)] and grid.sizes[grid.axes.index(axis)] >= 4 and mean >= 0.6
    return {"axis": axis, "similarity": mean, "wraps": wrapped, "reversing": wrapped and flips > len(rows) - flips}
