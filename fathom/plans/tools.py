"""The tool surface: every operation under a name, with a JSON schema, for language-model agents of any provider."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import predicate
from fathom.operators import causal, dependency, drivers, dynamics, grid, insight, laws, paths, quality, screening, structure
from fathom.plans import exports
from fathom.sources.catalog import ROW, Catalog, Dataset


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, Any]
    handler: Callable[..., Any]
    group: str


def listed(value: Any) -> list[str]:
    """A list of names: a list, JSON, or comma-separated text."""
    if value is None or value == "":
        return []
    if isinstance(value, list):
        return [str(v) for v in value]
    text = str(value).strip()
    return [str(v) for v in json.loads(text)] if text.startswith("[") else [v.strip() for v in text.split(",") if v.strip()]


def parsed(value: Any) -> Any:
    return json.loads(value) if isinstance(value, str) else value


def answer(value: Any, most: int = 200) -> Any:
    """A frame's rows, everything else as it is. Of more than `most` rows, some (evenly spaced ones of a series) with the total and a mark."""
    if not isinstance(value, DataFrame):
        return value
    rows = value.limit(most + 1).collect()
    if len(rows) <= most:
        return [r.asDict(True) for r in rows]
    total = value.count()
    if "rn" in value.columns:
        rows = value.filter((F.col("rn") - 1) % -(-total // most) == 0).orderBy("rn").limit(most).collect()
    return {"rows": [r.asDict(True) for r in rows[:most]], "total": total, "truncated": True}


KINDS = {"s": "string", "i": "integer", "n": "number", "b": "boolean"}


def schema(spec: str) -> dict[str, Any]:
    """`name:kind`, with `=default` where optional; kinds s, i, n, b."""
    properties, required = {}, []
    for part in spec.split():
        name, _, rest = part.partition(":")
        kind, optional, default = rest.partition("=")
        properties[name] = {"type": KINDS[kind]}
        if optional and default:
            properties[name]["default"] = {"i": int, "n": float, "b": lambda x: x == "true", "s": str}[kind](default)
        elif not optional:
            required.append(name)
    return {"type": "object", "properties": properties, "required": required}


def vertex(g: grid.Grid, coordinates: Any) -> int:
    """The vertex at a dict or list of axis values."""
    at = parsed(coordinates)
    values = [at[a] for a in g.axes] if isinstance(at, dict) else list(at)
    found = g.vertices.filter(" and ".join(f"cast(a{k} as string) = '{str(v).replace(chr(39), chr(39) * 2)}'" for k, v in enumerate(values))).select("vid").first()
    if found is None:
        raise ValueError(f"no vertex at {values}")
    return found["vid"]


def all_tools(c: Catalog) -> list[Tool]:
    """The 68 tools: 6 of retrieval, 39 of statistics, 20 of the grid, 3 of export."""
    out: list[Tool] = []

    def add(group: str, name: str, description: str, spec: str, fn: Callable[..., Any]) -> None:
        out.append(Tool(name, description, schema(spec), lambda fn=fn, **k: answer(fn(**k)), group))

    def frame(key: str) -> DataFrame:
        return c.get(key).typed()

    def surface(key: str) -> grid.Grid:
        made = c.get(key).grid()
        if made is None:
            raise ValueError("no grid: too few rows, axes, fields or vertices")
        return made

    def field(g: grid.Grid, name: str | None) -> str:
        return name if name in g.fields else g.fields[0]

    page = "sort_by:s= sort_desc:b=true"
    add("retrieval", "retrieve", "A page of rows.", f"key:s offset:i=0 limit:i=25 {page} columns:s=", lambda key, offset=0, limit=25, sort_by=None, sort_desc=True, columns=None: c.retrieve(key, offset, limit, sort_by, sort_desc, listed(columns)))
    add("retrieval", "aggregate", "One aggregate of a column.", "key:s column:s func:s", c.aggregate)
    add("retrieval", "query", "Rows that meet a JSON predicate.", f"key:s where_json:s {page} limit:i=25 columns:s=", lambda key, where_json, sort_by=None, sort_desc=True, limit=25, columns=None: c.query(key, where_json, sort_by, sort_desc, limit, listed(columns)))
    add("retrieval", "schema", "Types and statistics of all columns.", "key:s", c.schema)
    add("retrieval", "group_by", "Groups with aggregates.", f"key:s group_cols:s agg_json:s {page} limit:i=50", lambda key, group_cols, agg_json, sort_by=None, sort_desc=True, limit=50: c.group_by(key, listed(group_cols), agg_json, sort_by, sort_desc, limit))
    add("retrieval", "to_excel", "Headers and a matrix of values.", f"key:s columns:s= {page} max_rows:i=200", lambda key, columns=None, sort_by=None, sort_desc=True, max_rows=200: exports.export_sheet(c.get(key), listed(columns), sort_by, sort_desc, max_rows))

    st = lambda *a: add("stats", *a)
    st("regress", "Least squares of a target on drivers.", "key:s target:s drivers_json:s", lambda key, target, drivers_json: screening.regress(frame(key), target, listed(drivers_json)))
    st("partial_corr", "Correlation with controls held constant.", "key:s field_a:s field_b:s controls_json:s", lambda key, field_a, field_b, controls_json: screening.partial_correlation(frame(key), field_a, field_b, listed(controls_json)))
    st("pca_surface", "Principal components.", "key:s fields_json:s n_components:i=3", lambda key, fields_json, n_components=3: screening.pca(frame(key), listed(fields_json), n_components))
    st("dependency_screen", "Candidates ranked by dependence.", "key:s target:s candidates_json:s controls_json:s=[] top_k:i=8", lambda key, target, candidates_json, controls_json="[]", top_k=8: screening.dependency_screen(frame(key), target, listed(candidates_json), listed(controls_json), top_k))
    st("solver", "Rows ranked against a goal.", "key:s target_field:s goal_json:s controllable_vars_json:s constraints_json:s=[] top_k:i=5", lambda key, target_field, goal_json, controllable_vars_json="[]", constraints_json="[]", top_k=5: screening.solve(frame(key), target_field, parsed(goal_json), parsed(constraints_json), top_k, shown=listed(controllable_vars_json)))
    st("distribution", "Moments, quantiles, histogram.", "key:s field:s bins:i=15", lambda key, field, bins=15: {"moments": answer(quality.distribution(frame(key), field)), "histogram": answer(quality.histogram(frame(key), field, bins))})
    st("outliers", "Rows far from the rest.", "key:s fields_json:s method:s=both threshold:n=3.0", lambda key, fields_json, method="both", threshold=3.0: quality.outliers(frame(key), listed(fields_json), method, threshold))
    st("benford", "First digits.", "key:s field:s", lambda key, field: quality.benford(frame(key), field))
    st("vif", "Collinearity.", "key:s fields_json:s", lambda key, fields_json: quality.vif(frame(key), listed(fields_json)))
    st("effective_dimension", "How many dimensions the data fill.", "key:s fields_json:s method:s=both", lambda key, fields_json, method="both": quality.effective_dimension(frame(key), listed(fields_json), method=method))
    st("rank_corr", "Rank correlations.", "key:s fields_json:s method:s=spearman", lambda key, fields_json, method="spearman": dependency.rank_correlations(frame(key), listed(fields_json), method))
    st("chi_squared", "Independence of categories.", "key:s field_a:s field_b:s bins:i=10", lambda key, field_a, field_b, bins=10: dependency.chi_squared(frame(key), field_a, field_b, bins))
    st("anova", "Means of groups.", "key:s group_field:s target_field:s", lambda key, group_field, target_field: dependency.anova(frame(key), group_field, target_field))
    st("mutual_info_matrix", "Mutual information of pairs.", "key:s fields_json:s bins:i=10", lambda key, fields_json, bins=10: dependency.mutual_information(frame(key), listed(fields_json), bins))
    st("hsic", "Kernel independence.", "key:s field_a:s field_b:s kernel:s=gaussian n_permutations:i=100", lambda key, field_a, field_b, kernel="gaussian", n_permutations=100: dependency.hsic(frame(key), field_a, field_b, kernel, n_permutations))
    st("copula_tail", "Dependence in the tails.", "key:s field_a:s field_b:s tail_threshold:n=0.05", lambda key, field_a, field_b, tail_threshold=0.05: {"tails": answer(dependency.tail_dependence(frame(key), field_a, field_b, (tail_threshold, 0.01, 0.1, 0.15, 0.2))), "kendall": answer(dependency.banded_kendall(frame(key), field_a, field_b, [ROW]))})
    st("polynomial_test", "Shape of a relation.", "key:s field_x:s field_y:s max_degree:i=3", lambda key, field_x, field_y, max_degree=3: drivers.polynomial(frame(key), field_x, field_y, max_degree))
    st("interaction_screen", "Pairs that work together.", "key:s target:s candidates_json:s top_k:i=5", lambda key, target, candidates_json, top_k=5: drivers.interactions(frame(key), target, listed(candidates_json), top_k))
    st("sparse_drivers", "A sparse linear model.", "key:s target:s candidates_json:s alpha:n= max_features:i=10", lambda key, target, candidates_json, alpha=None, max_features=10: drivers.sparse_drivers(frame(key), target, listed(candidates_json), alpha, max_features))
    st("feature_importance", "What each driver is worth.", "key:s target:s candidates_json:s n_shuffles:i=10", lambda key, target, candidates_json, n_shuffles=10: drivers.importance(frame(key), target, listed(candidates_json)))
    st("information_bottleneck", "Clusters of states that keep information.", "key:s input_fields_json:s target_field:s beta:n=1.0 n_clusters:i=5", lambda key, input_fields_json, target_field, beta=1.0, n_clusters=5: drivers.bottleneck(frame(key), listed(input_fields_json), target_field, beta, n_clusters))
    st("cluster", "k-means.", "key:s fields_json:s k:i= max_k:i=8", lambda key, fields_json, k=None, max_k=8: structure.cluster(frame(key), listed(fields_json), k, max_k))
    st("spectral_decomposition", "Spectrum of the neighbour graph.", "key:s fields_json:s n_neighbors:i=10 n_components:i=5", lambda key, fields_json, n_neighbors=10, n_components=5: structure.spectral(frame(key), listed(fields_json), n_neighbors, n_components))
    st("latent_sources", "Independent components.", "key:s fields_json:s n_sources:i=", lambda key, fields_json, n_sources=None: structure.sources(frame(key), listed(fields_json), n_sources))
    st("graphical_model", "Partial correlation graph.", "key:s fields_json:s method:s=threshold alpha:n=0.01", lambda key, fields_json, method="threshold", alpha=0.01: structure.graphical_model(frame(key), listed(fields_json), method, alpha))
    st("persistent_topology", "Components and cycles over scales.", "key:s fields_json:s max_dimension:i=1 max_points:i=200", lambda key, fields_json, max_dimension=1, max_points=200: structure.topology(frame(key), listed(fields_json), max_dimension, max_points))
    st("causal_graph", "Constraint-based causal search.", "key:s fields_json:s alpha:n=0.05 max_conditioning_set:i=3", lambda key, fields_json, alpha=0.05, max_conditioning_set=3: causal.causal_graph(frame(key), listed(fields_json), alpha, max_conditioning_set))
    st("transfer_entropy", "Directed information over lags.", "key:s source_field:s target_field:s order_by:s max_lag:i=5 bins:i=8", lambda key, source_field, target_field, order_by, max_lag=5, bins=8: causal.transfer_summary(frame(key), source_field, target_field, [order_by, ROW], max_lag, bins))
    st("do_estimate", "Adjusted effect of a treatment.", "key:s treatment:s outcome:s confounders_json:s method:s=regress", lambda key, treatment, outcome, confounders_json, method="regress": causal.effect(frame(key), treatment, outcome, listed(confounders_json), method))
    st("counterfactual_impact", "Synthetic control.", "key:s outcome_field:s time_field:s unit_field:s treated_unit:s intervention_time:s donor_units_json:s=", lambda key, outcome_field, time_field, unit_field, treated_unit, intervention_time, donor_units_json=None: causal.synthetic_control(frame(key), outcome_field, time_field, unit_field, treated_unit, intervention_time, listed(donor_units_json)))
    st("autocorrelation", "Correlation with the past.", "key:s field:s order_by:s max_lag:i=20", lambda key, field, order_by, max_lag=20: dynamics.acf_summary(frame(key), field, [order_by, ROW], max_lag))
    st("changepoints", "Shifts of the mean.", "key:s field:s order_by:s min_segment:i=10 threshold:n=2.0", lambda key, field, order_by, min_segment=10, threshold=2.0: dynamics.changepoints(frame(key), field, [order_by, ROW], min_segment, threshold))
    st("rolling_analysis", "Rolling figures.", "key:s field:s order_by:s window:i=20 field_b:s=", lambda key, field, order_by, window=20, field_b=None: dynamics.rolling_summary(frame(key), field, [order_by, ROW], window, field_b or None).first().asDict() | {"windows_sampled": answer(dynamics.rolling(frame(key), field, [order_by, ROW], window, field_b or None), 50)})
    st("phase_space", "Delay embedding.", "key:s field:s order_by:s max_embedding_dim:i=10 tau:i=", lambda key, field, order_by, max_embedding_dim=10, tau=None: dynamics.phase_space(frame(key), field, [order_by, ROW], max_embedding_dim, tau))
    st("ergodicity_test", "Time averages against ensemble.", "key:s field:s order_by:s window_sizes_json:s=[10,25,50,100]", lambda key, field, order_by, window_sizes_json="[10,25,50,100]": dynamics.ergodic(frame(key), field, [order_by, ROW], parsed(window_sizes_json)))
    st("recurrence_analysis", "Recurrence of states.", "key:s fields_json:s order_by:s threshold:n= embedding_dim:i=3", lambda key, fields_json, order_by, threshold=None, embedding_dim=3: dynamics.recurrence(frame(key), listed(fields_json), [order_by, ROW], threshold, embedding_dim))
    st("entropy_spectrum", "Sample entropy over scales.", "key:s field:s order_by:s max_scale:i=10 embedding_dim:i=2", lambda key, field, order_by, max_scale=10, embedding_dim=2: dynamics.sample_entropy(frame(key), field, [order_by, ROW], max_scale, embedding_dim))
    st("renormalization_flow", "Correlations over block sizes.", "key:s fields_json:s max_scale:i=5", lambda key, fields_json, max_scale=5: laws.renormalization_flow(frame(key).drop(ROW) if not listed(fields_json) else frame(key), listed(fields_json), [ROW], max_scale))
    st("symmetry_scan", "Symmetries of columns.", "key:s fields_json:s", lambda key, fields_json: {"fields": answer(laws.symmetry(frame(key), listed(fields_json), [ROW])), "pairs": answer(laws.exchangeable(frame(key), listed(fields_json)).filter("exchangeable"))})

    m = lambda *a: add("manifold", *a)
    m("manifold_state", "Axes, fields, topology and outstanding vertices of the grid.", "key:s", lambda key: state(c.get(key)))
    m("manifold_insights", "Drivers, surprises and regimes towards an objective.", "key:s objective_json:s top_k:i=5", lambda key, objective_json, top_k=5: insight.insights(frame(key).drop(ROW), parsed(objective_json), top_k))
    m("navigate", "Gradients to the neighbours of a vertex.", "key:s coord_json:s target_field:s=", lambda key, coord_json, target_field=None: grid.navigate(surface(key), vertex(surface(key), coord_json), field(surface(key), target_field)))
    m("manifold_slice", "The grid of the rows that meet a condition.", "key:s condition_json:s target_field:s=", lambda key, condition_json, target_field=None: sliced(c, key, parsed(condition_json), target_field))
    m("geodesic", "The cheapest way between two vertices.", "key:s start_json:s end_json:s target_field:s=", lambda key, start_json, end_json, target_field=None: paths.geodesic(surface(key), vertex(surface(key), start_json), vertex(surface(key), end_json), target_field or None))
    m("walk_axis", "A field along an axis.", "key:s walk_axis:s target_field:s", lambda key, walk_axis, target_field: grid.walk_axis(surface(key), walk_axis, target_field))
    m("orbit", "Vertices up to a distance.", "key:s center_json:s radius:i target_field:s= resolution:i=16 mode:s=ring", lambda key, center_json, radius, target_field=None, resolution=16, mode="ring": paths.orbit_views(surface(key), vertex(surface(key), center_json), [radius], target_field or None, resolution, mode)[0])
    m("multiscale_view", "Disks of several radii.", "key:s center_json:s radii_json:s target_field:s= resolution:i=16", lambda key, center_json, radii_json, target_field=None, resolution=16: paths.orbit_views(surface(key), vertex(surface(key), center_json), parsed(radii_json), target_field or None, resolution))
    m("frontier", "Edges between two regions.", "key:s condition_a_json:s condition_b_json:s target_field:s= limit:i=200", lambda key, condition_a_json, condition_b_json, target_field=None, limit=200: border(surface(key), parsed(condition_a_json), parsed(condition_b_json), target_field, limit))
    m("basin", "Vertices that flow to the same extremum.", "key:s seed_json:s target_field:s direction:s=descend", lambda key, seed_json, target_field, direction="descend": basin(surface(key), vertex(surface(key), seed_json), target_field, direction))
    m("ridge_trace", "A greedy way up.", "key:s seed_json:s target_field:s max_steps:i=25", lambda key, seed_json, target_field, max_steps=25: paths.trace(surface(key), vertex(surface(key), seed_json), target_field, True, max_steps))
    m("valley_trace", "A greedy way down.", "key:s seed_json:s target_field:s max_steps:i=25", lambda key, seed_json, target_field, max_steps=25: paths.trace(surface(key), vertex(surface(key), seed_json), target_field, False, max_steps))
    m("coverage_audit", "How full the grid is.", "key:s", lambda key: grid.coverage(surface(key)))
    m("wrap_audit", "Whether an axis wraps around.", "key:s axis:s", lambda key, axis: grid.wraps_around(surface(key), axis))
    m("heat_kernel", "Heat kernel signatures and bottlenecks.", "key:s target_field:s= n_eigen:i=20 top_k:i=10", lambda key, target_field=None, n_eigen=20, top_k=10: paths.heat_kernel(surface(key), target_field or None, n_eigen, top_k))
    m("reeb_graph", "Level set components.", "key:s target_field:s n_levels:i=20", lambda key, target_field, n_levels=20: paths.reeb(surface(key), target_field, n_levels))
    m("vector_field", "Sources, sinks, vortices and saddles of a field.", "key:s target_field:s top_k:i=10", lambda key, target_field, top_k=10: flow(surface(key), target_field, top_k))
    m("laplacian_spectrum", "Spectrum of the grid.", "key:s n_eigen:i=15 n_clusters:i=", lambda key, n_eigen=15, n_clusters=None: paths.spectrum(surface(key), n_eigen, n_clusters))
    m("scalar_harmonics", "A field on the grid's modes.", "key:s target_field:s n_modes:i=10 top_k:i=10", lambda key, target_field, n_modes=10, top_k=10: paths.harmonics(surface(key), target_field, n_modes, top_k))
    m("diffusion_distance", "Diffusion distances of landmarks.", "key:s landmarks_json:s= time_param:n=1.0 n_landmarks:i=8", lambda key, landmarks_json=None, time_param=1.0, n_landmarks=8: paths.diffusion(surface(key), [vertex(surface(key), x) for x in parsed(landmarks_json)] if landmarks_json else None, time_param, n_landmarks))

    add("export", "to_csv", "CSV text.", f"key:s columns:s= {page} max_rows:i=500", lambda key, columns=None, sort_by=None, sort_desc=True, max_rows=500: exports.export_csv(c.get(key), listed(columns), sort_by, sort_desc, max_rows))
    add("export", "to_markdown", "A Markdown table.", f"key:s columns:s= {page} max_rows:i=50", lambda key, columns=None, sort_by=None, sort_desc=True, max_rows=50: exports.export_markdown(c.get(key), listed(columns), sort_by, sort_desc, max_rows))
    add("export", "export", "An artifact with file name and MIME type.", f"key:s format:s=csv columns:s= {page} max_rows:i=500", lambda key, format="csv", columns=None, sort_by=None, sort_desc=True, max_rows=500: exports.artifact(c.get(key), format, columns=listed(columns), sort_by=sort_by, sort_desc=sort_desc, max_rows=max_rows))
    return out


def state(d: Dataset) -> dict[str, Any]:
    """The grid as a whole; without one, the columns it could have been made of."""
    made = d.grid()
    if made is None:
        filled = d.typed().agg(*[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(d.columns)]).first()
        return {"error": "no grid: too few rows, axes, fields or vertices", "rows": d.rows, "types": d.types, "filled": dict(zip(d.columns, filled, strict=True))}
    return {"key": d.key, "rows": d.rows} | paths.surface(made)


def sliced(c: Catalog, key: str, condition: dict, name: str | None = None) -> dict[str, Any]:
    """The grid of the rows that meet a condition, as a whole, with the range of a field over its vertices."""
    rows = predicate.slice_rows(c.get(key).typed().drop(ROW), condition["column"], condition["op"], condition["value"])
    n = rows.count()
    if n < grid.MIN_ROWS:
        return {"error": "too few rows", "rows": n}
    axes, fields = grid.identify_axes(rows)
    if not axes or not fields:
        return {"error": "no axes or no fields", "rows": n}
    made = grid.kept(grid.with_wraps(grid.build(rows, axes, fields)))
    if name and name not in fields:
        return {"error": f"{name} is no field of the slice", "rows": n, "fields": fields}
    value = F.col(f"`{name}`") if name else F.lit(None).cast("double")
    over = made.vertices.agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")).first().asDict()
    return {"rows": n, "of_rows": c.get(key).rows, "condition": condition} | ({"target": {"field": name} | over} if name else {}) | paths.surface(made)


def flow(g: grid.Grid, name: str, top_k: int) -> dict[str, Any]:
    """Of each kind of vertex how many, and those of the strongest divergence."""
    field = grid.vector_field(g, name).cache()
    try:
        sizes = {r["kind"]: r["n"] for r in field.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        strongest = {kind: answer(field.filter(F.col("kind") == kind).orderBy(F.abs("divergence").desc(), "vid").limit(top_k)) for kind in ("source", "sink", "vortex", "saddle") if kind in sizes}
    finally:
        field.unpersist()
    return {"sizes": sizes, "rotational": "vortex" in sizes, "strongest": strongest}


def border(g: grid.Grid, a: dict, b: dict, name: str | None, limit: int) -> DataFrame:
    """Conditions name axes or fields; axes are compared as text."""
    from pyspark.sql import functions as F

    named = g.vertices.select("*", *[F.col(f"a{k}").cast("string").alias(axis) for k, axis in enumerate(g.axes)])
    shown = grid.Grid(g.axes, g.ordered, g.fields, named, g.sizes, g.wraps, g.edges())
    return grid.frontier(shown, predicate.build(named, a), predicate.build(named, b), name or None, limit)


def basin(g: grid.Grid, vid: int, name: str, direction: str) -> dict[str, Any]:
    flow = paths.basins(g, name, direction == "descend")
    end = flow.filter(f"vid = {vid}").first()["extremum"]
    return {"extremum": end, "members": [r["vid"] for r in flow.filter(f"extremum = {end}").orderBy("vid").collect()]}


def tools_of(tools: Sequence[Tool], group: str) -> list[Tool]:
    return [t for t in tools if t.group == group]


# providers

NAME = re.compile(r"^[A-Za-z0-9_-]{1,64}$")


def for_provider(tools: Sequence[Tool], provider: str, style: str = "responses", strict: bool = False, examples: dict[str, list] | None = None) -> list[dict[str, Any]]:
    """Tool definitions in a provider's form: openai (responses or chat_completions), xai, anthropic, gemini."""
    bad = [t.name for t in tools if not NAME.match(t.name)]
    if bad:
        raise ValueError(f"names not allowed: {bad}")
    if provider in ("openai", "xai"):
        out = []
        for t in tools:
            parameters = t.parameters
            if strict:
                parameters = parameters | {"additionalProperties": False, "required": list(parameters["properties"])}
            body = {"name": t.name, "description": t.description, "parameters": parameters} | ({"strict": True} if strict else {})
            out.append({"type": "function", "function": body} if style == "chat_completions" else {"type": "function"} | body)
        return out
    if provider == "anthropic":
        shown = lambda t: "".join(f"\nExample: {json.dumps(x)}" for x in (examples or {}).get(t.name, []))
        return [{"name": t.name, "description": t.description + shown(t), "input_schema": t.parameters} for t in tools]
    if provider == "gemini":
        return [{"name": t.name, "description": t.description, "parameters": t.parameters} for t in tools]
    raise ValueError(f"unknown provider {provider!r}")


def call(tools: Sequence[Tool], name: str, arguments: Any = None) -> Any:
    """Run a tool with arguments as a dict, JSON text, or a mapping such as a protocol buffer's."""
    found = {t.name: t for t in tools}.get(name)
    if found is None:
        raise KeyError(f"no tool {name}")
    given = json.loads(arguments) if isinstance(arguments, str) and arguments.strip() else dict(arguments or {})
    missing = [p for p in found.parameters["required"] if p not in given]
    if missing:
        raise ValueError(f"missing: {missing}")
    return found.handler(**{k: v for k, v in given.items() if k in found.parameters["properties"]})


def safe_call(tools: Sequence[Tool], name: str, arguments: Any = None) -> Any:
    """The same, with an error as an answer."""
    try:
        return call(tools, name, arguments)
    except Exception as e:
        return {"error": f"{type(e).__name__}: {e}"}
