"""Semantics that SQL doesn't show: coercion, ingest, catalog, grid on small shapes, numerics, tools, adapters, streams."""

import asyncio
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import coerce, predicate
from fathom.operators import causal, drivers, dynamics, grid, insight, paths, profile, quality, relational, screening, structure
from fathom.plans import exports, tools
from fathom.sources import catalog, payload
from fathom.streaming import ingest


@pytest.fixture(scope="module")
def law(spark):
    r = random.Random(42)
    rows = [(i, float(i), 2.0 * i + 10 + r.gauss(0, 0.1), r.uniform(0, 100), "abc"[i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, "_row_id long, x double, y double, z double, cat string").cache()


def test_coercions(spark):
    texts = ["$1,234.5", "12%", "(5)", "1_000", "12d", "nan", "inf", "", None, " 7 ", "x", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    kind = df.schema["v"].dataType
    got = df.select(coerce.permissive(F.col("v"), kind), coerce.strict(F.col("v")), coerce.plain(F.col("v"), kind)).collect()
    assert [r[0] for r in got] == [1234.5, 12.0, 5.0, 1000.0, 12.0, None, None, None, None, 7.0, None, 1000.0]
    assert [r[1] for r in got] == [None] * 9 + [7.0, None, 1000.0]
    assert [r[2] for r in got] == [r[1] for r in got]


def test_predicates(spark):
    df = spark.createDataFrame([(10.0, "apple"), (20.0, "b"), (30.0, None), (None, "Apple pie"), (40.0, "")], "price double, name string")
    n = lambda p: predicate.where(df, p).count()
    assert n({"column": "price", "op": ">", "value": 15}) == 3
    assert n({"column": "name", "op": "contains", "value": "APPLE"}) == 2
    assert n({"column": "price", "op": "=", "value": None}) == 1
    assert n({"and": []}) == 5 and n({"or": []}) == 0
    deep = {"column": "price", "op": ">", "value": 0}
    for _ in range(22):
        deep = {"and": [deep]}
    for bad in (deep, {"column": "price", "op": "~", "value": 1}, {"and": 3}, "{"):
        with pytest.raises(predicate.InvalidPredicate):
            predicate.where(df, bad)
    counts = [predicate.slice_rows(df, "price", op, v).count() for op, v in ((">", 15), (">=", 20), ("<", 25), ("=", 20), ("!=", 20))]
    assert counts == [3, 3, 2, 1, 3]
    assert predicate.slice_rows(df, "nowhere", "=", 1).count() == 0


def test_aggregates_and_groups(spark):
    df = spark.createDataFrame([("a|b", "c", ""), ("a", "b|c", "x"), (None, "c", None)], "p string, q string, v string")
    assert df.agg(relational.aggregate(df, "v", "count"), relational.aggregate(df, "v", "count_distinct")).first() == (1, 2)
    assert relational.group(df, ["p", "q"], [{"column": "v", "func": "count"}]).count() == 3
    with pytest.raises(ValueError):
        relational.group(df, ["nowhere"], [{"column": "v", "func": "count"}])


def test_payloads():
    data = {"meta": {"a": [1]}, "rows": [{"id": i, "n": {"x": i, "y": {"z": 1}}, "j": '{"k": 2}'} for i in range(4)]}
    assert payload.rows_of(data)[2] == {"id": 2, "n.x": 2, "n.y.z": 1, "j.k": 2}
    assert payload.rows_of({"one": [{"a": 1}]}) == []
    table = [{"id": i, "items": [{"s": k} for k in range(2)] if i % 3 == 0 else None} for i in range(9)]
    assert payload.rows_of(table)[:2] == [{"id": 0, "items.s": 0}, {"id": 0, "items.s": 1}]
    assert len(payload.rows_of([{"id": i, "items": [{"s": 1}] if i == 0 else 5} for i in range(9)])) == 9
    shape = payload.nesting(data)
    assert shape.depth == 5 and shape.lists


def test_profile(spark):
    df = spark.createDataFrame([("1", "0", "2020-01-01", "5", '{"a":1}', "$5"), ("0", "x1", "2020-01-02", "6.5", '{"a":2}', "$6"), ("yes", "", "2020-02-01T10:00:00", "7", "[1]", "$7")], "b string, s string, d string, n string, j string, c string")
    types = profile.column_types(df)
    assert types == {"b": "bool", "s": "mixed", "d": "mixed", "n": "numeric", "j": "mixed", "c": "string"}
    assert "currency" in profile.tags(df, "c", "string")
    assert profile.decide({}) == "null" and profile.decide({"numeric": 7, "string": 3}) == "numeric" and profile.decide({"numeric": 65, "string": 35}) == "mixed"


def test_linear_law(law):
    fit = screening.regress(law, "y", ["x"])
    assert fit["r2"] > 0.99 and abs(fit["drivers"][0]["coefficient"] - 2) < 0.1 and abs(fit["intercept"] - 10) < 1
    assert insight.best_driver(law, "y", ["z", "x"])["driver"] == "x"
    found = insight.insights(law.drop("_row_id"), {"target": "y", "value": 200}, 3)
    assert len(found["surprises"]) == 3 and abs(found["counterfactual"]["required"] - 95) < 1
    assert screening.dependency_screen(law, "y", ["x", "z"])[0]["candidate"] == "x"
    assert drivers.polynomial(law, "x", "y")["degree"] == 1
    assert drivers.sparse_drivers(law, "y", ["x", "z"])["drivers"][0]["driver"] == "x"
    assert drivers.importance(law, "y", ["x", "z"])[0]["driver"] == "x"
    effect = causal.effect(law, "x", "y", ["z"], draws=40)
    assert effect["low"] <= effect["effect"] <= effect["high"]
    x = np.array([[r.x, r.y, r.z] for r in law.collect()])
    want = np.linalg.eigvalsh(np.cov(((x - x.mean(0)) / x.std(0)).T))[::-1]
    assert np.allclose([c["eigenvalue"] for c in screening.pca(law, ["x", "y", "z"])["components"]], want)


def test_regime_change(spark):
    rows = [(float(i), float(i) if i < 60 else 60 + 5.0 * (i - 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert insight.boundaries(df, "y", "x", 6, 1.0)


def test_constants_and_short_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "c double, v double")
    assert screening.partial_correlation(df, "c", "v", [])["raw"] == 0
    one = quality.distribution(df, "c").first()
    assert one["skew"] == 0 and one["std"] == 0
    assert screening.regress(df, "v", ["c", "v"]).get("error")
    assert quality.benford(df, "v").get("error")


def line_grid(spark, wraps=False):
    df = spark.createDataFrame([(i, float(10 * (i + 1)) if i != 3 else 5.0) for i in range(6) if i != 2], "i int, v double")
    return grid.build(df, ["i"], ["v"], [True], [wraps])


def test_grid_lines(spark):
    g = line_grid(spark)  # place numbers close the gap that a missing value leaves
    assert g.edges().count() == 8
    assert {r.vid: r.degree for r in grid.degrees(g).collect()} == {0: 1, 1: 2, 2: 2, 3: 2, 4: 1}
    assert paths.betti(g) == {"b0": 1, "b1": 0}
    assert paths.betti(line_grid(spark, True)) == {"b0": 1, "b1": 1}
    assert {r.vid: r.extremum for r in paths.basins(g, "v").collect()} == {0: 0, 1: 2, 2: 2, 3: 2, 4: 2}
    assert paths.geodesic(g, 0, 4)["path"] == [0, 1, 2, 3, 4]
    assert paths.trace(g, 2, "v") == [2, 3, 4]
    assert {r.vid: r.distance for r in paths.orbit(g, 0, 2).collect()} == {0: 0, 1: 1, 2: 2}
    assert paths.persistence(g, "v")[0] == {"birth": 10.0, "death": 20.0, "persistence": 10.0}


def test_grid_faces_and_parts(spark):
    rows = [(a, b, 1.0) for a in range(3) for b in range(3) if (a, b) != (1, 1)] + [(9, 9, 1.0)]
    g = grid.build(spark.createDataFrame(rows, "a int, b int, v double"), ["a", "b"], ["v"])
    one = grid.faces(g).first()
    assert (one.v, one.e, one.f) == (9, 8, 0)
    assert paths.betti(g) == {"b0": 2, "b1": 1}
    assert paths.geodesic(g, 0, 8) == {"reachable": False}
    assert paths.spectrum(g)["label"] == "disconnected"
    assert paths.product_topology(["C", "C"])["name"] == "torus"


def test_series(spark):
    r = random.Random(1)
    rows = [(i, (0.0 if i < 100 else 8.0) + r.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "t int, v double")
    found = dynamics.changepoints(df, "v", ["t"], 20, 1.5)
    assert len(found) >= 1 and abs(found[0]["at"] - 101) < 20
    v = np.array([x for _, x in rows])
    d = v - v.mean()
    acf = {x.lag: x.acf for x in dynamics.autocorrelation(df, "v", ["t"], 3).collect()}
    assert np.allclose([acf[k] for k in (1, 2, 3)], [(d[k:] * d[:-k]).sum() / (d**2).sum() for k in (1, 2, 3)])
    assert dynamics.recurrence(df, ["v"], ["t"])["rate"] > 0
    assert "tau" in dynamics.phase_space(df, "v", ["t"])


def test_series_over_all_rows(spark):
    v = np.sin(np.arange(3000) * 2 * np.pi / 22) + 1e-3 * np.arange(3000) % 7e-3
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "t int, v double")
    d = v - v.mean()
    tau = next(k for k in range(1, 1000) if (d[k:] * d[:-k]).sum() <= 0)
    assert dynamics.phase_space(df, "v", ["t"], 3)["tau"] == tau == 6  # every third row gives 2
    e = np.stack([v[:-2], v[1:-1], v[2:]], axis=1)[np.linspace(0, 2997, 500, dtype=int)]
    gap = np.sqrt(((e[:, None] - e[None]) ** 2).sum(axis=2))
    assert np.isclose(dynamics.recurrence(df, ["v"], ["t"])["threshold"], np.percentile(gap, 10))


def test_structure(spark):
    r = random.Random(2)
    rows = [(c * 10 + r.gauss(0, 1), c * 10 + r.gauss(0, 1)) for c in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert structure.cluster(df, ["a", "b"], max_k=4)["k"] == 3
    assert structure.topology(df, ["a", "b"])["trace"][-1]["b0"] == 1
    assert len(structure.sources(df, ["a", "b"])["sources"]) == 2
    assert structure.graphical_model(df, ["a", "b"])["edges"]


def test_sources_of_all_rows(spark):
    r = np.random.default_rng(5)
    a, b = r.uniform(-1, 1, 6000), r.uniform(-1, 1, 6000)
    a[::1500] = 40  # four rows in 6,000 make a heavy tail
    got = structure.sources(spark.createDataFrame(np.stack([a + 0.3 * b, b - 0.2 * a], axis=1).tolist(), "a double, b double"), ["a", "b"])
    assert got["n"] == 6000
    want = ((a - a.mean()) ** 4).mean() / a.var() ** 2 - 3
    assert abs(max(s["kurtosis"] for s in got["sources"]) / want - 1) < 0.05


def sample(n=80, word="tick"):
    r = random.Random(7)
    return json.dumps([{"ticker": f"{word}{i}", "price": r.uniform(1, 9), "vol": i, "sector": "abcde"[i % 5], "half": "xy"[i % 2], "desc": "words " * 8} for i in range(n)])


def test_catalog_and_tools(spark):
    c = catalog.Catalog(spark)
    assert c.ingest("[1]") == "[1]" and c.ingest("x" * 4000) == "x" * 3000
    text = c.ingest(sample(), "ticks")
    key = c.keys()[0]["key"]
    assert key in text and c.ingest(sample(), "ticks") and len(c.keys()) == 1
    assert c.retrieve(key, 5, 100, "vol", False)["rows"][0]["vol"] == 5
    assert c.query(key, '{"column": "vol", "op": "<", "value": 10}')["matched"] == 10
    assert "error" in c.query(key, '{"column": "vol", "op": "?", "value": 1}')
    assert c.group_by(key, ["sector"], [{"column": "vol", "func": "sum", "alias": "s"}], "s")["rows"][0] == {"sector": "e", "s": 664.0}
    assert asyncio.run(c.aaggregate(key, "vol", "mean"))["value"] == 39.5
    assert c.schema(key)["columns"]["vol"]["type"] == "numeric"
    all_tools = tools.all_tools(c)
    assert len(all_tools) == 68
    assert [len(tools.tools_of(all_tools, g)) for g in ("retrieval", "stats", "manifold", "export")] == [6, 39, 20, 3]
    assert tools.call(all_tools, "aggregate", json.dumps({"key": key, "column": "vol", "func": "max"}))["value"] == 79
    assert "error" in tools.safe_call(all_tools, "aggregate", {"key": key})
    for name, more in {"manifold_state": {}, "walk_axis": {"walk_axis": "half", "target_field": "price"}, "frontier": {"condition_a_json": '{"column": "half", "op": "=", "value": "x"}', "condition_b_json": '{"column": "half", "op": "=", "value": "y"}'}, "manifold_slice": {"condition_json": '{"column": "vol", "op": ">", "value": 20}'}, "orbit": {"center_json": '{"half": "x", "sector": "a"}', "radius": 1}}.items():
        out = tools.call(all_tools, name, {"key": key} | more)
        assert out and "error" not in out, (name, out)
    d = c.get(key)
    assert exports.export_csv(d, ["ticker", "vol"], "vol", False, 2) == "ticker,vol\ntick0,0\ntick1,1\n"
    assert exports.export_markdown(d, ["ticker", "vol"], "vol", False, 1).split("\n")[1] == "| --- | ---: |"
    assert exports.artifact(d, "jsonl", max_rows=3)["row_count"] == 3
    with pytest.raises(ValueError):
        exports.artifact(d, "xml")
    assert exports.chunks(c)[0]["id"] == key and exports.count_tokens("abcde", "anthropic") == 2


def test_adapters(spark):
    some = tools.all_tools(catalog.Catalog(spark))[:2]
    assert tools.for_provider(some, "openai", strict=True)[0]["parameters"]["additionalProperties"] is False
    assert "function" in tools.for_provider(some, "openai", "chat_completions")[0]
    assert "input_schema" in tools.for_provider(some, "anthropic", examples={"retrieve": [{"key": "k"}]})[0]
    assert tools.for_provider(some, "gemini") and tools.for_provider(some, "xai")
    with pytest.raises(ValueError):
        tools.for_provider(some, "nobody")
    assert tools.listed("a, b") == tools.listed('["a", "b"]') == ["a", "b"]


def test_interception_eviction_and_threads(spark):
    from fathom.policy import Limits

    c = catalog.Catalog(spark, Limits(datasets=3))
    catalog.use(c)

    @catalog.intercept("tool")
    def tool(n, word):
        return {"rows": json.loads(sample(n, word))}

    small = catalog.intercept("tool")(lambda: {"value": 42})
    assert small() == {"value": 42}
    with catalog.raw():
        assert isinstance(tool(100, "a"), dict)
    assert isinstance(tool(100, "a"), str) and len(c.keys()) == 1
    threads = [threading.Thread(target=lambda k=k: c.ingest(sample(60, f"w{k}"), f"t{k}")) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(c.keys()) == 3


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value", "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed(stream, "ts", "1 hour", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").count() == ingest.windowed(events, "ts", "1 hour", ["event_type"], "value").count()
    spark.createDataFrame([("a" * 20,), ("a" * 20,), ("b",)], "value string").write.text(str(tmp_path / "texts"))
    seen = []
    ingest.to_catalog(spark.readStream.text(str(tmp_path / "texts")), seen.append, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(seen) == ["a" * 20, "b"]


def test_order_without_one_task(spark):
    from fathom.operators import dynamics, order

    n = 1000
    rows = spark.createDataFrame([(float((k * 37) % n), float(k % 5)) for k in range(n)], "o double, v double").repartition(5)
    got = order.numbered(rows, ["o"]).collect()
    assert all(r.rn == r.o + 1 for r in got) and len(got) == n
    sums = {r.v: r.upto for r in order.running(rows.groupBy("v").count(), "v", "count", "upto").collect()}
    assert sums == {float(v): 200 * (v + 1) for v in range(5)}
    near = order.stretched(order.numbered(rows, ["o"]), "rn", 3, 2, stretch=10).filter("__own")
    assert near.count() == n
    assert order.numbered(rows.limit(0), ["o"]).count() == 0
    plan = dynamics.rolling(rows, "v", ["o"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "[__b" in plan and "Window" in plan


def test_windows_across_stretches(spark, monkeypatch):
    from fathom.operators import dynamics, order

    values = np.random.default_rng(2).normal(size=300)
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double").repartition(4)
    monkeypatch.setattr(order.stretched, "__defaults__", (20,))
    got = {r.rn: r.mean for r in dynamics.rolling(rows, "v", ["k"], 9).collect()}
    assert got.keys() == set(range(1, 293))
    assert all(abs(got[k + 1] - values[k : k + 9].mean()) < 1e-9 for k in range(292))


def test_long_answers_say_so(spark):
    from fathom.plans import tools

    short = spark.range(5)
    assert tools.answer(short) == [{"id": k} for k in range(5)]
    out = tools.answer(spark.range(1000).selectExpr("id + 1 AS rn"), 100)
    assert out["total"] == 1000 and out["truncated"] and [r["rn"] for r in out["rows"]] == list(range(1, 1001, 10))


def test_series_summaries(spark):
    n = 400
    r = np.random.default_rng(4)
    wave = np.sin(np.arange(n) * 2 * np.pi / 8) + r.normal(scale=0.1, size=n)
    other = np.concatenate([[0.0], wave[:-1]]) + r.normal(scale=0.05, size=n)  # follows the wave
    noise = r.normal(size=n)
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(wave, other, noise, strict=True))], "k int, wave double, other double, noise double").repartition(3)
    acf = dynamics.acf_summary(df, "wave", ["k"])
    assert acf["period"] == 8 and 8 in acf["significant"] and acf["stationary"]
    got = dynamics.rolling_summary(df, "wave", ["k"], 15, "noise").first()
    seg = lambda x: np.lib.stride_tricks.sliding_window_view(x, 15)
    std, mean = seg(wave).std(axis=1), seg(wave).mean(axis=1)
    d = std - std.mean()
    corr = np.array([np.corrcoef(a, b)[0, 1] for a, b in zip(seg(wave), seg(noise), strict=True)])
    assert got.windows == n - 14
    assert got.trend_slope == pytest.approx(np.polyfit(np.arange(n - 14), mean, 1)[0], abs=1e-9)
    assert got.volatility == pytest.approx((d[1:] * d[:-1]).sum() / len(d) / d.var(), abs=1e-9)
    assert got.sign_changes == int((corr[1:] * corr[:-1] < 0).sum())
    out = causal.transfer_summary(df, "wave", "other", ["k"], 3, 4, 20)
    assert out["best_lag"] == 1 and out["p_value"] == 0 and out["direction"] == "wave -> other"
    chance = causal.transfer_significance(df, "noise", "wave", ["k"], 1, 4, 20).first()
    assert 0.05 <= chance.p_value <= 1
    assert chance.observed == pytest.approx(causal.transfer_entropy(df, "noise", "wave", ["k"], 1, 4).first().te_forward)


def test_typed_columns(spark):
    from fathom.sources.catalog import Catalog

    rows = [{"day": f"2024-01-{d:02d}", "shop": s, "price": f"{d * 1.5:.2f}", "note": f"n{d}{s}"} for d in range(1, 21) for s in "abcd"]
    c = Catalog(spark)
    c.ingest(json.dumps(rows) + " " * 3000, "sales")
    (d,) = c.datasets.values()
    kinds = dict(d.typed().dtypes)
    assert kinds["day"] == "date" and kinds["price"] == "double" and kinds["shop"] == "string"
    assert dict(d.frame.dtypes)["price"] == "string"  # rows come back as they were
    g = d.grid()
    assert "day" in g.axes and g.ordered[g.axes.index("day")] and "price" in g.fields
    day, shop = 19 * 4 * 2, 20 * 4 * 3  # a path of days for each shop, a clique of shops on each day
    assert g.edges().count() == day + shop
