"""Queries over the star-schema tables, each with the SQL that must give the same rows. Results are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import coerce, predicate
from fathom.operators import causal, dependency, drivers, dynamics, grid, insight, laws, moments, paths, profile, quality, relational, screening, structure
from fathom.plans import exports
from fathom.sources import payload
from fathom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(source: str, sql: str | None = None, name: str | None = None):
    """Register a function of one table, with its SQL."""

    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(table(spark, sf_dir, source))
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def one_row(df: DataFrame, values: dict) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values.values())], list(values))


# aggregates

for _func, _sql in {"sum": "sum({c})", "mean": "avg({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})", "std": "stddev_pop({c})", "count": "count({c})", "count_distinct": "count(DISTINCT {c})"}.items():
    query("lineitem", f"SELECT l_returnflag, {'round(' if _func not in ('count', 'count_distinct') else 'CAST('}{_sql.format(c='l_extendedprice')}{', 6)' if _func not in ('count', 'count_distinct') else ' AS BIGINT)'} AS value FROM lineitem GROUP BY l_returnflag", f"agg_{_func}")(
        lambda df, f=_func: rounded(df.groupBy("l_returnflag").agg(relational.aggregate(df, "l_extendedprice", f).alias("value")))
    )

FLAGSHIP = [{"column": "l_extendedprice", "func": "sum", "alias": "sum_price"}, {"column": "l_quantity", "func": "mean", "alias": "mean_qty"}, {"column": "l_discount", "func": "std", "alias": "std_disc"}, {"column": "l_tax", "func": "median", "alias": "median_tax"}, {"column": "l_orderkey", "func": "count", "alias": "n"}, {"column": "l_shipdate", "func": "count_distinct", "alias": "n_dates"}]


@query("lineitem", """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 4) sum_price, round(avg(l_quantity), 4) mean_qty, round(stddev_pop(l_discount), 4) std_disc, round(median(l_tax), 4) median_tax,
  count(l_orderkey) n, count(DISTINCT l_shipdate) n_dates FROM lineitem WHERE l_quantity > 10 AND l_returnflag IN ('A', 'R') GROUP BY l_returnflag, l_linestatus""")
def group_by(df):
    found = predicate.where(df, {"and": [{"column": "l_quantity", "op": ">", "value": 10}, {"column": "l_returnflag", "op": "in", "value": ["A", "R"]}]})
    return rounded(relational.group(found, ["l_returnflag", "l_linestatus"], FLAGSHIP, "sum_price"), 4)


@query("orders", "SELECT o_custkey, round(sum(o_totalprice), 4) total, count(o_orderkey) n FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20")
def group_topk(df):
    return rounded(relational.group(df, ["o_custkey"], [{"column": "o_totalprice", "func": "sum", "alias": "total"}, {"column": "o_orderkey", "func": "count", "alias": "n"}], "total", True, 20), 4)


# predicates, over a column with nulls put in

_NULLED = "(SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END v, CASE WHEN event_id % 5 <> 0 THEN event_type END t FROM events)"


def _nulled(df: DataFrame) -> DataFrame:
    return df.withColumns({"v": F.when(F.col("event_id") % 7 != 0, F.col("value")), "t": F.when(F.col("event_id") % 5 != 0, F.col("event_type"))})


_PREDICATES = {
    "pred_eq": ({"column": "t", "op": "=", "value": "click"}, "t = 'click'"),
    "pred_eq_null": ({"column": "t", "op": "=", "value": None}, "t IS NULL"),
    "pred_ne_null": ({"column": "t", "op": "!=", "value": "click"}, "t IS DISTINCT FROM 'click'"),
    "pred_gt": ({"column": "v", "op": ">", "value": "$20"}, "v > 20"),
    "pred_ge": ({"column": "v", "op": ">=", "value": 20}, "v >= 20"),
    "pred_lt": ({"column": "v", "op": "<", "value": 20}, "v < 20"),
    "pred_le": ({"column": "v", "op": "<=", "value": 20}, "v <= 20"),
    "pred_contains": ({"column": "t", "op": "contains", "value": "LI"}, "contains(lower(t), 'li')"),
    "pred_in": ({"column": "t", "op": "in", "value": ["click", None]}, "t = 'click' OR t IS NULL"),
    "pred_not_in": ({"column": "t", "op": "not_in", "value": ["click", "view"]}, "t IS NULL OR t NOT IN ('click', 'view')"),
    "pred_nested": ({"or": [{"and": [{"column": "v", "op": ">", "value": 50}, {"column": "t", "op": "!=", "value": "click"}]}, {"column": "user_id", "op": "in", "value": [1, 2, 3]}]}, "(v > 50 AND t IS DISTINCT FROM 'click') OR user_id IN (1, 2, 3)"),
    "pred_empty_and": ({"and": []}, "true"),
    "pred_empty_or": ({"or": []}, "false"),
    "pred_unknown_column": ({"column": "nowhere", "op": "=", "value": None}, "true"),
}
for _name, (_node, _where) in _PREDICATES.items():
    query("events", f"SELECT event_id, t, round(v, 6) v FROM {_NULLED} WHERE {_where}", _name)(lambda df, node=_node: rounded(predicate.where(_nulled(df), node).select("event_id", "t", "v")))


@query("events", f"SELECT event_id FROM {_NULLED} WHERE abs(v - 10) >= 1e-9")
def slice_filter_eps(df):
    return predicate.slice_rows(_nulled(df), "v", "!=", 10).select("event_id")


# pages

query("customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10", "page_sort_desc")(lambda df: relational.page(df, 10, 25, "c_acctbal", True, ["c_custkey", "c_acctbal"], ["c_custkey"]))
query("events", f"SELECT event_id, round(v, 6) v FROM {_NULLED} ORDER BY v ASC NULLS LAST, event_id LIMIT 50", "page_sort_asc_nulls")(lambda df: rounded(relational.page(_nulled(df), 0, 100, "v", False, ["event_id", "v"], ["event_id"])))
query("events", f"SELECT event_id, round(v, 6) v FROM {_NULLED} ORDER BY v DESC NULLS FIRST, event_id LIMIT 50", "page_sort_desc_nulls")(lambda df: rounded(relational.page(_nulled(df), 0, 50, "v", True, ["event_id", "v"], ["event_id"])))
query("events", f"SELECT event_id, t FROM {_NULLED} ORDER BY coalesce(t, 'None'), event_id LIMIT 50", "page_sort_text")(lambda df: relational.page(_nulled(df), 0, 50, "t", False, ["event_id", "t"], ["event_id"]))
query("events", f"SELECT event_id, user_id FROM {_NULLED} WHERE v > 30 ORDER BY user_id DESC, event_id LIMIT 25", "query_rows")(lambda df: relational.query(_nulled(df), '{"column": "v", "op": ">", "value": 30}', "user_id", True, 25, ["event_id", "user_id"], ["event_id"]))

# JSON and coercion

query("events", "SELECT event_id, TRY_CAST(props->>'k' AS INTEGER) k FROM events", "json_flatten_props")(lambda df: payload.json_fields(df, "props", {"k": "int"}).select("event_id", F.col("`props.k`").alias("k")))
query("events", "SELECT event_id, unnest([event_id % 3, event_id % 4]) a FROM events", "json_explode")(lambda df: payload.explode_json(df.withColumn("items", F.to_json(F.array(F.struct((F.col("event_id") % 3).alias("a")), F.struct((F.col("event_id") % 4).alias("a"))))), "items", "struct<a: bigint>").select("event_id", F.col("`items.item`.a").alias("a")))
query("part", "SELECT p_partkey, p_retailprice p FROM part", "coerce_currency")(lambda df: df.select("p_partkey", F.round(coerce.permissive(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)), df.schema["p_name"].dataType), 2).alias("p")))
ORACLES["coerce_currency"] = "SELECT p_partkey, round(round(p_retailprice, 2), 2) p FROM part"
query("orders", "SELECT DISTINCT sha256(o_orderpriority) fingerprint FROM orders", "fingerprint_dedup")(lambda df: ingest.distinct_payloads(df, "o_orderpriority").select("fingerprint"))

# profiles

query("orders", "SELECT count(*) n, CAST(0 AS BIGINT) nulls, count(DISTINCT o_totalprice) unique_count, round(min(o_totalprice), 4) min, round(max(o_totalprice), 4) max, round(avg(o_totalprice), 4) mean, round(median(o_totalprice), 4) median, round(stddev_pop(o_totalprice), 4) std FROM orders", "profile_numeric")(lambda df: rounded(profile.column_stats(df, "o_totalprice"), 4))
query("part", "SELECT p_brand value, count(*) n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5", "profile_string_topk")(lambda df: profile.top_values(df, "p_brand"))
query("part", "SELECT round(entropy(p_brand), 6) entropy FROM part", "profile_entropy")(lambda df: rounded(profile.value_entropy(df, "p_brand")))
query("orders", """SELECT * FROM (SELECT 'o_orderkey' "column", 'numeric' kind, count(o_orderkey) n FROM orders UNION ALL SELECT 'o_custkey', 'numeric', count(o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', CASE WHEN upper(o_orderstatus) = 'F' THEN 'bool' ELSE 'string' END, count(*) FROM orders GROUP BY 1, 2
  UNION ALL SELECT 'o_totalprice', 'numeric', count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', 'datetime', count(o_orderdate) FROM orders UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM orders)""", "column_kinds")(profile.kind_counts)

# distributions

_MOMENTS = "WITH m AS (SELECT count(l_extendedprice) n, avg(l_extendedprice) mu, stddev_pop(l_extendedprice) s FROM lineitem)"
query("lineitem", _MOMENTS + """, z AS (SELECT avg(power((l_extendedprice - mu) / s, 3)) skew, avg(power((l_extendedprice - mu) / s, 4)) - 3 kurtosis FROM lineitem, m)
  SELECT n, round(mu, 4) mean, round(s, 4) std, round(skew, 4) skew, round(kurtosis, 4) kurtosis FROM m, z""", "dist_moments")(lambda df: rounded(quality.distribution(df, "l_extendedprice").select("n", "mean", "std", "skew", "kurtosis"), 4))
query("lineitem", "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) p{round(q * 100)}" for q in quality.QUANTILES) + " FROM lineitem", "dist_quantiles")(lambda df: rounded(quality.distribution(df, "l_extendedprice").select(*[f"p{round(q * 100)}" for q in quality.QUANTILES]), 4))
query("lineitem", "WITH e AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 15)), 14) AS INTEGER) bin, count(*) \"count\" FROM lineitem, e GROUP BY 1", "dist_histogram")(lambda df: quality.histogram(df, "l_extendedprice"))
query("orders", """WITH s AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s, quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b FROM orders),
  o AS (SELECT o_orderkey, abs((o_totalprice - m) / s) z, o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a) f FROM orders, s)
  SELECT o_orderkey, round(z, 6) severity, 1 n_fields FROM o WHERE z > 1.7 OR f ORDER BY z DESC, o_orderkey LIMIT 50""", "outlier_rows")(lambda df: rounded(quality.outliers(df, ["o_totalprice"], "both", 1.7, "o_orderkey")))
query("orders", "SELECT CAST(substr(replace(replace(CAST(CAST(abs(o_totalprice) AS DECIMAL(18, 6)) AS VARCHAR), '.', ''), '-', ''), 1 + length(replace(CAST(CAST(abs(o_totalprice) AS DECIMAL(18, 6)) AS VARCHAR), '.', '')) - length(ltrim(replace(CAST(CAST(abs(o_totalprice) AS DECIMAL(18, 6)) AS VARCHAR), '.', ''), '0')), 1) AS INTEGER) digit, count(*) n FROM orders WHERE o_totalprice <> 0 GROUP BY 1", "benford_digits")(lambda df: quality.first_digits(df, "o_totalprice").select("digit", "n"))

# regression

_L = "l_extendedprice IS NOT NULL"
query("lineitem", f"SELECT count(*) n, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_r2(l_extendedprice, l_quantity), 6) r2 FROM lineitem WHERE {_L}", "regress_1")(
    lambda df: (lambda r: one_row(df, {"n": r["n"], "intercept": round(r["intercept"], 4), "slope": round(r["drivers"][0]["coefficient"], 4), "r2": round(r["r2"], 6)}))(screening.regress(df, "l_extendedprice", ["l_quantity"]))
)
_C2 = "WITH c AS (SELECT var_pop(l_quantity) a, covar_pop(l_quantity, l_discount) b, var_pop(l_discount) d, covar_pop(l_quantity, l_extendedprice) p, covar_pop(l_discount, l_extendedprice) q, var_pop(l_extendedprice) v FROM lineitem), "
query("lineitem", _C2 + "k AS (SELECT (p * d - q * b) / (a * d - b * b) b1, (q * a - p * b) / (a * d - b * b) b2, p, q, v FROM c) SELECT round(b1, 4) b1, round(b2, 4) b2, round((b1 * p + b2 * q) / v, 6) r2 FROM k", "regress_2")(
    lambda df: (lambda m: one_row(df, {"b1": round(float(m.fit("l_extendedprice", ["l_quantity", "l_discount"])[1][0]), 4), "b2": round(float(m.fit("l_extendedprice", ["l_quantity", "l_discount"])[1][1]), 4), "r2": round(m.fit("l_extendedprice", ["l_quantity", "l_discount"])[2], 6)}))(moments.moments(df, ["l_extendedprice", "l_quantity", "l_discount"]))
)
query("lineitem", "WITH c AS (SELECT corr(l_extendedprice, l_quantity) ab, corr(l_extendedprice, l_discount) ac, corr(l_quantity, l_discount) bc FROM lineitem) SELECT round(ab, 6) raw, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) \"partial\" FROM c", "partial_1")(
    lambda df: (lambda r: one_row(df, {"raw": round(r["raw"], 6), "partial": round(r["partial"], 6)}))(screening.partial_correlation(df, "l_extendedprice", "l_quantity", ["l_discount"]))
)
query("lineitem", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' candidate, round(corr(l_extendedprice, {c}), 6) raw, round(0.8 * abs(corr(l_extendedprice, {c})) + 0.2 * least(abs(regr_slope(l_extendedprice, {c})), 1), 6) score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")", "dep_screen")(
    lambda df: df.sparkSession.createDataFrame([(r["candidate"], round(r["raw"], 6), round(r["score"], 6)) for r in screening.dependency_screen(df, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])], "candidate string, raw double, score double")
)
query("orders", "SELECT o_orderkey, round(-abs(o_totalprice - 150000), 4) score FROM orders WHERE o_orderstatus = 'O' ORDER BY abs(o_totalprice - 150000), o_orderkey LIMIT 5", "solver_topk")(lambda df: rounded(screening.solve(df, "o_totalprice", {"mode": "hit_target", "target": 150000}, [{"column": "o_orderstatus", "op": "=", "value": "O"}], 5, ["o_orderkey"]).select("o_orderkey", "score"), 4))
query("lineitem", "SELECT round(1 / (1 - power(corr(l_quantity, l_extendedprice), 2)), 6) vif FROM lineitem", "vif_2")(lambda df: one_row(df, {"vif": round(quality.vif(df, ["l_quantity", "l_extendedprice"])[0]["vif"], 6)}))
query("lineitem", "SELECT * FROM (SELECT 1 + abs(corr(l_quantity, l_extendedprice)) e, count(*) n FROM lineitem) t", "pca_2")(lambda df: one_row(df, {"eigenvalue": round(screening.pca(df, ["l_quantity", "l_extendedprice"])["components"][0]["eigenvalue"], 6)}))
ORACLES["pca_2"] = "SELECT round((1 + abs(corr(l_quantity, l_extendedprice))) * count(*) / (count(*) - 1), 6) eigenvalue FROM lineitem"

# dependence

_RANKS = "r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 b FROM lineitem)"
query("lineitem", f"WITH {_RANKS} SELECT 'l_quantity' field_a, 'l_extendedprice' field_b, (SELECT round(corr(l_quantity, l_extendedprice), 6) FROM lineitem) pearson, (SELECT round(corr(a, b), 6) FROM r) spearman", "spearman_pairs")(lambda df: rounded(dependency.rank_correlations(df, ["l_quantity", "l_extendedprice"]).select("field_a", "field_b", "pearson", "spearman")))
query("lineitem", f"WITH {_RANKS}, n AS (SELECT count(*) n FROM r) SELECT t threshold, round(count(*) FILTER (a / (n + 1) <= t AND b / (n + 1) <= t) / (max(n) * t), 6) lower, round(count(*) FILTER (a / (n + 1) > 1 - t AND b / (n + 1) > 1 - t) / (max(n) * t), 6) upper FROM r, n, unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE]) u(t) GROUP BY t", "copula_tail")(lambda df: rounded(dependency.tail_dependence(df, "l_quantity", "l_extendedprice")))
query("events", "WITH r AS (SELECT row_number() OVER (ORDER BY ts, event_id) i, value v, user_id u FROM events) SELECT count(*) FILTER ((a.v - b.v) * (a.u - b.u) > 0) concordant, count(*) FILTER ((a.v - b.v) * (a.u - b.u) < 0) discordant FROM r a JOIN r b ON b.i > a.i AND b.i < a.i + 500", "kendall_band")(lambda df: dependency.banded_kendall(df, "value", "user_id", ["ts", "event_id"]).select("concordant", "discordant"))
query("orders", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) o FROM orders GROUP BY 1, 2), r AS (SELECT o_orderstatus, count(*) r FROM orders GROUP BY 1), k AS (SELECT o_orderpriority, count(*) k FROM orders GROUP BY 1) SELECT o_orderstatus, o_orderpriority, coalesce(o, 0) observed, round(r * k / (SELECT count(*) FROM orders)::DOUBLE, 6) expected FROM r CROSS JOIN k LEFT JOIN c USING (o_orderstatus, o_orderpriority)", "chi2_table")(lambda df: rounded(dependency.contingency(df, "o_orderstatus", "o_orderpriority")))
query("orders", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) o FROM orders GROUP BY 1, 2), r AS (SELECT o_orderstatus, count(*) r FROM orders GROUP BY 1), k AS (SELECT o_orderpriority, count(*) k FROM orders GROUP BY 1), x AS (SELECT coalesce(o, 0) o, r * k / (SELECT count(*) FROM orders)::DOUBLE e FROM r CROSS JOIN k LEFT JOIN c USING (o_orderstatus, o_orderpriority)), t AS (SELECT sum((o - e) * (o - e) / e) chi2, CAST(sum(o) AS BIGINT) n, (SELECT count(*) FROM r) a, (SELECT count(*) FROM k) b FROM x) SELECT n, round(chi2, 6) chi2, (a - 1) * (b - 1) dof, round(sqrt(chi2 / (n * least(a - 1, b - 1))), 6) cramers_v FROM t", "chi2_value")(
    lambda df: (lambda r: one_row(df, {"n": r["n"], "chi2": round(r["chi2"], 6), "dof": r["dof"], "cramers_v": round(r["cramers_v"], 6)}))(dependency.chi_squared(df, "o_orderstatus", "o_orderpriority"))
)
query("orders", "WITH g AS (SELECT o_orderpriority, count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) v FROM orders GROUP BY 1), t AS (SELECT count(*) k, sum(n) n, sum(n * m) s, sum(n * m * m) q, sum(n * v) w FROM g) SELECT round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 4) f FROM t", "anova_f")(lambda df: one_row(df, {"f": round(dependency.anova(df, "o_orderpriority", "o_totalprice")["f"], 4)}))
query("orders", "SELECT o_orderpriority \"group\", count(*) n, round(avg(o_totalprice), 4) mean, round(stddev_pop(o_totalprice), 4) std FROM orders GROUP BY 1 HAVING count(*) >= 2", "anova_groups")(lambda df: rounded(dependency.anova_groups(df, "o_orderpriority", "o_totalprice"), 4))


def _bucket_sql(column: str, source: str, bins: int, alias: str) -> str:
    """A bucket by nearest-rank edges (half-even positions), as SQL over a numbered source."""
    edge = lambda b: f"(SELECT v FROM (SELECT {column} v, row_number() OVER (ORDER BY {column}) - 1 p FROM {source} WHERE {column} IS NOT NULL) WHERE p = round_even((SELECT count({column}) - 1 FROM {source}) * {b} / {bins}.0, 0))"
    return "CASE " + " ".join(f"WHEN {column} <= {edge(b + 1)} THEN {b}" for b in range(bins - 1)) + f" ELSE {bins - 1} END {alias}"


query("events", f"WITH b AS (SELECT {_bucket_sql('value', 'events', 4, 'x')}, {_bucket_sql('user_id', 'events', 4, 'y')} FROM events), c AS (SELECT x, y, count(*) m FROM b GROUP BY 1, 2), s AS (SELECT m, sum(m) OVER (PARTITION BY x) mx, sum(m) OVER (PARTITION BY y) my, sum(m) OVER () t FROM c) SELECT 'value' field_a, 'user_id' field_b, round(sum(m / t * ln(m * t / (mx * my))), 6) mi FROM s", "mi_pairs")(lambda df: rounded(dependency.mutual_information(df, ["value", "user_id"], 4).select("field_a", "field_b", "mi")))
query("events", f"WITH b AS (SELECT {_bucket_sql('value', 'events', 5, 'bucket')}, user_id FROM events) SELECT bucket, count(*) n, round(avg(user_id), 6) mean FROM b GROUP BY 1", "regime_buckets")(lambda df: rounded(insight.regimes(df, "user_id", "value", 5).select("bucket", "n", "mean")))

# drivers, causes

query("lineitem", "SELECT round(regr_r2(l_extendedprice, l_quantity), 6) r2 FROM lineitem", "poly_deg1")(lambda df: one_row(df, {"r2": round(drivers.polynomial(df, "l_quantity", "l_extendedprice", 1)["r2"][0], 6)}))
query("lineitem", "SELECT round(regr_r2(l_extendedprice, l_quantity), 6) r2_a, round(regr_r2(l_extendedprice, l_discount), 6) r2_b FROM lineitem", "interaction_r2")(lambda df: (lambda r: one_row(df, {"r2_a": round(r["r2_a"], 6), "r2_b": round(r["r2_b"], 6)}))(drivers.interactions(df, "l_extendedprice", ["l_quantity", "l_discount"])[0]))
query("lineitem", _C2 + "k AS (SELECT (p * d - q * b) / (a * d - b * b) b1, (q * a - p * b) / (a * d - b * b) b2, p, q, v, a, d FROM c) SELECT round((b1 * p + b2 * q) / v - q * q / (d * v), 6) quantity, round((b1 * p + b2 * q) / v - p * p / (a * v), 6) discount FROM k", "importance_2")(
    lambda df: (lambda r: one_row(df, {"quantity": round(r["l_quantity"], 6) + 0.0, "discount": round(r["l_discount"], 6) + 0.0}))({x["driver"]: x["importance"] for x in drivers.importance(df, "l_extendedprice", ["l_quantity", "l_discount"])})
)
query("lineitem", _C2 + "k AS (SELECT (p * d - q * b) / (a * d - b * b) b1, p / a naive FROM c) SELECT round(b1, 4) effect, round(naive, 4) naive FROM k", "ate_1")(lambda df: (lambda r: one_row(df, {"effect": round(r["effect"], 4), "naive": round(r["naive"], 4)}))(causal.effect(df, "l_quantity", "l_extendedprice", ["l_discount"], draws=20)))
query("events", f"WITH r AS (SELECT row_number() OVER (ORDER BY ts, event_id) i, {_bucket_sql('value', 'events', 3, 'x')}, {_bucket_sql('user_id', 'events', 3, 'y')} FROM events), l AS (SELECT y future, lag(y) OVER (ORDER BY i) past, lag(x) OVER (ORDER BY i) driver FROM r) SELECT future, past, driver, count(*) m FROM l WHERE past IS NOT NULL GROUP BY 1, 2, 3", "te_lag")(lambda df: causal.transfer_counts(df, "value", "user_id", ["ts", "event_id"], 1, 3))

# series

_SERIES = "WITH r AS (SELECT row_number() OVER (ORDER BY ts, event_id) rn, value v FROM events)"
query("events", _SERIES + ", s AS (SELECT avg(v) mu, var_pop(v) va, count(*) n FROM r) SELECT CAST(k AS INTEGER) lag, round(sum((a.v - mu) * (b.v - mu)) / (max(n) * max(va)), 6) acf FROM r a, s, unnest(range(1, 6)) u(k) JOIN r b ON b.rn = a.rn - k GROUP BY k", "acf")(lambda df: rounded(dynamics.autocorrelation(df, "value", ["ts", "event_id"], 5).select("lag", "acf")))
ORACLES["acf"] = _SERIES + ", s AS (SELECT avg(v) mu, var_pop(v) va, count(*) n FROM r), k AS (SELECT unnest(range(1, 6)) k) SELECT CAST(k AS INTEGER) lag, round(sum((a.v - mu) * (b.v - mu)) / (max(n) * max(va)), 6) acf FROM r a CROSS JOIN s CROSS JOIN k JOIN r b ON b.rn = a.rn - k GROUP BY k"
query("events", _SERIES + ", w AS (SELECT rn, avg(v) OVER (ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) b, avg(v) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) a, (SELECT stddev_pop(v) FROM r) s FROM r) SELECT CAST(rn AS INTEGER) rn, round(abs(a - b) / s, 6) z FROM w WHERE rn > 10 AND rn <= (SELECT count(*) FROM r) - 9 AND abs(a - b) / s > 1.0", "changepoint_candidates")(lambda df: rounded(dynamics.changepoint_candidates(df, "value", ["ts", "event_id"], 10, 1.0).select("rn", "z")))
query("events", _SERIES + ", w AS (SELECT rn, avg(v) OVER w m, stddev_pop(v) OVER w s, min(v) OVER w lo, max(v) OVER w hi, count(*) OVER w n FROM r WINDOW w AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT CAST(rn AS INTEGER) rn, round(m, 5) mean, round(s, 5) std, round(lo, 5) \"min\", round(hi, 5) \"max\" FROM w WHERE n = 20", "rolling")(lambda df: rounded(dynamics.rolling(df, "value", ["ts", "event_id"]), 5))
query("events", _SERIES + ", w AS (SELECT k, rn, avg(v) OVER (PARTITION BY k ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) m FROM r, (SELECT 10 k)) SELECT 10 \"window\", count(*) chunks, round(stddev_pop(m), 6) spread FROM w WHERE rn <= (SELECT count(*) FROM r) - 9 AND (rn - 1) % 5 = 0", "ergodicity_chunks")(lambda df: rounded(dynamics.ergodicity(df, "value", ["ts", "event_id"], [10])))
query("events", _SERIES + ", b AS (SELECT (rn - 1) // 2 b, avg(v) v, count(*) m FROM r GROUP BY 1) SELECT count(*) n, round(stddev_pop(v), 6) std FROM b WHERE m = 2", "renorm_flow")(lambda df: rounded(laws.renormalized(df, ["value"], ["ts", "event_id"], 2).agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std"))))
query("events", "WITH d AS (SELECT value v, value - lag(value) OVER (ORDER BY ts, event_id) d FROM events), m AS (SELECT avg(v) mu, stddev_pop(v) s FROM d) SELECT 'value' field, round(stddev_pop(d) / avg(abs(d)), 6) translation, round(avg(power((v - mu) / s, 3)), 6) skew FROM d, m", "symmetry_diff")(lambda df: rounded(laws.symmetry(df, ["value"], ["ts", "event_id"]).select("field", "translation", "skew")))
query("events", _SERIES + ", b AS (SELECT (rn - 1) // 8 k, avg(v) v, count(*) m FROM r GROUP BY 1), c AS (SELECT k, v FROM b WHERE m = 8), t AS (SELECT k, v x0, lead(v, 1) OVER (ORDER BY k) x1, lead(v, 2) OVER (ORDER BY k) x2, (SELECT 0.15 * stddev_pop(v) FROM c) r FROM c), u AS (SELECT * FROM t WHERE x2 IS NOT NULL) SELECT count(*) b, count(*) FILTER (abs(p.x2 - q.x2) <= p.r) a FROM u p JOIN u q ON q.k > p.k AND abs(p.x0 - q.x0) <= p.r AND abs(p.x1 - q.x1) <= p.r", "sampen_coarse")(lambda df: dynamics.sample_entropy(df, "value", ["ts", "event_id"], 8).filter("scale = 8").select("b", "a"))

query("events", _SERIES + ", w AS (SELECT rn, avg(v) OVER w m, stddev_pop(v) OVER w s, count(*) OVER w n FROM r WINDOW w AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), f AS (SELECT * FROM w WHERE n = 20), g AS (SELECT avg(s) a, var_pop(s) va, count(*) c, regr_slope(m, rn) b FROM f), h AS (SELECT s, lag(s) OVER (ORDER BY rn) p FROM f) SELECT c windows, round(max(b), 6) trend_slope, round(sum((s - a) * (p - a)) / (c * max(va)), 6) volatility FROM h, g WHERE p IS NOT NULL GROUP BY c", "rolling_summary")(
    lambda df: dynamics.rolling_summary(df, "value", ["ts", "event_id"]).select("windows", F.round("trend_slope", 6).alias("trend_slope"), F.round("volatility", 6).alias("volatility"))
)
query("lineitem", "WITH a AS (SELECT row_number() OVER (ORDER BY l_discount) k, CAST(l_discount AS DOUBLE) x FROM lineitem), b AS (SELECT row_number() OVER (ORDER BY l_tax) k, CAST(l_tax AS DOUBLE) y FROM lineitem) SELECT 'l_discount' field_a, 'l_tax' field_b, round(max(abs(x - y)) / greatest(max(abs(x)), max(abs(y))), 6) distance, max(abs(x - y)) / greatest(max(abs(x)), max(abs(y))) < 0.1 exchangeable FROM a JOIN b USING (k)", "symmetry_permutation")(
    lambda df: laws.exchangeable(df, ["l_discount", "l_tax"]).withColumn("distance", F.round("distance", 6))
)

# insights

query("lineitem", " UNION ALL ".join(f"SELECT '{d}' driver, count(*) n, round(regr_slope(l_extendedprice, {d}), 4) slope, round(regr_r2(l_extendedprice, {d}), 6) r2 FROM lineitem" for d in ("l_quantity", "l_discount", "l_tax")), "driver_fit")(lambda df: insight.driver_fits(df, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("driver", "n", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2")))
query("lineitem", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) m, regr_intercept(l_extendedprice, l_quantity) b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - (m * l_quantity + b), 4) residual FROM lineitem, f ORDER BY abs(l_extendedprice - (m * l_quantity + b)) DESC, 1, 2, 3, 4 LIMIT 5", "surprises")(
    lambda df: (lambda b: rounded(insight.surprises(df, "l_extendedprice", "l_quantity", b["slope"], b["intercept"], 5, LINE_KEY).select(*LINE_KEY, "residual"), 4))(insight.best_driver(df, "l_extendedprice", ["l_quantity"]))
)
query("events", f"WITH b AS (SELECT {_bucket_sql('value', 'events', 4, 'bucket')}, user_id FROM events) SELECT bucket, count(*) n, round((max(user_id) - min(user_id)) / abs(avg(user_id)), 6) divergence FROM b GROUP BY 1", "branch_spread")(lambda df: rounded(insight.branch_spread(df, "value", ["user_id"])))

# grid: orders by status and priority (categorical), line items by flag (categorical) and line number (ordered)


def _orders_grid(df: DataFrame) -> grid.Grid:
    return grid.build(df, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])


def _lines_grid(df: DataFrame) -> grid.Grid:
    return grid.build(df, ["l_returnflag", "l_linenumber"], ["l_extendedprice", "l_discount"], [False, True])


_OV = "v AS (SELECT o_orderstatus s, o_orderpriority p, avg(o_totalprice) x, count(*) density FROM orders GROUP BY 1, 2)"
_OE = "e AS (SELECT a.s s, a.p p, a.x x, b.s s2, b.p p2, b.x y FROM v a JOIN v b ON (a.s = b.s) <> (a.p = b.p))"
_LV = "v AS (SELECT l_returnflag f, l_linenumber n, avg(l_extendedprice) x, avg(l_discount) y, count(*) density, row_number() OVER (ORDER BY l_returnflag, l_linenumber) - 1 vid FROM lineitem GROUP BY 1, 2), ranks AS (SELECT n, row_number() OVER (ORDER BY n) r FROM (SELECT DISTINCT n FROM v))"
_LE = "w AS (SELECT v.*, r FROM v JOIN ranks USING (n)), e AS (SELECT a.vid src, b.vid dst, a.x x, b.x x2, a.y y, b.y y2 FROM w a JOIN w b ON (a.f = b.f AND abs(a.r - b.r) = 1) OR (a.n = b.n AND a.f <> b.f))"
query("orders", f"WITH {_OV} SELECT s, p, round(x, 4) x, density FROM v", "grid_vertices")(lambda df: rounded(_orders_grid(df).vertices.select(F.col("a0").alias("s"), F.col("a1").alias("p"), F.col("o_totalprice").alias("x"), "density"), 4))
query("lineitem", f"WITH {_LV}, {_LE} SELECT CAST(src AS INTEGER) src, CAST(dst AS INTEGER) dst FROM e", "grid_edges")(lambda df: _lines_grid(df).edges().select("src", "dst"))
query("orders", f"WITH {_OV}, {_OE}, m AS (SELECT s, p, max(x) x, avg(y) y FROM e GROUP BY 1, 2) SELECT s, p, round(abs(x - y) / greatest(abs(y), 1), 6) curvature FROM m", "grid_curvature")(lambda df: (lambda g: rounded(grid.curvature(g).join(g.vertices, "vid").select(F.col("a0").alias("s"), F.col("a1").alias("p"), "curvature")))(_orders_grid(df)))
query("lineitem", f"WITH {_LV}, {_LE}, d AS (SELECT src, count(DISTINCT dst) k FROM e GROUP BY 1) SELECT CAST(e.src AS INTEGER) vid, round(avg(4 - a.k - b.k), 6) ricci FROM e JOIN d a ON a.src = e.src JOIN d b ON b.src = e.dst GROUP BY 1", "grid_ricci")(lambda df: rounded(grid.ricci(_lines_grid(df))))
query("lineitem", f"WITH {_LV}, {_LE} SELECT CAST(src AS INTEGER) vid, count(*) FILTER (x2 > x + 1e-12) above, count(*) FILTER (x2 < x - 1e-12) below FROM e GROUP BY 1", "grid_morse")(lambda df: grid.morse(_lines_grid(df), "l_extendedprice").select("vid", "above", "below"))
query("lineitem", f"WITH {_LV}, {_LE} SELECT count(*) n, round(avg((x2 - x) * (y2 - y)) / avg(abs((x2 - x) * (y2 - y))), 5) interaction FROM e", "grid_interaction")(lambda df: rounded(grid.interaction(_lines_grid(df), "l_extendedprice", "l_discount"), 5))
query("lineitem", f"WITH {_LV}, {_LE} SELECT CAST(src AS INTEGER) vid, round(avg(x2 - x), 4) divergence FROM e GROUP BY 1", "grid_vector")(lambda df: rounded(grid.vector_field(_lines_grid(df), "l_extendedprice").select("vid", "divergence"), 4))
query("lineitem", f"WITH {_LV} SELECT CAST(n AS INTEGER) value, round(avg(x), 4) mean, round(min(x), 4) \"min\", round(max(x), 4) \"max\", count(*) vertices FROM v GROUP BY 1", "grid_walk")(lambda df: rounded(grid.walk_axis(_lines_grid(df), "l_linenumber", "l_extendedprice"), 4))
query("lineitem", f"WITH {_LV}, {_LE} SELECT CAST(e.src AS INTEGER) vid_a, CAST(e.dst AS INTEGER) vid_b, round(e.x2 - e.x, 4) jump FROM e JOIN v a ON a.vid = src JOIN v b ON b.vid = dst WHERE a.n <= 3 AND b.n > 3", "grid_frontier")(lambda df: rounded(grid.frontier(_lines_grid(df), F.col("a1") <= 3, F.col("a1") > 3, "l_extendedprice", 500), 4))
query("lineitem", f"WITH {_LV} SELECT count(*) v, (SELECT count(*) FROM v a JOIN v b ON (a.f = b.f AND b.n = a.n + 1) OR (b.n = a.n AND b.f = (SELECT min(f) FROM v c WHERE c.f > a.f))) e FROM v", "grid_faces")(lambda df: grid.faces(_lines_grid(df)).select("v", "e"))
query("lineitem", f"WITH {_LV}, {_LE} SELECT CAST(dst AS INTEGER) dst, round(x2 - x, 4) gradient FROM e WHERE src = 3", "grid_navigate")(lambda df: rounded(grid.navigate(_lines_grid(df), 3, "l_extendedprice").select("dst", "gradient"), 4))
query("lineitem", f"WITH {_LV}, {_LE} SELECT (SELECT count(*) FROM v) vertices, count(*) // 2 edges, (SELECT min(density) FROM v) min_density, (SELECT max(density) FROM v) max_density FROM e", "grid_coverage")(lambda df: grid.coverage(_lines_grid(df)).select("vertices", "edges", "min_density", "max_density"))
query("lineitem", f"WITH {_LV} SELECT 'l_extendedprice' field, round(avg(x) FILTER (n = (SELECT min(n) FROM v)), 4) low, round(avg(x) FILTER (n = (SELECT max(n) FROM v)), 4) high FROM v", "grid_wrap")(lambda df: rounded(grid.wrap(_lines_grid(df), "l_linenumber").filter("field = 'l_extendedprice'").select("field", "low", "high"), 4))
query("lineitem", f"WITH RECURSIVE {_LV}, {_LE}, c(vid, d) AS (SELECT 0, 0 UNION SELECT e.dst, c.d + 1 FROM c JOIN e ON e.src = c.vid WHERE c.d < 3) SELECT CAST(vid AS INTEGER) vid, min(d) distance FROM c GROUP BY 1", "grid_bfs")(lambda df: paths.orbit(_lines_grid(df), 0, 3))
query("lineitem", f"WITH {_LV} SELECT CAST(vid AS INTEGER) vid, 0 component FROM v", "grid_components")(lambda df: paths.components(_lines_grid(df)))
query("lineitem", f"WITH {_LV}, {_LE} SELECT CAST(v.vid AS INTEGER) vid, CAST(coalesce((SELECT dst FROM e WHERE e.src = v.vid AND x2 < e.x ORDER BY x2, dst LIMIT 1), v.vid) AS INTEGER) \"next\" FROM v", "grid_next_hop")(lambda df: paths.next_hops(_lines_grid(df), "l_extendedprice"))
query("lineitem", f"WITH RECURSIVE {_LV}, {_LE}, h AS (SELECT v.vid, coalesce((SELECT dst FROM e WHERE e.src = v.vid AND x2 < e.x ORDER BY x2, dst LIMIT 1), v.vid) nx FROM v), p(vid, pos, k) AS (SELECT vid, nx, 1 FROM h UNION ALL SELECT p.vid, h.nx, k + 1 FROM p JOIN h ON h.vid = p.pos WHERE k < 30) SELECT CAST(vid AS INTEGER) vid, CAST(pos AS INTEGER) extremum FROM p WHERE k = 30", "grid_basin")(lambda df: paths.basins(_lines_grid(df), "l_extendedprice"))

_LB = "c(vid, d) AS (SELECT 0, 0 UNION SELECT e.dst, c.d + 1 FROM c JOIN e ON e.src = c.vid WHERE c.d < 3), o AS (SELECT vid, min(d) distance FROM c GROUP BY 1)"
_LC = "m AS (SELECT src, avg(x2) mx, avg(y2) my FROM e GROUP BY 1), k AS (SELECT vid, (abs(x - mx) / greatest(abs(mx), 1) + abs(y - my) / greatest(abs(my), 1)) / 2 curvature FROM v JOIN m ON m.src = v.vid)"
query("lineitem", f"""WITH {_LV}, {_LE}, g AS (SELECT e.src, e.dst, CASE WHEN a.f = b.f THEN 1 ELSE 0 END axis, e.x2 > e.x up, e.x2 - e.x g FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst),
  t AS (SELECT src, g, up <> coalesce(lead(up) OVER w, first_value(up) OVER w) turn FROM g WINDOW w AS (PARTITION BY src ORDER BY axis, dst)), d AS (SELECT src, sum(g) / count(*) d, CASE WHEN count(*) >= 3 THEN count(*) FILTER (turn) / count(*) ELSE 0.0 END curl FROM t GROUP BY 1),
  z AS (SELECT *, (d - avg(d) OVER ()) / stddev_pop(d) OVER () z FROM d) SELECT CAST(src AS INTEGER) vid, round(curl, 6) curl, CASE WHEN curl > 0.6 THEN CASE WHEN abs(z) > 1.5 THEN 'saddle' ELSE 'vortex' END WHEN z > 1.5 THEN 'source' WHEN z < -1.5 THEN 'sink' ELSE 'regular' END kind FROM z""", "grid_curl")(lambda df: rounded(grid.vector_field(_lines_grid(df), "l_extendedprice").select("vid", "curl", "kind")))
query("lineitem", f"""WITH {_LV}, {_LE}, q AS (SELECT a.vid a, b.vid b, c.vid c, d.vid d FROM (SELECT w.*, dense_rank() OVER (ORDER BY f) i FROM w) a JOIN (SELECT w.*, dense_rank() OVER (ORDER BY f) i FROM w) b ON b.i = a.i + 1 AND b.r = a.r JOIN w c ON c.f = b.f AND c.r = a.r + 1 JOIN w d ON d.f = a.f AND d.r = a.r + 1),
  s AS (SELECT least(x, y) x, greatest(x, y) y, count(*) n FROM (SELECT a x, b y FROM q UNION ALL SELECT b, c FROM q UNION ALL SELECT c, d FROM q UNION ALL SELECT d, a FROM q) GROUP BY 1, 2), t AS (SELECT count(*) e, sum(n) // 4 f, count(*) FILTER (n = 1) rim FROM s), h AS (SELECT count(*) v FROM (SELECT x FROM s UNION SELECT y FROM s)),
  z AS (SELECT (count(DISTINCT f) - 1) * (count(DISTINCT n) - 1) possible, count(*) / (count(DISTINCT f) * count(DISTINCT n)) occupancy FROM v) SELECT CAST(f AS BIGINT) faces, v face_vertices, e face_edges, rim boundary_edges, CAST(v - e + f AS BIGINT) euler, round(occupancy, 6) occupancy, round(least(1, 0.55 * f / possible + 0.45 * occupancy), 6) confidence FROM t, h, z""", "grid_topology")(
    lambda df: (lambda t: df.sparkSession.createDataFrame([(t["faces"], t["face_vertices"], t["face_edges"], t["boundary_edges"], t["euler"], round(t["occupancy"], 6), round(t["confidence"], 6))], "faces long, face_vertices long, face_edges long, boundary_edges long, euler long, occupancy double, confidence double"))(paths.face_topology(_lines_grid(df)))
)
query("lineitem", f"WITH RECURSIVE {_LV}, {_LE}, {_LB}, {_LC} SELECT distance, count(*) points, round(avg(curvature), 6) mean_curvature, round(avg(density), 4) mean_density, round(avg(x), 4) mean_value, round(min(x), 4) min_value, round(max(x), 4) max_value FROM o JOIN v USING (vid) JOIN k USING (vid) GROUP BY 1", "grid_shells")(
    lambda df: paths.shells(_lines_grid(df), 0, 3, "l_extendedprice").select("distance", "points", F.round("mean_curvature", 6).alias("mean_curvature"), *[F.round(c, 4).alias(c) for c in ("mean_density", "mean_value", "min_value", "max_value")])
)
query("lineitem", f"WITH {_LV}, {_LE}, m AS (SELECT src, count(*) FILTER (x2 > x + 1e-12) a, count(*) FILTER (x2 < x - 1e-12) b FROM e GROUP BY 1) SELECT CAST(src AS INTEGER) vid, CASE WHEN b = 0 THEN 'minimum' WHEN a = 0 THEN 'maximum' ELSE 'saddle' END kind FROM m WHERE (b = 0 AND a > 0) OR (a = 0 AND b > 0) OR (a >= 2 AND b >= 2)", "grid_critical")(lambda df: grid.critical_points(_lines_grid(df), "l_extendedprice"))
query("lineitem", f"""WITH {_LV}, {_LE}, {_LC}, n AS (SELECT src, count(*) c FROM e GROUP BY 1), rc AS (SELECT e.src vid, avg(4 - a.c - b.c) r FROM e JOIN n a ON a.src = e.src JOIN n b ON b.src = e.dst GROUP BY 1)
  SELECT * FROM (SELECT 'curvature' of, CAST(vid AS INTEGER) vid, round(curvature, 6) x FROM k ORDER BY curvature DESC, k.vid LIMIT 5) UNION ALL SELECT * FROM (SELECT 'density', CAST(vid AS INTEGER), density::DOUBLE FROM v ORDER BY density, v.vid LIMIT 5) UNION ALL SELECT * FROM (SELECT 'ricci', CAST(vid AS INTEGER), round(r, 6) FROM rc ORDER BY r, rc.vid LIMIT 5)""", "grid_extremes")(
    lambda df: (lambda g: rounded(grid.highest_curvature(g).select(F.lit("curvature").alias("of"), "vid", F.col("curvature").alias("x")).unionByName(grid.lowest_density(g).select(F.lit("density").alias("of"), "vid", F.col("density").cast("double").alias("x"))).unionByName(grid.most_negative_ricci(g).select(F.lit("ricci").alias("of"), "vid", F.col("ricci").alias("x")))))(_lines_grid(df))
)

# exports and streams

query("nation", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' line FROM nation", "md_export")(lambda df: exports.markdown_lines(df.select("n_nationkey", "n_name", "n_regionkey")))
query("region", "SELECT r_regionkey || ',' || r_name line FROM region", "csv_export")(lambda df: exports.csv_lines(df.select("r_regionkey", "r_name")))
query("documents", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) tokens FROM documents", "token_estimate")(lambda df: df.select("doc_id", exports.estimated_tokens(F.col("text")).alias("tokens")))
query("events", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2", "window_counts")(lambda df: ingest.windowed(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total")))
query("events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n FROM k GROUP BY user_id, k", "session_counts")(lambda df: ingest.sessions(df, "ts", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"))

# iterative, spectral or sampled; some have SQL below


def _pairs(df: DataFrame, values: dict) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items() if isinstance(v, int | float)], "name string, value double")


def _tied(df: DataFrame) -> DataFrame:
    """With a column that depends on quantity and, less, on tax."""
    return df.withColumn("tied", F.col("l_quantity") * 2 + F.col("l_tax") * 10)


_ITERATIVE = {
    "effective_dimension": ("lineitem", lambda df: _pairs(df, quality.effective_dimension(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))),
    "hsic": ("events", lambda df: _pairs(df, dependency.hsic(df, "value", "user_id"))),
    "sparse_drivers": ("lineitem", lambda df: _pairs(df, {r["driver"]: r["weight"] for r in drivers.sparse_drivers(_tied(df), "tied", ["l_quantity", "l_discount", "l_tax"])["drivers"]})),
    "bottleneck": ("events", lambda df: _pairs(df, drivers.bottleneck(df, ["value"], "user_id"))),
    "kmeans": ("lineitem", lambda df: _pairs(df, structure.cluster(df, ["l_quantity", "l_extendedprice"], k=3))),
    "spectral": ("lineitem", lambda df: _pairs(df, structure.spectral(df, ["l_quantity", "l_extendedprice"]))),
    "latent_sources": ("lineitem", lambda df: df.sparkSession.createDataFrame([(k, s["kurtosis"]) for k, s in enumerate(structure.sources(df, ["l_quantity", "l_extendedprice", "l_tax"])["sources"])], "source int, kurtosis double")),
    "graphical_model": ("lineitem", lambda df: rounded(df.sparkSession.createDataFrame([(e["a"], e["b"], e["partial"]) for e in structure.graphical_model(_tied(df), ["l_quantity", "l_extendedprice", "tied"])["edges"]], "a string, b string, partial double"))),
    "persistent_topology": ("lineitem", lambda df: df.sparkSession.createDataFrame([tuple(t.values()) for t in structure.topology(df, ["l_quantity", "l_extendedprice"])["trace"]], "radius double, b0 long, b1 long")),
    "causal_graph": ("lineitem", lambda df: df.sparkSession.createDataFrame(causal.causal_graph(_tied(df), ["l_quantity", "l_extendedprice", "tied"])["undirected"], "a string, b string")),
    "synthetic_control": ("events", lambda df: _pairs(df, causal.synthetic_control(df.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("day", "event_type").agg(F.avg("value").alias("y")), "y", "day", "event_type", "click", df.agg(F.date_format(F.expr("timestampadd(second, cast(timestampdiff(second, min(ts), max(ts)) * 0.7 as int), min(ts))"), "yyyy-MM-dd")).first()[0]))),
    "phase_space": ("events", lambda df: _pairs(df, dynamics.phase_space(df, "value", ["ts", "event_id"]))),
    "recurrence": ("events", lambda df: rounded(_pairs(df, dynamics.recurrence(df, ["value"], ["ts", "event_id"])))),
    "geodesic": ("lineitem", lambda df: df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(paths.geodesic(_lines_grid(df), 0, 20, "l_extendedprice")["path"])], "step int, vid int")),
    "ridge_trace": ("lineitem", lambda df: df.sparkSession.createDataFrame(list(enumerate(paths.trace(_lines_grid(df), 0, "l_extendedprice"))), "step int, vid int")),
    "grid_persistence": ("lineitem", lambda df: df.sparkSession.createDataFrame([tuple(p.values()) for p in paths.persistence(_lines_grid(df), "l_extendedprice")], "birth double, death double, persistence double")),
    "heat_kernel": ("lineitem", lambda df: df.sparkSession.createDataFrame([(r["vid"], r["bottleneck"]) for r in paths.heat_kernel(_lines_grid(df))["bottlenecks"]], "vid int, bottleneck double")),
    "laplacian_spectrum": ("lineitem", lambda df: rounded(df.sparkSession.createDataFrame(list(enumerate(paths.spectrum(_lines_grid(df))["eigenvalues"])), "k int, eigenvalue double"))),
    "scalar_harmonics": ("lineitem", lambda df: df.sparkSession.createDataFrame(list(enumerate(paths.harmonics(_lines_grid(df), "l_extendedprice")["energy"])), "mode int, energy double")),
    "diffusion_distance": ("lineitem", lambda df: rounded(df.sparkSession.createDataFrame([tuple(r.values()) for r in paths.diffusion(_lines_grid(df))], "a int, b int, distance double, kind string"))),
    "reeb_graph": ("lineitem", lambda df: df.sparkSession.createDataFrame([tuple(n.values()) for n in paths.reeb(_lines_grid(df), "l_extendedprice", 5)["nodes"]], "slab int, size int, kind string")),
    "multiscale_view": ("lineitem", lambda df: paths.multiscale(_lines_grid(df), 0, [1, 2, 3])),
}
_DELAYED = """WITH r AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 k, value v FROM events), s AS (SELECT k, v a, lead(v) OVER (ORDER BY k) b, lead(v, 2) OVER (ORDER BY k) c FROM r), n AS (SELECT count(*) n FROM s WHERE c IS NOT NULL),
  pick AS (SELECT i, CASE WHEN i = 499 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 499::DOUBLE)) AS BIGINT) END k FROM n, range(500) t(i)), x AS MATERIALIZED (SELECT i, a, b, c FROM pick JOIN s USING (k)),
  d AS MATERIALIZED (SELECT p.i i, q.i j, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) d FROM x p CROSS JOIN x q), cut AS (SELECT quantile_cont(d, 0.1) cut FROM d), hits AS (SELECT i, j FROM d, cut WHERE d <= cut AND i <> j)"""
_MODES = "sz AS (SELECT count(DISTINCT f) nf, count(DISTINCT n) nn, count(*) nv FROM v), modes AS (SELECT t, j, nf, nn, t * nf + 2 - 2 * cos(pi() * j / nn) lam, CASE WHEN t = 0 THEN 1 ELSE nf - 1 END times FROM sz, (VALUES (0), (1)) a(t), range(1000) b(j) WHERE j < nn)"
#: The line items' grid is full, so its modes are products of those of a clique and of a path.
_ITERATIVE_SQL = {
    "graphical_model": """WITH l AS (SELECT l_quantity q, l_extendedprice e, l_quantity * 2 + l_tax * 10 t FROM lineitem), c AS (SELECT count(*) n, var_pop(q) + 0.01 a, covar_pop(q, e) b, covar_pop(q, t) c, var_pop(e) + 0.01 d, covar_pop(e, t) f, var_pop(t) + 0.01 g FROM l),
      p AS (SELECT n, d * g - f * f p11, a * g - c * c p22, a * d - b * b p33, c * f - b * g p12, b * f - c * d p13, b * c - a * f p23 FROM c),
      r AS (SELECT n, 'l_quantity' a, 'l_extendedprice' b, -p12 / sqrt(p11 * p22) x FROM p UNION ALL SELECT n, 'l_quantity', 'tied', -p13 / sqrt(p11 * p33) FROM p UNION ALL SELECT n, 'l_extendedprice', 'tied', -p23 / sqrt(p22 * p33) FROM p) SELECT a, b, round(x, 6) "partial" FROM r WHERE abs(x) > 2 / sqrt(n)""",
    "recurrence": _DELAYED + """, dl AS (SELECT count(*) len FROM (SELECT j - i k, i - row_number() OVER (PARTITION BY j - i ORDER BY i) g FROM hits WHERE j > i) GROUP BY k, g HAVING count(*) >= 2), vl AS (SELECT count(*) len FROM (SELECT j, i - row_number() OVER (PARTITION BY j ORDER BY i) g FROM hits) GROUP BY j, g HAVING count(*) >= 2),
      h AS (SELECT count(*) h FROM hits), p AS (SELECT count(*) / sum(count(*)) OVER () p FROM dl GROUP BY len)
      SELECT 'threshold' "name", round(cut, 6) "value" FROM cut UNION ALL SELECT 'rate', round(h / 250000, 6) FROM h UNION ALL SELECT 'determinism', round(2 * (SELECT sum(len) FROM dl) / h, 6) FROM h UNION ALL SELECT 'laminarity', round((SELECT sum(len) FROM vl) / h, 6) FROM h UNION ALL SELECT 'trapping_time', round(avg(len), 6) FROM vl UNION ALL SELECT 'entropy', round(-sum(p * ln(p)), 6) FROM p""",
    "ridge_trace": f"WITH RECURSIVE {_LV}, {_LE}, h AS (SELECT v.vid, (SELECT dst FROM e WHERE e.src = v.vid AND x2 > e.x ORDER BY x2 DESC, dst LIMIT 1) nx FROM v), p(step, vid) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT step + 1, h.nx FROM p JOIN h ON h.vid = p.vid WHERE h.nx IS NOT NULL AND step < 25) SELECT CAST(step AS INTEGER) step, CAST(vid AS INTEGER) vid FROM p",
    "multiscale_view": f"WITH RECURSIVE {_LV}, {_LE}, {_LB} SELECT radius, count(*) vertices FROM o, (VALUES (1), (2), (3)) r(radius) WHERE distance <= radius GROUP BY 1",
    "laplacian_spectrum": f"WITH {_LV}, {_MODES}, s AS (SELECT lam, row_number() OVER (ORDER BY lam) - 1 k FROM modes, range(1000) m(q) WHERE q < times) SELECT CAST(k AS INTEGER) k, round(lam, 6) eigenvalue FROM s WHERE k < least(15, (SELECT nv - 1 FROM sz))",
    "diffusion_distance": f"""WITH {_LV}, {_MODES}, cum AS (SELECT *, sum(times) OVER (ORDER BY lam, t) upto FROM modes), used AS (SELECT * FROM cum WHERE upto <= 15), l AS (SELECT vid, f, r FROM v JOIN ranks USING (n), sz WHERE vid % greatest(1, nv // least(8, nv)) = 0 AND vid // greatest(1, nv // least(8, nv)) < 8),
      m AS (SELECT a.vid a, b.vid b, exp(-2 * lam) * CASE WHEN j = 0 THEN 1 ELSE 2 END / nn z, CASE WHEN t = 0 THEN 1 / nf ELSE 1 - 1 / nf END same, CASE WHEN t = 0 THEN 1 / nf WHEN a.f = b.f THEN 1 - 1 / nf ELSE -1 / nf END cross_, cos(pi() * j * (a.r - 0.5) / nn) x, cos(pi() * j * (b.r - 0.5) / nn) y FROM used, l a JOIN l b ON b.vid > a.vid),
      d AS (SELECT a, b, sqrt(greatest(0, sum(z * (same * x * x + same * y * y - 2 * cross_ * x * y)))) d FROM m GROUP BY 1, 2) SELECT CAST(a AS INTEGER) a, CAST(b AS INTEGER) b, round(d, 6) distance, CASE WHEN d <= 0.3 * avg(d) OVER () THEN 'close' WHEN d >= 2 * avg(d) OVER () THEN 'far' ELSE 'middle' END kind FROM d""",
}
for _name, (_source, _fn) in _ITERATIVE.items():
    query(_source, _ITERATIVE_SQL.get(_name), _name)(_fn)

query("lineitem", f"""WITH RECURSIVE {_LV}, {_LE}, c AS MATERIALIZED (SELECT src, dst, abs(x2 - x) + 1e-6 w FROM e), lim AS MATERIALIZED (SELECT sum(w) u FROM c WHERE (src < 6 AND dst = src + 1) OR (src = 6 AND dst = 20)),
  p(vid, cost, path) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), [CAST(0 AS BIGINT)] UNION ALL SELECT c.dst, p.cost + c.w, list_append(p.path, c.dst) FROM p JOIN c ON c.src = p.vid, lim WHERE p.vid <> 20 AND NOT list_contains(p.path, c.dst) AND p.cost + c.w <= u + 1e-9)
  SELECT round(min(cost), 4) cost FROM p WHERE vid = 20""", "geodesic_cost")(lambda df: one_row(df, {"cost": round(paths.geodesic(_lines_grid(df), 0, 20, "l_extendedprice")["cost"], 4)}))  # ways of equal cost may differ
_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
query("lineitem", "SELECT round(16 / (4 + 2 * (" + " + ".join(f"power(corr({a}, {b}), 2)" for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]) + ")), 6) ratio, round((4 + 2 * (" + " + ".join(f"power(corr({a}, {b}), 2)" for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]) + ")) / 4, 6) redundancy FROM lineitem", "participation_ratio")(
    lambda df: (lambda r: one_row(df, {"ratio": round(r["participation_ratio"], 6), "redundancy": round(r["redundancy"], 6)}))(quality.effective_dimension(df, list(_FOUR), method="participation_ratio"))
)
query("events", f"WITH b AS (SELECT {_bucket_sql('value', 'events', 8, 'x')}, {_bucket_sql('user_id', 'events', 8, 'y')} FROM events), c AS (SELECT x, y, count(*) m FROM b GROUP BY 1, 2), s AS (SELECT x, m, sum(m) OVER (PARTITION BY x) mx, sum(m) OVER (PARTITION BY y) my, sum(m) OVER () t FROM c) SELECT count(DISTINCT x) states, round(sum(m / t * ln(m * t / (mx * my))), 6) information FROM s", "bottleneck_information")(
    lambda df: (lambda r: one_row(df, {"states": r["states"], "information": round(r["information"], 6)}))(drivers.bottleneck(df, ["value"], "user_id"))
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)



