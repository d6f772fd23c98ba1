"""Power transforms, splines, projections, predicted distributions and small exact tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import scalars as S
from ..operators import features as X
from ..operators import generation as G
from ..operators import scoring
from .metric_queries import SC, scores
from .panel_queries import ORDERS_T, orders_t
from .registry import big, query, r6

BAL = "SELECT c_custkey, c_acctbal / 1e3 AS x FROM customer"
YJ = "CASE WHEN x >= 0 THEN CASE WHEN p = 0 THEN ln(1 + x) ELSE (pow(x + 1, p) - 1) / p END ELSE CASE WHEN p = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - p) - 1) / (2 - p) END END"


@query(f"""WITH b AS ({BAL}), g AS (SELECT i * 25e-2 AS p FROM range(-4, 13) r(i)), t AS (SELECT p, -count(*) / 2e0 * ln(var_pop({YJ})) + (p - 1) * sum(sign(x) * ln(1 + abs(x))) AS l FROM b, g GROUP BY p) SELECT min_by(p, -round(l, 6)) AS power, round(max(l), 3) AS log_likelihood FROM t""")
def power_transform_fit(t, spark):
    b = t("customer").select((F.col("c_acctbal") / 1000.0).alias("x"))
    return X.fit_power(b, "x", [i * 0.25 for i in range(-4, 13)]).select("power", F.round("log_likelihood", 3).alias("log_likelihood"))


@query(f"""WITH b AS ({BAL}), k AS (SELECT min(x) AS a, quantile_cont(x, 5e-1) AS m, max(x) AS z FROM b) SELECT c_custkey, round(CASE WHEN x < m THEN (m - x) / (m - a) ELSE 0 END, 6) AS b0, round(CASE WHEN x <= m THEN (x - a) / (m - a) ELSE (z - x) / (z - m) END, 6) AS b1, round(CASE WHEN x > m THEN (x - m) / (z - m) ELSE 0 END, 6) AS b2 FROM b, k""")
def spline_features(t, spark):
    b = t("customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("x"))
    basis = X.hat_basis(F.col("x"), X.fit_knots(b, "x", 3))
    return b.select("c_custkey", *[r6(c).alias(f"b{i}") for i, c in enumerate(basis)])


@query(f"""WITH s AS ({SC}), d AS (SELECT _row_id, p / 2 AS p1, 3e-1 AS p2, 1 - p / 2 - 3e-1 AS p3, y FROM s) SELECT _row_id, round(p1 * 1 + p2 * 5 + p3 * 20, 6) AS mean, CASE WHEN p1 >= 5e-1 THEN 1e0 WHEN p1 + p2 >= 5e-1 THEN 5e0 ELSE 2e1 END AS median, round(9e-1 * p1 + 1e-1 / 3, 6) AS floored FROM d""")
def predicted_distribution(t, spark):
    mass, values = F.array(F.col("p") / 2, F.lit(0.3), 1 - F.col("p") / 2 - 0.3), F.array(F.lit(1.0), F.lit(5.0), F.lit(20.0))
    return scores(t).select("_row_id", r6(X.expected_value(mass, values)).alias("mean"), X.quantile_of(mass, values, 0.5).alias("median"), r6(X.probability_floor(F.col("p") / 2, 0.1, 3)).alias("floored"))


@query(f"""WITH s AS ({SC}) SELECT _row_id, round(p + 6e-1 * (p * p + 1 - p), 6) AS q FROM s""")
def quantile_interpolation(t, spark):
    values = F.array(F.lit(0.0), F.col("p"), F.col("p") * F.col("p") + 1)
    return scores(t).select("_row_id", r6(X.on_grid([0.1, 0.5, 0.9], values, 0.74)).alias("q"))


@query(f"""WITH s AS ({SC}), e AS (SELECT y, p, (p + 3e-1) / 2 AS b FROM s) SELECT round(least(1e0, greatest(0e0, sum((p - b) * (y - b)) / sum((p - b) * (p - b)))), 6) AS weight, round((SELECT avg(exp(least(greatest(y - p, -3e0), 3e0))) FROM e), 6) AS factor, round(avg(CASE WHEN y BETWEEN p - 5e-1 AND p + 5e-1 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM e""")
def blend_smear_coverage(t, spark):
    e = scores(t).withColumn("b", (F.col("p") + 0.3) / 2).withColumn("r", F.col("y") - F.col("p"))
    one = e.agg(F.avg(F.col("y").between(F.col("p") - 0.5, F.col("p") + 0.5).cast("double")).alias("coverage"))
    return X.blend_weight(e, "y", "p", "b").crossJoin(X.smearing(e, "r")).crossJoin(one).select(r6("weight").alias("weight"), r6("factor").alias("factor"), r6("coverage").alias("coverage"))  # one row each


@query("""WITH r AS (SELECT c_nationkey AS g, c_custkey % 4 = 0 AS m, c_acctbal > 5000 AS y FROM customer), k AS (SELECT g, count(CASE WHEN m AND y THEN 1 END) AS a, count(CASE WHEN m AND NOT y THEN 1 END) AS b, count(CASE WHEN NOT m AND y THEN 1 END) AS c, count(CASE WHEN NOT m AND NOT y THEN 1 END) AS d FROM r GROUP BY 1),
x AS (SELECT k.*, i, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS l FROM k, range(0, 400) r(i) WHERE i BETWEEN greatest(0, a - d) AND least(a + b, a + c)),
h AS (SELECT g, l AS here FROM x WHERE i = a) SELECT x.g, round(least(1e0, sum(CASE WHEN l <= here + 1e-7 THEN exp(l) ELSE 0 END)), 5) AS p FROM x JOIN h USING (g) GROUP BY 1""")
def informative_missingness(t, spark):
    m, y = F.col("c_custkey") % 4 == 0, F.col("c_acctbal") > 5000
    k = t("customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count_if(m & y).alias("a"), F.count_if(m & ~y).alias("b"), F.count_if(~m & y).alias("c"), F.count_if(~m & ~y).alias("d"))
    return k.select("g", F.round(X.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 5).alias("p"))


@query(f"WITH p AS ({ORDERS_T}), c AS (SELECT quantile_cont(t, 8e-1) AS cut FROM p), x AS (SELECT CASE WHEN t >= cut THEN 'hold' WHEN t < cut - 90 THEN 'fit' END AS part FROM p, c) SELECT part, count(*) AS n FROM x WHERE part IS NOT NULL GROUP BY 1")
def latest_inner_split(t, spark):
    return X.latest_part(orders_t(t), "t", 0.2, 90.0).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT round((abs(corr(l_quantity, l_extendedprice)) + abs(corr(l_quantity, l_discount)) + abs(corr(l_extendedprice, l_discount))) / 3, 6) AS mean_abs_corr, 0e0 AS missing FROM lineitem")
def table_properties(t, spark):
    got = X.pairwise_correlation(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return got.select(r6("mean_abs_corr").alias("mean_abs_corr"), r6("missing").alias("missing"))


@query(None)
def svd_augmented(t, spark):
    cols = ["l_quantity", "l_discount", "l_tax"]
    x = t("lineitem").select("l_orderkey", "l_linenumber", *cols)
    return X.project(x, cols, X.fit_projection(x, cols, 2)).select("l_orderkey", "l_linenumber", r6("svd_0").alias("svd_0"), r6("svd_1").alias("svd_1"))


@query(None)
def permutation_importance(t, spark):
    """The AUC that a logistic scorer loses when one column is permuted by hashes of the row ids."""
    rows = t("orders").select(F.col("o_orderkey").alias("_row_id"), (F.col("o_totalprice") / 1e5).alias("price"), F.month("o_orderdate").cast("double").alias("month"), big(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("y"))
    model = scoring.LogisticScorer(["price", "month"], "y").fit(rows)
    base = M.rank_metrics(model.score(rows), [], "y").select(F.col("auc").alias("base"))
    out = None
    for c in ("price", "month"):
        mixed = G.permuted(rows, "_row_id", c, "importance").withColumn(c, F.col("permuted")).drop("permuted")
        one = M.rank_metrics(model.score(mixed), [], "y").crossJoin(base).select(F.lit(c).alias("feature"), r6(F.col("base") - F.col("auc")).alias("drop"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(None)
def gaussian_mean_shift(t, spark):
    """A generated family with a known best score: y shifts the first of three normals; the AUC of that normal approaches 0.76."""
    z = lambda k: S.inverse_normal(S.uniform("id", F.lit(k)) * (1 - 2e-9) + 1e-9)
    rows = spark.range(4000).select("id", big(S.uniform("id", F.lit("y")) < 0.5).alias("y"), *[z(f"x{i}").alias(f"x{i}") for i in range(3)])
    return M.rank_metrics(rows.withColumn("p", F.col("x0") + F.col("y")), [], "y").select("n", "positives", r6("auc").alias("auc"))
