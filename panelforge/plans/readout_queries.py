"""Spline columns, partitioned quantile heads, tuned boosting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import splines as B
from ..operators import trees as G
from .feature_queries import BAL
from .panel_queries import PANEL, panel
from .registry import h, query, r6


def spline_sql(rows: str, train: str, knots: int, degree: int) -> str:
    """The recursion level by level as self-joins; rows and train have (id, x)."""
    p, n = degree, knots
    ends = [", ".join(f"q[1] - {k} * (q[2] - q[1])" for k in range(p, 0, -1)), ", ".join(f"q[{n}] + {k} * (q[{n}] - q[{n - 1}])" for k in range(1, p + 1))]
    levels = [f"l0 AS (SELECT id, x, c, t, i, CASE WHEN i BETWEEN {p + 1} AND {p + n - 1} AND c >= t[i] AND (c < t[i + 1] OR i = {p + n - 1}) THEN 1e0 ELSE 0e0 END AS v, 0e0 AS s FROM e, range(1, {n + 2 * p}) r(i))"]
    for k in range(1, p + 1):
        levels.append(f"l{k} AS (SELECT a.id, a.x, a.c, a.t, a.i, (a.c - a.t[a.i]) / (a.t[a.i + {k}] - a.t[a.i]) * a.v + (a.t[a.i + {k + 1}] - a.c) / (a.t[a.i + {k + 1}] - a.t[a.i + 1]) * b.v AS v, {k} * (a.v / (a.t[a.i + {k}] - a.t[a.i]) - b.v / (a.t[a.i + {k + 1}] - a.t[a.i + 1])) AS s FROM l{k - 1} a JOIN l{k - 1} b ON a.id = b.id AND b.i = a.i + 1)")
    columns = ", ".join(f"round(max(CASE WHEN i = {j + 1} THEN v + (x - c) * s END), 6) AS x_s{j}" for j in range(n + p - 2))
    return f"""WITH rows_ AS ({rows}), train_ AS ({train}), q AS (SELECT quantile_cont(x, [{', '.join(f'{k} / {n - 1}e0' for k in range(n))}]) AS q FROM train_), k AS (SELECT q, list_concat([{ends[0]}], q, [{ends[1]}]) AS t FROM q),
e AS (SELECT id, x, least(greatest(x, q[1]), q[{n}]) AS c, t FROM rows_, k), {', '.join(levels)} SELECT id, {columns} FROM l{p} GROUP BY id"""


TRAIN = "SELECT c_custkey AS id, c_acctbal / 1e3 AS x FROM customer WHERE c_mktsegment <> 'BUILDING'"


@query(spline_sql("SELECT c_custkey AS id, c_acctbal / 1e3 AS x FROM customer", TRAIN + " AND c_acctbal BETWEEN 0 AND 9000", 5, 3))
def cubic_spline_columns(t, spark):
    """Cubic splines, knots from customers of other segments within a range: rows beyond it go on in straight lines."""
    rows = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000.0).alias("x"))
    train = t("customer").where("c_mktsegment <> 'BUILDING' AND c_acctbal BETWEEN 0 AND 9000").select((F.col("c_acctbal") / 1000.0).alias("x"))
    out = B.spline_columns(rows, B.eligible_knots(train, ["x"], 5)[1], 3)
    return out.select("id", *[r6(c).alias(c) for c in out.columns[1:]])


@query(spline_sql("SELECT o_orderkey AS id, o_totalprice / 1e5 AS x FROM orders", "SELECT o_totalprice / 1e5 AS x FROM orders WHERE o_orderdate < DATE '1997-01-01'", 4, 2))
def quadratic_spline_columns(t, spark):
    """Quadratic splines with knots from earlier orders."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e5).alias("x"))
    train = t("orders").where("o_orderdate < DATE '1997-01-01'").select((F.col("o_totalprice") / 1e5).alias("x"))
    out = B.spline_columns(rows, B.eligible_knots(train, ["x"], 4)[1], 2)
    return out.select("id", *[r6(c).alias(c) for c in out.columns[1:]])


SPLINED = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "urgent"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS \"column\", CAST({'CASE WHEN l_linestatus = chr(70) THEN 1 ELSE 0 END' if c == 'urgent' else c} AS DOUBLE) AS v FROM lineitem" for i, c in enumerate(SPLINED)) + """), q AS (SELECT i, "column", len(list_distinct(quantile_cont(v, [0, 25e-2, 5e-1, 75e-2, 1]))) AS knots, count(DISTINCT v) AS n FROM c GROUP BY ALL)
SELECT "column", CAST(knots AS INTEGER) AS knots, n AS "values", knots = 5 AND row_number() OVER (ORDER BY knots = 5 DESC, n DESC, i) <= 2 AS expanded FROM q""")
def spline_eligibility(t, spark):
    """Which columns have distinct knots, and which two of them are expanded."""
    rows = t("lineitem").withColumn("urgent", (F.col("l_linestatus") == "F").cast("double"))
    return B.eligible_knots(rows, SPLINED, 5, 2)[0]


def partition_sql(count: int, share: str, least: str, rows: int) -> str:
    value, best = "(CASE fi WHEN 0 THEN y ELSE n END)", "gl * gl / nl + (g - gl) * (g - gl) / (m - nl) - g * g / m"
    key = h("concat(o_custkey, '-', y, '|', b)")

    def level(k: int, node: str) -> str:
        return f"""s{k} AS (SELECT tree, {node} AS node, fi, c, sum(CASE WHEN {value} <= c THEN 1 ELSE 0 END) AS nl, sum(CASE WHEN {value} <= c THEN total ELSE 0 END) AS gl, count(*) AS m, sum(total) AS g FROM x{k - 1}, cut WHERE mem {'AND node > 1' if k > 1 else ''} GROUP BY ALL),
b{k} AS (SELECT tree, node, fi, c FROM (SELECT s{k}.*, {best} AS gain FROM s{k} JOIN fl USING (tree) WHERE nl >= floor AND m - nl >= floor) WHERE gain > 1e-9 * g * g / m QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY round(gain / (g * g / m), 9) DESC, fi, c) = 1),
x{k} AS (SELECT x.* REPLACE (CASE WHEN c IS NULL THEN node WHEN {value} > c THEN 2 * node + 1 ELSE 2 * node END AS node) FROM x{k - 1} x LEFT JOIN (SELECT tree AS bt, node AS bn, fi, c FROM b{k}) ON bt = tree AND bn = node)"""

    def tidy(sql: str) -> str:
        return sql.replace("SELECT x.* REPLACE", "SELECT x.o_custkey, x.y, x.n, x.total, x.tree, x.mem,").replace("(CASE WHEN c IS NULL THEN node", "CASE WHEN c IS NULL THEN node").replace("ELSE 2 * node END AS node)", "ELSE 2 * node END AS node")

    return f"""WITH p AS (SELECT o_custkey, y, n, total FROM ({PANEL})), cut AS (SELECT 0 AS fi, v AS c FROM (SELECT DISTINCT unnest(quantile_cont(y, [{', '.join(f'{k} / 8e0' for k in range(1, 9))}])) AS v FROM p) WHERE v < (SELECT max(y) FROM p) UNION ALL SELECT 1, v FROM (SELECT DISTINCT unnest(quantile_cont(n, [{', '.join(f'{k} / 8e0' for k in range(1, 9))}])) AS v FROM p) WHERE v < (SELECT max(n) FROM p)),
x0 AS (SELECT p.*, b AS tree, 1 AS node, row_number() OVER (PARTITION BY b ORDER BY {key}, concat(o_custkey, '-', y)) <= round(count(*) OVER (PARTITION BY b) * {share}) AS mem FROM p, range(0, {count}) r(b)), fl AS (SELECT tree, ceil(count(*) * {least}) AS floor FROM x0 WHERE mem GROUP BY 1),
{tidy(level(1, 'node'))}, {tidy(level(2, 'node'))},
hd AS (SELECT tree, node, quantile_cont(total, [1e-1, 5e-1, 9e-1]) AS q FROM x2 WHERE mem GROUP BY 1, 2 HAVING count(*) >= {rows} AND count(DISTINCT total) >= 2), w AS (SELECT quantile_cont(total, [1e-1, 5e-1, 9e-1]) AS a FROM p)
SELECT o_custkey, y, round(avg(coalesce(q[1], a[1])), 5) AS low, round(avg(coalesce(q[2], a[2])), 5) AS median, round(avg(coalesce(q[3], a[3])), 5) AS high, CAST(count(q) AS INTEGER) AS own FROM x2 LEFT JOIN hd USING (tree, node), w GROUP BY 1, 2"""


@query(partition_sql(3, "6e-1", "5e-2", 100))
def partitioned_quantiles(t, spark):
    """Quantile heads for each leaf of three bagged trees of the panel, mixed over the bags; small leaves take the whole's."""
    p = panel(t).select("o_custkey", "y", F.col("n").cast("double").alias("n"), "total", F.concat_ws("-", "o_custkey", "y").alias("key"))
    model = G.PartitionedQuantiles(["y", "n"], "total", "key", count=3, least_rows=100, bins=8).fit(p)
    return model.predict(p).select("o_custkey", "y", *[F.round(F.col("q")[i], 5).alias(c) for i, c in enumerate(("low", "median", "high"))], "own")


@query(None)
def tuned_boosting(t, spark):
    """Boosted trees chosen by halving on an inner out-of-time split of the years to 1997, scored on the later ones."""
    p = panel(t).withColumn("total", F.col("total") / 1e5)
    configs = [{"depth": d, "rate": r, "least": 20.0} for d in (1, 3) for r in (0.1, 0.5)]
    model, _ = G.tuned_boosting(p.where("y < 1997"), p.where("y = 1997"), ["total", "n"], "label", configs, [2, 4], bins=16)
    scored = p.where("y > 1997").withColumn("p", 1 / (1 + F.exp(-model.raw())))
    return M.rank_metrics(scored, ["y"], "label", "p").select("y", "n", "positives", r6("auc").alias("auc"), r6("ap").alias("ap"))


@query(None)
def linear_readout(t, spark):
    """Return flags from splines, plain columns and indicators, fitted on lines shipped before 1998 and scored on all: by flag
    and period the rows, the mean probability of the flag, and the log-loss."""
    from ..operators.readout import LinearReadout

    rows = t("lineitem").select("l_returnflag", "l_linestatus", (F.unix_date(F.col("l_shipdate").cast("date")) / 365.0).alias("shipped"), "l_quantity", "l_discount", "l_linenumber", (F.year("l_shipdate") >= 1998).alias("later"))
    model = LinearReadout("l_returnflag", ["shipped", "l_quantity", "l_discount"], ["l_linestatus", "l_linenumber"], most=2, floor=0.01).fit(rows.where("not later"))
    p = F.element_at("probabilities", F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("l_returnflag")).cast("int"))
    return model.score(rows).groupBy("l_returnflag", "later").agg(F.count("*").alias("n"), F.round(F.avg(p), 5).alias("mean_p"), F.round(F.avg(-F.log(p)), 5).alias("log_loss"))
