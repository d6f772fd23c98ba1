"""Bootstraps, families, power, regret, ledgers of units and paired gaps."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import scalars as S
from ..operators import ledger as L
from ..operators import significance as U
from ..operators.conditioning import long_form
from .metric_queries import RES, SC, results, scores
from .registry import big, h, query, r6

TWO = f"SELECT s.*, round({h("concat(_row_id, '|b')")} / 4294967296e0, 2) AS b FROM ({SC}) s"


def two_scores(t):
    return scores(t).withColumn("b", F.round(S.uniform("_row_id", F.lit("b")), 2))


DRAWS = 100


def weight_sql(u: str) -> str:
    """The Poisson(1) number of a uniform one, as operators.bootstrap.poisson_weight makes it."""
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"CASE WHEN {u} >= {total:.17e} THEN 1 ELSE 0 END")
    return " + ".join(steps)


def bootstrap_sql(value: str) -> str:
    return f"""WITH s AS ({TWO}), l AS (SELECT g, o_custkey AS k, y, 'a' AS which, p FROM s UNION ALL SELECT g, o_custkey, y, 'b', b FROM s), c AS (SELECT g, k, which, p, count(*) AS n, sum(y) AS pos FROM l GROUP BY ALL),
u AS (SELECT k, i AS draw, {h("concat(i, '|', k)")} / 4294967296e0 AS u FROM (SELECT DISTINCT k FROM c), range(0, {DRAWS + 1}) r(i)), d AS (SELECT k, draw, CASE WHEN draw = 0 THEN 1 ELSE {weight_sql('u')} END AS w FROM u),
v AS (SELECT g, draw, which, p, sum(w * n) AS n, sum(w * pos) AS pos FROM c JOIN d USING (k) WHERE w > 0 GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY g, draw, which ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY g, draw, which ORDER BY p DESC) AS cp FROM v),
t AS (SELECT g, draw, which, CAST(sum(pos) AS DOUBLE) AS tp, CAST(sum(n - pos) AS DOUBLE) AS tn, sum(pos * ((cn - n) - (cp - pos) + (n - pos) / 2e0)) AS lost, sum(pos * cp / CAST(cn AS DOUBLE)) AS gain FROM r GROUP BY ALL),
e AS (SELECT g, draw, max(CASE WHEN which = 'a' AND tp > 0 AND tn > 0 THEN {value} END) - max(CASE WHEN which = 'b' AND tp > 0 AND tn > 0 THEN {value} END) AS diff FROM t GROUP BY 1, 2),
f AS (SELECT g, max(CASE WHEN draw = 0 THEN diff END) AS diff, count(CASE WHEN draw > 0 THEN diff END) AS drawn, quantile_cont(CASE WHEN draw > 0 THEN diff END, 25e-3) AS low, quantile_cont(CASE WHEN draw > 0 THEN diff END, 975e-3) AS high, count(CASE WHEN draw > 0 AND diff <= 0 THEN 1 END) AS below, count(CASE WHEN draw > 0 AND diff >= 0 THEN 1 END) AS above FROM e GROUP BY 1),
x AS (SELECT g, diff, drawn, low, high, least(1e0, greatest(2e0 * least(below, above) / drawn, 1e0 / (drawn + 1))) AS p FROM f)
"""


@query(bootstrap_sql("1 - lost / (tp * tn)") + "SELECT g, round(diff, 6) AS diff, drawn, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM x")
def paired_auc_bootstrap(t, spark):
    got = U.rank_difference(two_scores(t), ["g"], "o_custkey", "y", "p", "b", "auc", DRAWS, 50)
    return got.select("g", r6("diff").alias("diff"), big("drawn").alias("drawn"), *[r6(c).alias(c) for c in ("low", "high", "p")])


@query(bootstrap_sql("gain / tp") + """, k AS (SELECT *, least(1e0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, g) + 1)) AS adj FROM x) SELECT g, round(diff, 6) AS diff, round(p, 6) AS p, round(max(adj) OVER (ORDER BY p, g), 6) AS p_holm FROM k""")
def paired_precision_family(t, spark):
    """Average precision by group as one family of comparisons."""
    got = U.rank_difference(two_scores(t), ["g"], "o_custkey", "y", "p", "b", "ap", DRAWS, 50).withColumn("family", F.lit(1))
    return U.family(got, ["family"], "g").select("g", *[r6(c).alias(c) for c in ("diff", "p", "p_holm")])


def hm(a: str) -> str:
    return f"(({a}) * (1 - ({a})) + (pos - 1) * (({a}) / (2 - ({a})) - ({a}) * ({a})) + (neg - 1) * (2 * ({a}) * ({a}) / (1 + ({a})) - ({a}) * ({a}))) / (pos * neg)"


@query(f"""WITH RECURSIVE c AS (SELECT g, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM ({SC}) GROUP BY 1),
i AS (SELECT g, pos, neg, 1e-2 AS d, 0 AS k FROM c UNION ALL SELECT g, pos, neg, CASE WHEN 7e-1 + d < 9999e-4 THEN {U.Z_TEST + U.Z_POWER:.17e} * sqrt({hm('7e-1')} + {hm('7e-1 + d')} - sqrt(({hm('7e-1')}) * ({hm('7e-1 + d')}))) END, k + 1 FROM i WHERE k < 40)
SELECT g, round({U.Z_TEST:.17e} * sqrt({hm('7e-1')}), 6) AS half, round(sqrt({hm('7e-1')} + {hm('75e-2')} - sqrt(({hm('7e-1')}) * ({hm('75e-2')}))), 6) AS sd, round(d, 6) AS gain FROM i WHERE k = 40""")
def auc_power_table(t, spark):
    c = scores(t).groupBy("g").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    pos, neg = F.col("pos"), F.col("neg")
    return c.select("g", r6(U.half_width(F.lit(0.7), pos, neg)).alias("half"), r6(F.sqrt(U.difference_variance(F.lit(0.7), F.lit(0.75), pos, neg, 0.5))).alias("sd"), r6(U.detectable_gain(F.lit(0.7), pos, neg, 0.5)).alias("gain"))


AUC = "SELECT g, 1 - sum(pos * ((cn - n) - (cp - pos) + (n - pos) / 2e0)) / (max(tp) * (max(tn) - max(tp))) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY g ORDER BY p DESC) AS cp, CAST(sum(pos) OVER (PARTITION BY g) AS DOUBLE) AS tp, CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS tn FROM (SELECT g, {0} AS p, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1, 2)) GROUP BY 1"
REGRET = f"WITH s AS ({TWO}), a AS ({AUC.format('p')}), b AS ({AUC.format('b')}), r AS (SELECT g, a.auc AS best, a.auc - b.auc AS regret FROM a JOIN b USING (g)), n AS (SELECT *, CASE WHEN best - 5e-1 > 1e-9 THEN regret / (best - 5e-1) END AS norm FROM r)"


@query(f"{REGRET} SELECT g, round(regret, 6) AS regret, round(norm, 3) AS regret_norm FROM n")
def regret_by_task(t, spark):
    return U.regret(two_scores(t), ["g"], "y", "p", "b").select("g", r6("regret").alias("regret"), F.round("regret_norm", 3).alias("regret_norm"))


@query(f"{REGRET} SELECT count(*) AS tasks, round(avg(best), 6) AS auc_best, round(avg(regret), 6) AS regret FROM n")
def regret_over_tasks(t, spark):
    return U.regret(two_scores(t), ["g"], "y", "p", "b").agg(F.count("regret").alias("tasks"), r6(F.avg("auc_best")).alias("auc_best"), r6(F.avg("regret")).alias("regret"))


@query(f"""WITH r AS ({RES}), x AS (SELECT task, method, max(CASE WHEN split = 1996 THEN error END) AS a, max(CASE WHEN split = 1997 THEN error END) AS b FROM r GROUP BY 1, 2), f AS (SELECT task, method, a, b FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND (SELECT count(*) FROM x z WHERE z.task = x.task AND z.a IS NOT NULL AND z.b IS NOT NULL) = 5),
k AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY a) AS ra, rank() OVER (PARTITION BY task ORDER BY b) AS rb FROM f), l AS (SELECT task, list(rb ORDER BY ra) AS rb FROM k GROUP BY 1),
p AS (SELECT [a, b, c, d, e] AS o FROM range(1, 6) x1(a), range(1, 6) x2(b), range(1, 6) x3(c), range(1, 6) x4(d), range(1, 6) x5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
v AS (SELECT task, 1 - 6e0 * list_sum(list_transform(range(1, 6), lambda i: pow(i - rb[i], 2))) / 120 AS seen FROM l), q AS (SELECT 1 - 6e0 * list_sum(list_transform(range(1, 6), lambda i: pow(i - o[i], 2))) / 120 AS rho FROM p)
SELECT task, round(seen, 6) AS rho, round(avg(CASE WHEN abs(rho) >= abs(seen) - 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS p_two, round(avg(CASE WHEN rho >= seen - 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS p_one FROM v, q GROUP BY task, seen""")
def rank_permutation_test(t, spark):
    """Spearman's rho between the errors of two years over five methods, against all their orders."""
    at = lambda year: F.max(F.when(F.col("split") == year, F.col("error")))
    x = results(t).groupBy("task", "method").agg(at(1996).alias("a"), at(1997).alias("b")).where("a is not null and b is not null")
    full = x.withColumn("n", F.count("*").over(W.partitionBy("task"))).where("n = 5")  # methods are few
    return U.rho_permutation(full, ["task"], "a", "b").select("task", *[r6(c).alias(c) for c in ("rho", "p_two", "p_one")])


@query(f"""WITH s AS (SELECT g, p, CAST(o_custkey % 50 AS DOUBLE) AS q, o_custkey FROM ({SC})), d AS (SELECT k, i AS draw, {h("concat(i, '|', k)")} / 4294967296e0 AS u FROM (SELECT DISTINCT o_custkey AS k FROM s), range(1, 21) r(i)), w AS (SELECT k AS o_custkey, draw, {weight_sql('u')} AS w FROM d),
x AS (SELECT s.*, draw, w FROM s JOIN w USING (o_custkey) WHERE w > 0), r AS (SELECT *, sum(w) OVER (PARTITION BY g, draw ORDER BY p) - sum(w) OVER (PARTITION BY g, draw, p) / 2e0 AS x, sum(w) OVER (PARTITION BY g, draw ORDER BY q) - sum(w) OVER (PARTITION BY g, draw, q) / 2e0 AS y FROM x),
m AS (SELECT g, draw, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / sqrt((sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) * (sum(w) * sum(w * y * y) - pow(sum(w * y), 2))) AS rho FROM r GROUP BY 1, 2) SELECT g, round(quantile_cont(rho, 25e-3), 6) AS low, round(quantile_cont(rho, 975e-3), 6) AS high FROM m GROUP BY 1""")
def rank_correlation_interval(t, spark):
    s = scores(t).withColumn("q", (F.col("o_custkey") % 50).cast("double"))
    return U.rho_interval(s, ["g"], "o_custkey", "p", "q", 20).select("g", r6("low").alias("low"), r6("high").alias("high"))


@query(f"WITH s AS ({SC}) SELECT g, 3e-1 AS mean, CAST(0 AS BIGINT) AS moved FROM s GROUP BY 1")
def scores_shifted_to_mean(t, spark):
    """Shifted by one logit a group: the mean is the target, and no row changes places (the twin states both)."""
    s = scores(t).withColumn("p", S.clip("p", F.lit(0.01), F.lit(0.99)))
    got = U.shift_to_mean(s, ["g"], "p", 0.3, passes=5)
    levels = got.groupBy("g", "p").agg(F.min("shifted").alias("lo"), F.max("shifted").alias("hi")).withColumn("before", F.lag("hi").over(W.partitionBy("g").orderBy("p")))  # a hundred scores a group
    moved = levels.groupBy("g").agg(F.count_if((F.col("lo") != F.col("hi")) | (F.col("before") >= F.col("lo"))).alias("moved"))
    return got.groupBy("g").agg(F.round(F.avg("shifted"), 6).alias("mean")).join(moved, "g")


@query(f"WITH s AS ({SC}) SELECT g, round(avg(CASE WHEN p <= 2e-1 + 6e-1 / 3 OR p >= 8e-1 - 6e-1 / 3 THEN 1e0 ELSE 0e0 END), 6) AS outer_mass, count(*) FILTER (p > 5e-1) AS high, abs(avg(CAST(y AS DOUBLE)) - 5e-1) <= 4 * sqrt(25e-2 / count(*)) AS fair FROM s GROUP BY 1")
def outer_mass_and_fairness(t, spark):
    third = 0.6 / 3
    return scores(t).groupBy("g").agg(r6(F.avg(((F.col("p") <= 0.2 + third) | (F.col("p") >= 0.8 - third)).cast("double"))).alias("outer_mass"), F.count_if(F.col("p") > 0.5).alias("high"), F.avg(F.col("y").cast("double")).alias("share"), F.count("*").alias("n")).select("g", "outer_mass", "high", L.within_errors(F.col("share"), 0.5, F.col("n")).alias("fair"))


IMP = "SELECT c_nationkey AS task, c_mktsegment AS feature, round(avg(c_acctbal) / 1e3 - 4, 6) AS fall FROM customer GROUP BY 1, 2"


@query(f"""WITH i AS ({IMP}), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY fall DESC, feature) AS r, feature IN ('BUILDING', 'MACHINERY') AS yes FROM i)
SELECT task, max(CASE WHEN r = 1 THEN feature END) AS top_col, max(CASE WHEN r = 1 THEN feature END) IN ('BUILDING', 'MACHINERY') AS top_hit, sum(CASE WHEN r <= 2 AND yes THEN 1 ELSE 0 END) = 2 AS exact, round(sum(CASE WHEN yes THEN greatest(fall, 0e0) ELSE 0e0 END) / nullif(sum(greatest(fall, 0e0)), 0), 6) AS true_share FROM r GROUP BY 1""")
def importance_recovery(t, spark):
    i = t("customer").groupBy(F.col("c_nationkey").alias("task"), F.col("c_mktsegment").alias("feature")).agg(F.round(F.avg("c_acctbal") / 1000.0 - 4, 6).alias("fall"))
    return U.recovered(i, ["task"], "feature", "fall", ["BUILDING", "MACHINERY"]).select("task", "top_col", "top_hit", "exact", r6("true_share").alias("true_share"))


@query(f"WITH i AS ({IMP}), w AS (SELECT task, max(CASE WHEN feature = 'BUILDING' THEN fall END) AS a, max(CASE WHEN feature = 'FURNITURE' THEN fall END) AS b FROM i GROUP BY 1) SELECT task, round(greatest(b, 0e0) / nullif(greatest(a, 0e0) + greatest(b, 0e0), 0e0), 6) AS share FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def reliance_on_proxy(t, spark):
    i = t("customer").groupBy(F.col("c_nationkey").alias("task")).agg(*[F.round(F.avg(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal"))) / 1000.0 - 4, 6).alias(n) for n, s in (("a", "BUILDING"), ("b", "FURNITURE"))]).where("a is not null and b is not null")
    a, b = F.greatest("a", F.lit(0.0)), F.greatest("b", F.lit(0.0))
    return i.select("task", r6(S.divide(b, a + b)).alias("share"))


@query("""WITH l AS (SELECT 'l_discount' AS feature, l_discount * l_tax AS v, corr(l_extendedprice, l_discount) OVER () AS c FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity * l_tax, corr(l_extendedprice, l_quantity) OVER () FROM lineitem) SELECT feature, round(avg(abs(v - 1e-2)), 6) AS mean_abs, round(max(c), 6) AS realised FROM l GROUP BY 1""")
def mean_contributions(t, spark):
    """Mean absolute contribution of each column, and the correlation that it has with the target column."""
    x = t("lineitem").select("l_extendedprice", "l_discount", "l_quantity", "l_tax")
    rows = long_form(x, ["l_extendedprice", "l_tax"], ["l_discount", "l_quantity"])
    return rows.groupBy("feature").agg(r6(F.avg(F.abs(F.col("value") * F.col("l_tax") - 0.01))).alias("mean_abs"), r6(F.corr("l_extendedprice", "value")).alias("realised"))


@query(f"""WITH s AS (SELECT g, p, CAST(o_custkey % 50 AS DOUBLE) AS q, CAST(_row_id % 7 AS DOUBLE) AS r FROM ({SC})), l AS (SELECT g, 'q' AS feature, p, q AS v FROM s UNION ALL SELECT g, 'r', p, r FROM s), k AS (SELECT g, feature, rank() OVER (PARTITION BY g, feature ORDER BY p) + (count(*) OVER (PARTITION BY g, feature, p) - 1) / 2e0 AS a, rank() OVER (PARTITION BY g, feature ORDER BY v) + (count(*) OVER (PARTITION BY g, feature, v) - 1) / 2e0 AS b FROM l) SELECT g, feature, CAST(sign(corr(a, b)) AS INTEGER) AS sign FROM k GROUP BY 1, 2""")
def recovered_signs(t, spark):
    s = scores(t).select("g", "p", (F.col("o_custkey") % 50).alias("q"), (F.col("_row_id") % 7).alias("r"))
    return M.spearman(long_form(s, ["g", "p"], ["q", "r"]), ["g", "feature"], "p", "value").select("g", "feature", F.coalesce(F.signum("rho"), F.lit(0.0)).cast("int").alias("sign"))


@query("""SELECT c_mktsegment, h AS hypothesis FROM customer, range(0, 12) r(h) GROUP BY 1, 2 HAVING bool_and((c_custkey % 12 = h) <= (c_acctbal > -1000 + h * 180)) """)
def consistent_hypotheses(t, spark):
    """Hypotheses that no row of a group contradicts: a row of class h must lie above the hypothesis's bound."""
    rows = t("customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")).alias("hypothesis"))
    fits = (F.col("c_custkey") % 12 != F.col("hypothesis")) | (F.col("c_acctbal") > -1000 + F.col("hypothesis") * 180)
    return rows.groupBy("c_mktsegment", "hypothesis").agg(F.every(fits).alias("ok")).where("ok").select("c_mktsegment", "hypothesis")


STATUS = f"SELECT *, CASE WHEN split = 1992 THEN 'too early' WHEN method = '5-LOW' AND task % 5 = 0 THEN 'no scorer' END AS status FROM ({RES})"


def with_status(t):
    return results(t).withColumn("status", F.when(F.col("split") == 1992, "too early").when((F.col("method") == "5-LOW") & (F.col("task") % 5 == 0), "no scorer"))


@query(f"""WITH r AS ({STATUS}), c AS (SELECT method, status, count(*) AS n FROM r GROUP BY 1, 2) SELECT method, CAST(sum(n) AS BIGINT) AS n_attempted, CAST(sum(CASE WHEN status IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_scored, CAST(sum(CASE WHEN status IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_skipped, round(sum(CASE WHEN status IS NULL THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS coverage,
coalesce(string_agg(concat(status, ': ', n), '; ' ORDER BY concat(status, ': ', n)) FILTER (status IS NOT NULL), '') AS reasons FROM c GROUP BY 1""")
def coverage_ledger(t, spark):
    r = with_status(t)
    got = L.ledger(r, r, ["task", "split", "method"], "status", ["method"])
    return got.select("method", *[big(c).alias(c) for c in ("n_attempted", "n_scored", "n_skipped")], r6("coverage").alias("coverage"), "reasons")


@query(f"""WITH r AS ({STATUS}) SELECT method, count(*) AS n_attempted, count(CASE WHEN status IS NULL THEN 1 END) AS n_scored, count(status) AS n_skipped, round(count(CASE WHEN status IS NULL THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM r GROUP BY 1""")
def merged_coverage(t, spark):
    """Ledgers of two disjoint slices of tasks as one."""
    r = with_status(t)
    parts = [L.ledger(s, s, ["task", "split", "method"], "status", ["method"]) for s in (r.where("task < 10"), r.where("task >= 10"))]
    return L.merged_ledgers(parts, ["method"]).select("method", *[big(c).alias(c) for c in ("n_attempted", "n_scored", "n_skipped")], r6("coverage").alias("coverage"))


@query(f"""WITH r AS ({RES}), d AS (SELECT task, split, max(CASE WHEN method = '1-URGENT' THEN error END) - max(CASE WHEN method = '2-HIGH' THEN error END) AS gap, count(*) AS n FROM r GROUP BY 1, 2), c AS (SELECT * FROM d WHERE gap IS NOT NULL) SELECT task, count(*) AS seeds, round(avg(split), 4) AS rate, round(avg(gap), 4) AS gap FROM c GROUP BY 1""")
def seed_paired_gap(t, spark):
    cells = results(t).withColumn("rate", F.col("split").cast("double"))
    got = L.paired_gap(cells, ["task"], "split", "method", "1-URGENT", "2-HIGH", "error", "rate")
    return got.select("task", "seeds", F.round("rate", 4).alias("rate"), F.round("gap", 4).alias("gap"))


@query(f"""WITH r AS ({RES}), s AS (SELECT task, method, avg(error) AS mean, stddev_samp(error) AS sd, count(*) AS n FROM r GROUP BY 1, 2), p AS (SELECT *, least(1e0, 2 * exp(-abs(mean - 15e4) / (sd / sqrt(n)))) AS p FROM s WHERE n > 1), a AS (SELECT *, least(1e0, p * (count(*) OVER (PARTITION BY method) - row_number() OVER (PARTITION BY method ORDER BY p, task) + 1)) AS adj FROM p)
SELECT task, method, round(mean, 1) AS mean, round(sd, 1) AS sd, round(max(adj) OVER (PARTITION BY method ORDER BY p, task), 5) AS p_holm FROM a""")
def seeds_with_pooled_family(t, spark):
    """Mean and deviation over seeds of two merged runs, and a step-down adjustment over the pooled family."""
    r = results(t)
    both = L.merged_runs([r.where("task < 7"), r.where("task >= 7")], ["task", "method", "split"])
    s = both.groupBy("task", "method").agg(F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"), F.count("*").alias("n")).where("n > 1")
    p = s.withColumn("p", F.least(F.lit(1.0), 2 * F.exp(-F.abs(F.col("mean") - 15e4) / (F.col("sd") / F.sqrt("n")))))
    return U.family(p, ["method"], "task").select("task", "method", F.round("mean", 1).alias("mean"), F.round("sd", 1).alias("sd"), F.round("p_holm", 5).alias("p_holm"))


@query(f"WITH m AS (SELECT DISTINCT method FROM ({RES})) SELECT a.method AS a, b.method AS b, least(1e0, 10e0 / 2001) AS least_p FROM m a JOIN m b ON a.method != b.method WHERE b.method IN ('1-URGENT', '3-MEDIUM') AND (a.method NOT IN ('1-URGENT', '3-MEDIUM') OR b.method < a.method)")
def comparison_family(t, spark):
    m = results(t).select("method").distinct()
    return U.ordered_pairs(m.withColumn("rank", F.col("method")), "method", "rank", ["1-URGENT", "3-MEDIUM"]).withColumn("least_p", U.smallest_adjusted(2000, 10))


@query(f"""WITH s AS (SELECT *, year(o_orderdate) AS k FROM (SELECT o_orderkey, o_orderdate, o_orderpriority AS g, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)), c AS (SELECT g, k, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1, 2)
SELECT g, k, CASE WHEN n < 40 THEN concat(n, ' observed rows, fewer than the 40 required') WHEN pos = 0 OR pos = n THEN 'one class among the observed rows' END AS reason FROM c""")
def horizon_skip_reasons(t, spark):
    c = t("orders").groupBy(F.col("o_orderpriority").alias("g"), F.year("o_orderdate").cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("pos"))
    few = F.concat(F.col("n").cast("string"), F.lit(" observed rows, fewer than the 40 required"))
    return c.select("g", "k", F.when(F.col("n") < 40, few).when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), "one class among the observed rows").alias("reason"))


@query("""WITH c AS (SELECT c_mktsegment AS s, c_nationkey AS v, c_custkey % 3 = 0 AS ctx FROM customer), k AS (SELECT DISTINCT s, v FROM c WHERE ctx) SELECT c.s, count(*) AS n, round(avg(CASE WHEN k.v IS NULL THEN 1e0 ELSE 0e0 END), 6) AS unseen FROM c LEFT JOIN k ON c.s = k.s AND c.v = k.v WHERE NOT ctx GROUP BY 1""")
def unseen_levels(t, spark):
    """The share of rows whose level no context row has."""
    c = t("customer").select(F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("v"), (F.col("c_custkey") % 3 == 0).alias("ctx"))
    known = c.where("ctx").select("s", "v").distinct().withColumn("seen", F.lit(True))
    return c.where("not ctx").join(known, ["s", "v"], "left").groupBy("s").agg(F.count("*").alias("n"), r6(F.avg(F.col("seen").isNull().cast("double"))).alias("unseen"))


@query(f"""WITH s AS (SELECT g, year(o_orderdate) AS fold, y, p FROM ({SC}) JOIN orders ON o_orderkey = _row_id), t AS (SELECT g, fold, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM t WINDOW w AS (PARTITION BY g, fold ORDER BY p DESC)), a AS (SELECT g, fold, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(pos) AS DOUBLE) AS pos, sum(pos * ((cn - n) - (cp - pos) + (n - pos) / 2e0)) AS lost FROM c GROUP BY 1, 2) SELECT g, CAST(fold AS INTEGER) AS fold, round(pos / n, 6) AS rate, CASE WHEN pos > 0 AND pos < n THEN round(1 - lost / (pos * (n - pos)), 6) END AS auc FROM a""")
def arm_fold_table(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("_row_id"), F.year("o_orderdate").alias("fold"))
    return M.rank_metrics(scores(t).join(o, "_row_id"), ["g", "fold"]).select("g", "fold", r6(F.col("positives") / F.col("n")).alias("rate"), r6("auc").alias("auc"))
