"""Scores, calibration, comparisons, retrieval, profiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import scalars as S
from ..operators import comparison as Q
from ..operators import retrieval as N
from ..operators.quantiles import quantiles
from ..operators.tables import settled
from .registry import big, h, query, r6

SC = f"SELECT o_orderkey AS _row_id, o_custkey, o_orderpriority AS g, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS y, round({h('o_orderkey')} / 4294967296e0, 2) AS p FROM orders"


def scores(t):
    return t("orders").select(F.col("o_orderkey").alias("_row_id"), "o_custkey", F.col("o_orderpriority").alias("g"), big(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("y"), F.round(S.uniform("o_orderkey"), 2).alias("p"))


RANK = f"""WITH s AS ({SC}), t AS (SELECT g, p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM s GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY g ORDER BY p DESC) AS cp, sum(pos) OVER (PARTITION BY g) AS tp, sum(n) OVER (PARTITION BY g) AS tn FROM t)"""


@query(f"""{RANK} SELECT g, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(1 - sum(pos * ((cn - n) - (cp - pos) + (n - pos) / 2e0)) / (max(tp) * (max(tn) - max(tp))), 6) AS auc, round(sum(pos * cp / CAST(cn AS DOUBLE)) / max(tp), 6) AS ap, round(max(2e0 * cp / (cn + tp)), 6) AS best_f1 FROM c GROUP BY 1""")
def rank_metrics(t, spark):
    return M.rank_metrics(scores(t), ["g"]).select("g", "n", "positives", r6("auc").alias("auc"), r6("ap").alias("ap"), r6("best_f1").alias("best_f1"))


EDGE = " + ".join(f"CASE WHEN p >= {k}*1e-1 THEN 1 ELSE 0 END" for k in range(1, 10))


@query(f"SELECT g, CAST({EDGE} AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM ({SC}) GROUP BY 1, 2")
def calibration_table(t, spark):
    return M.calibration_table(scores(t), ["g"]).select("g", "bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query(f"""WITH s AS ({SC}), b AS (SELECT g, {EDGE} AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM s GROUP BY 1, 2), e AS (SELECT g, sum(n * abs(m - r)) / sum(n) AS ece FROM b GROUP BY 1),
m AS (SELECT g, avg(y) AS rate, avg(p) AS mean_p, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS log_loss, stddev_pop(p) AS sd, quantile_cont(p, 5e-1) AS p50, quantile_cont(p, 99e-2) AS p99 FROM s GROUP BY 1)
SELECT g, round(ece, 6) AS ece, round(brier, 6) AS brier, round(1 - brier / (rate * (1 - rate)), 6) AS brier_skill, round(log_loss, 5) AS log_loss, round(sqrt(brier), 6) AS rmse, round(sd, 6) AS sd, round(p99 / p50, 6) AS ratio, sd = 0 OR p99 / p50 < 15e-1 AS near_constant FROM e JOIN m USING (g)""")
def score_card(t, spark):
    got = M.scorecard(scores(t), ["g"])
    return got.select("g", *[r6(c).alias(c) for c in ("ece", "brier", "brier_skill")], F.round("log_loss", 5).alias("log_loss"), *[r6(c).alias(c) for c in ("rmse", "sd", "ratio")], "near_constant")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p DESC, _row_id) AS r FROM ({SC})) SELECT g, CAST(sum(CASE WHEN r <= 100 THEN y ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN r <= 100 THEN y ELSE 0 END) / CAST(sum(y) AS DOUBLE), 6) AS recall FROM r GROUP BY 1""")
def recall_at_top(t, spark):
    return M.recall_at(scores(t), ["g"], F.lit(100)).select("g", "hits", r6("recall").alias("recall"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p DESC, _row_id) AS r, count(*) OVER (PARTITION BY g) AS n, sum(y) OVER (PARTITION BY g) AS pos FROM ({SC})), t AS (SELECT *, ceil(n / 10e0) AS k FROM r), c AS (SELECT *, sum(y) OVER (PARTITION BY g ORDER BY r) AS hits FROM t WHERE r <= k)
SELECT g, round(sum(hits / CAST(r AS DOUBLE) * y) / max(least(k, pos)), 6) AS ap_top_decile FROM c GROUP BY 1""")
def top_decile_precision(t, spark):
    return M.ap_top_decile(scores(t), ["g"]).select("g", r6("ap_top_decile").alias("ap_top_decile"))


@query(f"""WITH s AS (SELECT g, p, (o_custkey % 50) AS q FROM ({SC})), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2e0 AS a, rank() OVER (PARTITION BY g ORDER BY q) + (count(*) OVER (PARTITION BY g, q) - 1) / 2e0 AS b FROM s) SELECT g, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman_correlation(t, spark):
    return M.spearman(scores(t).withColumn("q", F.col("o_custkey") % 50), ["g"], "p", "q").select("g", r6("rho").alias("rho"))


@query("""WITH f AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_size * p_size) / 25e2 * 5e-2 END AS p FROM part), a AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1e0, p * (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p NULLS LAST, p_partkey) + 1)) END AS adj FROM f)
SELECT p_partkey, round(CASE WHEN p IS NOT NULL THEN max(adj) OVER (PARTITION BY p_brand ORDER BY p NULLS LAST, p_partkey) END, 6) AS p_holm FROM a""")
def holm_adjustment(t, spark):
    f = t("part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 11 == 0, None).otherwise(F.col("p_size") * F.col("p_size") / 2500.0 * 0.05).alias("p"))
    return M.holm(f, ["p_brand"], "p", "p_partkey").select("p_partkey", r6("p_holm").alias("p_holm"))


RES = "SELECT c_nationkey AS task, o_orderpriority AS method, year(o_orderdate) AS split, round(avg(o_totalprice), 6) AS error FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3"


def results(t):
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.groupBy(F.col("c_nationkey").alias("task"), F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("split")).agg(F.round(F.avg("o_totalprice"), 6).alias("error"))


@query(f"WITH r AS ({RES}) SELECT a.method AS a, b.method AS b, CAST(sum(CASE WHEN a.error < b.error THEN 1e0 WHEN a.error = b.error THEN 5e-1 ELSE 0e0 END) AS DOUBLE) AS wins, count(*) AS played FROM r a JOIN r b USING (task, split) WHERE a.method != b.method GROUP BY 1, 2")
def pairwise_wins(t, spark):
    return Q.win_matrix(results(t), ["task", "split"], "method", "error")


@query(f"""WITH r AS ({RES}), w AS (SELECT task, avg(CASE WHEN method = '1-URGENT' THEN error END) AS c, avg(CASE WHEN method = '5-LOW' THEN error END) AS r FROM r GROUP BY 1), k AS (SELECT count(CASE WHEN c < r THEN 1 END) AS wins, count(CASE WHEN c > r THEN 1 END) AS losses, count(CASE WHEN c = r THEN 1 END) AS ties FROM w),
b AS (SELECT wins, losses, ties, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1)) * pow(5e-1, wins + losses)) FROM range(0, 1000) x(i) WHERE i <= least(wins, losses)) AS tail FROM k) SELECT wins, losses, ties, round(least(1e0, 2 * tail), 6) AS p FROM b""")
def paired_sign_test(t, spark):
    return Q.sign_test(results(t), ["task"], "method", "error", "1-URGENT", "5-LOW").select("wins", "losses", "ties", r6("p").alias("p"))


@query(f"WITH r AS ({RES}), k AS (SELECT method, rank() OVER (PARTITION BY task, split ORDER BY error) + (count(*) OVER (PARTITION BY task, split, error) - 1) / 2e0 AS r FROM r) SELECT method, round(avg(r), 6) AS mean_rank FROM k GROUP BY 1")
def average_rank_table(t, spark):
    return Q.average_ranks(results(t), ["task", "split"], "method", "error").select("method", r6("mean_rank").alias("mean_rank"))


@query(f"""WITH r AS ({RES}), d AS (SELECT task, split, max(CASE WHEN method = '1-URGENT' THEN error END) - max(CASE WHEN method = '5-LOW' THEN error END) AS d FROM r GROUP BY 1, 2), a AS (SELECT task, avg(d) AS m, count(CASE WHEN d > 0 THEN 1 END) AS up, count(CASE WHEN d < 0 THEN 1 END) AS down FROM d GROUP BY 1)
SELECT task, CASE WHEN m > 2e3 AND up >= 4 THEN 'helps' WHEN m < -2e3 AND down >= 4 THEN 'hurts' END AS verdict FROM a""")
def fold_verdicts(t, spark):
    d = results(t).groupBy("task", "split").agg((F.max(F.when(F.col("method") == "1-URGENT", F.col("error"))) - F.max(F.when(F.col("method") == "5-LOW", F.col("error")))).alias("d"))
    return Q.verdict(d, ["task"], "d", 2000.0, 4).select("task", "verdict")


@query(f"""WITH r AS ({RES}), m AS (SELECT task, method, avg(error) AS m, stddev_samp(error) AS sd, count(*) AS n FROM r GROUP BY 1, 2) SELECT method, count(*) AS tasks, round(avg(m), 4) AS mean, min_by(task, struct_pack(m := m, t := task)) AS lowest, max_by(task, struct_pack(m := m, t := task)) AS highest FROM m GROUP BY 1""")
def spread_over_tasks(t, spark):
    m = results(t).groupBy("task", "method").agg(F.avg("error").alias("m"))
    return m.groupBy("method").agg(F.count("*").alias("tasks"), F.round(F.avg("m"), 4).alias("mean"), F.min_by("task", F.struct("m", "task")).alias("lowest"), F.max_by("task", F.struct("m", "task")).alias("highest"))


@query(f"WITH r AS ({RES}) SELECT method, task, round(CAST(sum(CAST(error AS DECIMAL(28, 6))) AS DOUBLE) / count(*), 3) AS mean, count(*) AS n FROM r GROUP BY GROUPING SETS ((method, task), (method), ())")
def grouping_sets_spread(t, spark):
    """Means over several groupings; decimal sums don't depend on the order of rows."""
    mean = F.round(F.sum(F.col("error").cast("decimal(28,6)")).cast("double") / F.count("*"), 3)
    return results(t).groupingSets([["method", "task"], ["method"], []], "method", "task").agg(mean.alias("mean"), F.count("*").alias("n"))


@query(f"WITH r AS ({RES}), m AS (SELECT method, split, avg(error) AS e, count(*) AS n FROM r GROUP BY 1, 2) SELECT method, round(regr_slope(e, log10(split - 1990)), 1) AS slope, round(regr_r2(e, log10(split - 1990)), 5) AS r2, round(max_by(e, split) - min_by(e, split), 6) AS gain FROM m GROUP BY 1")
def curve_shape(t, spark):
    m = results(t).groupBy("method", "split").agg(F.avg("error").alias("e"))
    x = F.log10(F.col("split") - 1990.0)
    return m.groupBy("method").agg(F.round(F.regr_slope("e", x), 1).alias("slope"), F.round(F.regr_r2("e", x), 5).alias("r2"), F.round(F.max_by("e", "split") - F.min_by("e", "split"), 6).alias("gain"))


@query(f"""WITH s AS ({SC}), a AS (SELECT g, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM s GROUP BY 1) SELECT g, n, pos, least(pos, n - pos) AS minority, round(-n * (pos / CAST(n AS DOUBLE) * log2(pos / CAST(n AS DOUBLE)) + (1 - pos / CAST(n AS DOUBLE)) * log2(1 - pos / CAST(n AS DOUBLE))), 3) AS bits, round(2e0 * n * (pos / CAST(n AS DOUBLE)) * (1 - pos / CAST(n AS DOUBLE)), 3) AS effective FROM a""")
def context_information(t, spark):
    a = scores(t).groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    p = F.col("pos") / F.col("n")
    return a.select("g", "n", "pos", F.least(F.col("pos"), F.col("n") - F.col("pos")).alias("minority"), F.round(F.col("n") * S.entropy_bits(p), 3).alias("bits"), F.round(2.0 * F.col("n") * p * (1 - p), 3).alias("effective"))


@query("""WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem), m AS (SELECT g, avg(x) AS m FROM v GROUP BY 1), c AS (SELECT v.g, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 4)) AS m4, quantile_cont(abs(x), 999e-3) / quantile_cont(abs(x), 75e-2) AS tail FROM v JOIN m USING (g) GROUP BY 1) SELECT g, round(m4 / (m2 * m2) - 3, 5) AS kurtosis, round(tail, 5) AS tail FROM c""")
def tail_statistics(t, spark):
    v = t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x"))
    tails = quantiles(v, ["g"], F.abs(F.col("x")), [0.999, 0.75]).select("g", F.round(F.col("q")[0] / F.col("q")[1], 5).alias("tail"))
    return v.groupBy("g").agg(F.round(F.kurtosis("x"), 5).alias("kurtosis")).join(tails, "g")


@query(f"SELECT g, round((a * (1 - a) + (pos - 1) * (a / (2 - a) - a * a) + (neg - 1) * (2 * a * a / (1 + a) - a * a)) / (pos * neg), 8) AS v FROM (SELECT g, 75e-2 AS a, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM ({SC}) GROUP BY 1)")
def auc_variance(t, spark):
    a = scores(t).groupBy("g").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    return a.select("g", F.round(M.hanley_mcneil(F.lit(0.75), F.col("pos"), F.col("neg")), 8).alias("v"))


@query(f"""WITH s AS ({SC}), a AS (SELECT g, sum(CASE WHEN y = 1 AND p < 5e-1 OR y = 0 AND p >= 5e-1 THEN 1 ELSE 0 END) AS m, count(*) AS n FROM s GROUP BY 1), l AS (SELECT g, m * ln(49e-2) + (n - m) * ln(51e-2) AS l FROM a) SELECT g, round(exp(l - (SELECT max(l) FROM l)) / (SELECT sum(exp(l - (SELECT max(l) FROM l))) FROM l), 6) AS posterior FROM l""")
def hypothesis_posterior(t, spark):
    wrong = ((F.col("y") == 1) & (F.col("p") < 0.5)) | ((F.col("y") == 0) & (F.col("p") >= 0.5))
    logs = scores(t).groupBy("g").agg(F.count_if(wrong).alias("m"), F.count("*").alias("n")).select("g", (F.col("m") * F.log(F.lit(0.49)) + (F.col("n") - F.col("m")) * F.log(F.lit(0.51))).alias("l"))
    top = logs.agg(F.max("l").alias("top"))  # a row for each hypothesis goes in, one comes out
    w = logs.crossJoin(F.broadcast(top)).withColumn("w", F.exp(F.col("l") - F.col("top")))
    return w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("all")))).select("g", r6(F.col("w") / F.col("all")).alias("posterior"))


@query("""SELECT c.column_name AS feature, CAST(c.missing AS DOUBLE) AS missing, c.distinct_n FROM (SELECT 'value' AS column_name, round(avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing, count(DISTINCT v) AS distinct_n FROM (SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS v FROM events) UNION ALL SELECT 'user_id', 0, count(DISTINCT user_id) FROM events) c""")
def panel_profile(t, spark):
    from ..operators.conditioning import long_form

    e = t("events").select(F.when(F.col("event_id") % 6 == 0, None).otherwise(F.col("value")).alias("value"), "user_id")
    return long_form(e, [], ["value", "user_id"]).groupBy("feature").agg(r6(F.avg(F.col("value").isNull().cast("double"))).alias("missing"), F.count_distinct("value").alias("distinct_n"))


VEC = "SELECT vec_id, label, CAST(label = 3 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
ST = f"SELECT [{', '.join(f'quantile_cont(v[{i}], 5e-1)' for i in range(1, 65))}] AS c, [{', '.join(f'greatest(quantile_cont(v[{i}], 75e-2) - quantile_cont(v[{i}], 25e-2), 1e-6)' for i in range(1, 65))}] AS s FROM ({VEC})"
ZV = f"SELECT vec_id, label, y, [{', '.join(f'(v[{i}] - c[{i}]) / s[{i}]' for i in range(1, 65))}] AS z FROM ({VEC}), ({ST})"
PAIRS = f"SELECT q.vec_id AS q, x.vec_id AS r, x.y, round(list_distance(q.z, x.z), 9) AS distance FROM ({ZV}) q JOIN ({ZV}) x ON x.vec_id != q.vec_id WHERE q.vec_id % 20 = 0"


def vectors(t):
    v = t("embeddings").select("vec_id", (F.col("label") == 3).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    z = settled(N.scaled(v, N.distance_stats(v, "v", 64), "v"), "scaled")
    return z, z.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "v")


def neighbours(t, k, per_class=None):
    context, queries = vectors(t)
    return N.nearest(context.withColumnRenamed("vec_id", "r"), queries, "v", "r", "q", "y", k, per_class, but_self=True)


@query(f"SELECT q, r, y FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, r) AS k FROM ({PAIRS})) WHERE k <= 8")
def nearest_context(t, spark):
    return neighbours(t, 8).select("q", "r", "y")


@query(f"SELECT q, r, y FROM (SELECT *, row_number() OVER (PARTITION BY q, y ORDER BY distance, r) AS k FROM ({PAIRS})) WHERE k <= CASE WHEN y = 1 THEN 3 ELSE 5 END")
def nearest_per_class(t, spark):
    return neighbours(t, 0, {0: 5, 1: 3}).select("q", "r", "y")


@query(f"""WITH p AS ({PAIRS}), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, r) AS k, row_number() OVER (PARTITION BY q, y ORDER BY distance, r) AS c FROM p), n AS (SELECT *, sum(CASE WHEN y = 1 AND k <= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS pos FROM k)
SELECT q, r, y FROM n WHERE (y = 1 AND (k <= 8 OR c <= 3)) OR (y = 0 AND c <= 8 - greatest(pos, 3))""")
def nearest_with_floor(t, spark):
    near, pos = neighbours(t, 8), neighbours(t, 0, {0: 1, 1: 3}).where("y = 1")
    return N.with_floor(near, pos, "q", "r", "y", 8, 3).select("q", "r", "y")


@query(f"""WITH k AS (SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY distance, r) AS k FROM ({PAIRS})), v AS (SELECT q, (sum(y) + 5e-1) / (count(*) + 1e0) AS p FROM k WHERE k <= 8 GROUP BY 1), c AS (SELECT avg(y) AS true_rate FROM ({VEC})), d AS (SELECT ln(true_rate / (1 - true_rate)) - ln(avg(p) / (1 - avg(p))) AS d FROM v, c GROUP BY true_rate)
SELECT q, round(p, 6) AS raw, round(1 / (1 + exp(-(ln(p / (1 - p)) + d))), 6) AS shifted FROM v, d""")
def neighbour_vote_prior_shift(t, spark):
    votes = neighbours(t, 8).groupBy("q").agg(((F.sum("y") + 0.5) / (F.count("*") + 1.0)).alias("p"))
    rate = vectors(t)[0].agg(F.avg("y").alias("true_rate"))
    delta = votes.agg(F.avg("p").alias("pooled")).crossJoin(rate).select(N.base_rate_shift(F.col("pooled"), F.col("true_rate")).alias("d"))  # one row
    return votes.crossJoin(F.broadcast(delta)).select("q", r6("p").alias("raw"), r6(N.shifted(F.col("p"), F.col("d"))).alias("shifted"))


@query(f"""WITH k AS (SELECT r, row_number() OVER (PARTITION BY q ORDER BY distance, r) AS k FROM ({PAIRS})) SELECT r, count(*) AS hits FROM k WHERE k <= 8 GROUP BY 1""")
def retrieval_hubs(t, spark):
    return neighbours(t, 8).groupBy("r").agg(F.count("*").alias("hits"))


@query(f"""WITH s AS (SELECT y, least(greatest(p, 1e-2), 99e-2) AS p FROM ({SC})), g AS (SELECT CAST(i AS DOUBLE) / 4 - 3 AS lt FROM range(0, 25) x(i)), l AS (SELECT lt, avg(-(y * ln(1 / (1 + exp(-ln(p / (1 - p)) / exp(lt)))) + (1 - y) * ln(1 - 1 / (1 + exp(-ln(p / (1 - p)) / exp(lt)))))) AS loss FROM s, g GROUP BY 1) SELECT min_by(lt, round(loss, 9)) AS log_temperature, round(min(loss), 6) AS loss FROM l""")
def temperature_by_grid(t, spark):
    s = scores(t).select("y", S.clip("p", F.lit(0.01), F.lit(0.99)).alias("p"))
    z = S.logit(F.col("p"))
    grid = [i / 4 - 3 for i in range(25)]
    losses = s.agg(*[F.avg(-(F.col("y") * F.log(1 / (1 + F.exp(-z / F.exp(F.lit(g))))) + (1 - F.col("y")) * F.log(1 - 1 / (1 + F.exp(-z / F.exp(F.lit(g))))))).alias(f"l{i}") for i, g in enumerate(grid)])
    each = losses.select(F.explode(F.array(*[F.struct(F.round(f"l{i}", 9).alias("r"), F.lit(g).alias("lt"), F.col(f"l{i}").alias("loss")) for i, g in enumerate(grid)])).alias("x"))
    return each.agg(F.min("x").alias("x")).select(F.col("x.lt").alias("log_temperature"), r6("x.loss").alias("loss"))


@query(f"WITH s AS ({SC}), a AS (SELECT g, CAST(sum(y) AS DOUBLE) AS total, count(*) AS n FROM s GROUP BY 1) SELECT _row_id, round((total - y) / (n - 1), 6) AS left_out_mean FROM s JOIN a USING (g)")
def leave_one_out_mean(t, spark):
    w = W.partitionBy("g")
    return scores(t).select("_row_id", r6((F.sum("y").over(w).cast("double") - F.col("y")) / (F.count("*").over(w) - 1)).alias("left_out_mean"))


@query("""WITH d AS (SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2), k AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY v DESC, n) AS r FROM d), x AS (SELECT s, list(n) AS ns FROM k WHERE r <= 10 GROUP BY 1)
SELECT a.s AS a, b.s AS b, round(len(list_intersect(a.ns, b.ns)) / CAST(len(list_distinct(list_concat(a.ns, b.ns))) AS DOUBLE), 6) AS jaccard FROM x a JOIN x b ON a.s < b.s""")
def top_k_jaccard(t, spark):
    d = t("customer").groupBy(F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("n")).agg(F.sum("c_acctbal").alias("v"))
    x = d.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy(F.desc("v"), "n"))).where("r <= 10").groupBy("s").agg(F.collect_list("n").alias("ns"))
    a, b = x.select(F.col("s").alias("a"), F.col("ns").alias("na")), x.select(F.col("s").alias("b"), F.col("ns").alias("nb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", r6(F.size(F.array_intersect("na", "nb")) / F.size(F.array_union("na", "nb"))).alias("jaccard"))
