"""Splits, folds, quotas, feature conditioning, temporal features and survival labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conditioning as C
from ..operators import splits as P
from ..operators import temporal as T
from .registry import big, h, query, r6
from .relational_queries import FACTS, facts

PANEL = f"SELECT o_custkey, y, round(sum(o_totalprice), 2) AS total, count(*) AS n, CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS label FROM ({FACTS}) GROUP BY 1, 2"


def panel(t):
    return facts(t).groupBy("o_custkey", "y").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"), big(F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))).alias("label"))


ORDERS_T = "SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) / 86400 AS DOUBLE) AS t FROM orders"


def orders_t(t):
    return t("orders").select("o_orderkey", "o_custkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6).alias("t"))


@query(f"""WITH p AS ({ORDERS_T}), e AS (SELECT quantile_cont(t, 5e-1) AS a, quantile_cont(t, 2e0/3e0) AS b, quantile_cont(t, 5e0/6e0) AS c FROM p),
w AS (SELECT 0 AS split, a AS start, b AS stop FROM e UNION ALL SELECT 1, b, c FROM e UNION ALL SELECT 2, c, CAST('infinity' AS DOUBLE) FROM e),
x AS (SELECT p.*, w.split, CASE WHEN t >= start AND t < stop THEN 'test' WHEN t < start - 30 THEN 'train' END AS part FROM p, w)
SELECT CAST(split AS BIGINT) AS split, part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM x WHERE part = 'test' OR (part = 'train' AND NOT EXISTS (SELECT 1 FROM x z WHERE z.part = 'test' AND z.split = x.split AND z.o_custkey = x.o_custkey)) GROUP BY 1, 2""")
def out_of_time_splits(t, spark):
    return P.out_of_time(orders_t(t), "o_custkey", "t", 30.0).groupBy("split", "part").agg(F.count("*").alias("n"), big(F.sum("o_orderkey")).alias("keys"))


@query(f"""WITH p AS ({FACTS}), x AS (SELECT *, CASE WHEN y <= 1997 THEN 'train' WHEN y >= 2000 THEN 'test' END AS part FROM p)
SELECT part, count(*) AS n FROM x WHERE part = 'test' OR (part = 'train' AND o_custkey NOT IN (SELECT o_custkey FROM x WHERE part = 'test')) GROUP BY 1""")
def time_based_split(t, spark):
    return P.by_time(facts(t), "o_custkey", "y", F.lit(1997), F.lit(2000)).groupBy("part").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY {h('c_custkey')}, c_custkey) - 1) % 5 AS BIGINT) AS fold FROM customer")
def country_preserving_folds(t, spark):
    return P.dealt_folds(t("customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], 5).select("c_custkey", "fold")


@query(f"""WITH f AS (SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY {h('c_custkey')}, c_custkey) - 1) % 5 AS fold FROM customer)
SELECT CASE WHEN fold = 2 THEN 'val' WHEN fold = 3 THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM f GROUP BY 1""")
def fold_roles(t, spark):
    f = P.dealt_folds(t("customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], 5)
    return f.select(P.roles(F.col("fold"), 2, 5).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h('o_orderkey')}, o_orderkey) AS k FROM orders) WHERE k <= 40")
def quota_per_class(t, spark):
    return P.take_per_class(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], F.lit(40), ["o_orderkey"])


@query(f"SELECT o_orderkey FROM orders ORDER BY {h('o_orderkey')}, o_orderkey LIMIT 500")
def cap_panel_rows(t, spark):
    return P.cap_rows(t("orders").select("o_orderkey"), 500, ["o_orderkey"])


@query(f"""WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY {h('o_custkey')} RANGE UNBOUNDED PRECEDING) AS total FROM s)
SELECT o_custkey, n FROM c WHERE total <= 3000 OR total = n""")
def whole_entity_cap(t, spark):
    return P.whole_entities(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 3000).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {h('o_orderkey')}, o_orderkey) AS k FROM orders) WHERE k = 1")
def one_row_per_entity(t, spark):
    return P.one_per_entity(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


@query(f"""WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT s, n, row_number() OVER (ORDER BY n, s) AS i FROM c), k AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h('o_orderkey')}, o_orderkey) AS r FROM orders)
SELECT o_orderstatus, count(*) AS n FROM k GROUP BY 1, r <= 300 HAVING max(r) <= 300""")
def balanced_context(t, spark):
    return P.quota_sample(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 900, ["o_orderkey"], balanced=True).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({PANEL}), s AS (SELECT quantile_cont(total, 1e-2) AS lo, quantile_cont(total, 99e-2) AS hi, quantile_cont(total, 5e-1) AS m, quantile_cont(total, 75e-2) - quantile_cont(total, 25e-2) AS iqr FROM p WHERE y <= 1998),
z AS (SELECT o_custkey, y, (least(greatest(total, lo), hi) - m) / iqr AS z FROM p, s) SELECT o_custkey, y, round(z / sqrt(1 + (z / 3e0) * (z / 3e0)), 6) AS value FROM z""")
def winsor_squash(t, spark):
    p = panel(t)
    params = C.fit_conditioner(p.where("y <= 1998"), ["total"])
    return C.apply_conditioner(p, params, ["o_custkey", "y"], ["total"]).select("o_custkey", "y", r6("value").alias("value"))


TE = f"SELECT o_orderkey, o_orderpriority AS level, CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS y, {h('o_orderkey')} % 5 AS fold FROM orders"


def te(t):
    return t("orders").select("o_orderkey", F.col("o_orderpriority").alias("level"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"), S.bucket(5, "o_orderkey").alias("fold"))


@query(f"""WITH t AS ({TE}), p AS (SELECT avg(y) AS prior FROM t), f AS (SELECT level, fold, sum(y) AS s, count(*) AS n FROM t GROUP BY 1, 2), w AS (SELECT level, sum(s) AS ws, sum(n) AS wn FROM f GROUP BY 1)
SELECT t.o_orderkey, round((ws - s + 10 * prior) / (wn - n + 10), 6) AS encoded FROM t JOIN f USING (level, fold) JOIN w USING (level), p""")
def out_of_fold_encoding(t, spark):
    return C.out_of_fold(te(t), "level", "y", "fold", "encoded").select("o_orderkey", r6("encoded").alias("encoded"))


@query(f"""WITH t AS ({TE}), tr AS (SELECT * FROM t WHERE fold < 3 AND level != '1-URGENT'), p AS (SELECT avg(y) AS prior FROM tr), l AS (SELECT level, (sum(y) + 10 * max(prior)) / (count(*) + 10) AS v FROM tr, p GROUP BY 1)
SELECT t.o_orderkey, round(coalesce(l.v, prior), 6) AS encoded, l.v IS NULL AS unseen FROM t LEFT JOIN l USING (level), p WHERE fold >= 3""")
def target_encoding_apply(t, spark):
    rows = te(t)
    levels = C.fit_levels(rows.where("fold < 3 and level != '1-URGENT'"), "level", "y")
    got = C.apply_levels(rows.where("fold >= 3"), levels, "level", "encoded", F.lit(None).cast("double"))
    prior = levels.select("prior").limit(1)
    return got.crossJoin(F.broadcast(prior)).select("o_orderkey", r6(F.coalesce("encoded", "prior")).alias("encoded"), F.col("encoded").isNull().alias("unseen"))


@query(f"""WITH t AS ({TE}) SELECT round(avg(CASE WHEN k.level IS NULL THEN 1e0 ELSE 0e0 END), 6) AS unseen_share FROM t LEFT JOIN (SELECT DISTINCT level FROM t WHERE fold < 3 AND level != '1-URGENT') k USING (level) WHERE t.fold >= 3""")
def unseen_level_share(t, spark):
    rows = te(t)
    known = rows.where("fold < 3 and level != '1-URGENT'").select("level").distinct().withColumn("known", F.lit(1))
    return rows.where("fold >= 3").join(known, "level", "left").agg(r6(F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0))).alias("unseen_share"))


@query("""WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS i FROM part GROUP BY 1)
SELECT p_partkey, CAST(CASE WHEN p_size % 9 != 0 THEN CASE WHEN p_brand = (SELECT p_brand FROM k WHERE i = 0) THEN 1 ELSE 0 END END AS BIGINT) AS brand_0, CAST(CASE WHEN p_size % 9 != 0 THEN CASE WHEN p_brand = (SELECT p_brand FROM k WHERE i = 1) THEN 1 ELSE 0 END END AS BIGINT) AS brand_1 FROM part""")
def one_hot_top_levels(t, spark):
    p = t("part")
    levels = C.top_levels(p, "p_brand", 2)
    masked = p.withColumn("b", F.when(F.col("p_size") % 9 != 0, F.col("p_brand")))
    return C.one_hot(masked, "b", levels, "brand").select("p_partkey", "brand_0", "brand_1")


@query("""WITH s AS (SELECT list_sort(list_distinct([quantile_cont(p_retailprice, 25e-2), quantile_cont(p_retailprice, 5e-1), quantile_cont(p_retailprice, 75e-2)])) AS e, min(p_retailprice) AS low FROM part), q AS (SELECT list_filter(e, lambda x: x > low) AS edges FROM s),
b AS (SELECT p_partkey, p_retailprice, CAST(len(list_filter(edges, lambda e: e <= p_retailprice)) AS BIGINT) AS bin FROM part, q), m AS (SELECT bin, avg(p_retailprice) AS rep FROM b GROUP BY 1) SELECT p_partkey, bin, round(rep, 6) AS rep FROM b JOIN m USING (bin)""")
def quantile_bins(t, spark):
    p = t("part").select("p_partkey", "p_retailprice")
    got = p.crossJoin(F.broadcast(C.fit_bins(p, "p_retailprice", 4)))  # one row of edges
    bin_ = S.edges_below(F.col("p_retailprice"), F.col("edges"))
    return got.select("p_partkey", big(bin_).alias("bin"), r6(F.element_at("representatives", bin_ + 1)).alias("rep"))


@query("""WITH c AS (SELECT l_returnflag AS g, l_extendedprice AS v, l_linenumber <= 4 AS ctx, l_orderkey, l_linenumber, l_partkey FROM lineitem), t AS (SELECT g, v, CAST(sum(CASE WHEN ctx THEN 1 ELSE 0 END) AS BIGINT) AS c FROM c GROUP BY 1, 2),
r AS (SELECT g, v, c, sum(c) OVER (PARTITION BY g ORDER BY v) AS le, sum(c) OVER (PARTITION BY g) AS n FROM t) SELECT g, v, round((2 * le - c) / CAST(n AS DOUBLE) - 1, 6) AS ecdf FROM r""")
def mid_rank_ecdf(t, spark):
    c = t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), (F.col("l_linenumber") <= 4).alias("ctx"))
    return C.mid_ecdf(c, ["g"], "v", "ctx").select("g", "v", r6("ecdf").alias("ecdf")).distinct()


@query(f"""WITH p AS ({PANEL}) SELECT o_custkey, y, round(log(1 + greatest(total, 0)) / log(exp(1)), 6) AS log_total, round(total / nullif(n - 3, 0), 4) AS ratio, CAST(sign(n - 2) AS DOUBLE) AS s, CASE WHEN n > 2 AND label = 1 THEN round(total + n, 2) END AS partial FROM (SELECT o_custkey, y, total, n, label FROM p)""")
def guarded_ratios(t, spark):
    p = panel(t)
    partial = S.sum_any(F.when((F.col("n") > 2) & (F.col("label") == 1), F.col("total")), F.when((F.col("n") > 2) & (F.col("label") == 1), F.col("n").cast("double")))
    return p.select("o_custkey", "y", r6(F.log1p(F.greatest("total", F.lit(0.0)))).alias("log_total"), F.round(S.divide("total", F.col("n") - 3), 4).alias("ratio"), F.signum(F.col("n") - 2).cast("double").alias("s"), F.round(partial, 2).alias("partial"))


@query(f"""WITH p AS ({PANEL}), k AS (SELECT a.o_custkey, a.y, a.total, b.total AS b1, count(c.total) AS n, sum(c.y - a.y) AS sk, sum(c.total) AS sx, sum((c.y - a.y) * c.total) AS skx, sum((c.y - a.y) * (c.y - a.y)) AS skk FROM p a LEFT JOIN p b ON b.o_custkey = a.o_custkey AND b.y = a.y - 1 JOIN p c ON c.o_custkey = a.o_custkey AND c.y BETWEEN a.y - 3 AND a.y GROUP BY 1, 2, 3, 4)
SELECT o_custkey, y, round(total - b1, 3) AS delta, round(CASE WHEN n >= 3 THEN (n * skx - sk * sx) / (n * skk - sk * sk) END, 3) AS trend FROM k""")
def trajectory_features(t, spark):
    shifted = panel(t).withColumn("y", F.col("y") - 1998)
    return T.trajectory(shifted, "o_custkey", "y", "total").select("o_custkey", (F.col("y") + 1998).alias("y"), F.round("delta", 3).alias("delta"), F.round("trend", 3).alias("trend"))


@query(f"""WITH p AS ({PANEL}), w AS (SELECT o_custkey, y, n, lag(n) OVER (PARTITION BY o_custkey ORDER BY y) AS b FROM p) SELECT o_custkey, count(CASE WHEN b IS NOT NULL THEN 1 END) AS steps, count(CASE WHEN n < b THEN 1 END) AS falls, count(CASE WHEN n < b THEN 1 END) = 0 AS monotone FROM w GROUP BY 1""")
def curve_coherence(t, spark):
    return T.curve_coherence(panel(t), ["o_custkey"], "y", "n")


HAZ = f"SELECT o_orderkey, [{', '.join(f'({h(f'concat(CAST(o_orderkey AS VARCHAR), chr(124), {k!r})')} / 4294967296e0) * 3e-1' for k in ('0', '1', '2', '3'))}] AS hz FROM orders"


def hazards(t):
    return t("orders").select("o_orderkey", F.array(*[S.uniform("o_orderkey", F.lit(str(k))) * 0.3 for k in range(4)]).alias("hz"))


@query(f"SELECT o_orderkey, round(1 - (1 - hz[1]), 6) AS c1, round(1 - (1 - hz[1]) * (1 - hz[2]), 6) AS c2, round(1 - (1 - hz[1]) * (1 - hz[2]) * (1 - hz[3]) * (1 - hz[4]), 6) AS c4 FROM ({HAZ})")
def cumulative_default_curve(t, spark):
    c = hazards(t).select("o_orderkey", T.cumulative_from_hazards(F.col("hz")).alias("c"))
    return c.select("o_orderkey", r6(F.col("c")[0]).alias("c1"), r6(F.col("c")[1]).alias("c2"), r6(F.col("c")[3]).alias("c4"))


@query(f"SELECT o_orderkey, round(least(hz[1], hz[2]), 6) AS m2, round(least(hz[1], hz[2], hz[3], hz[4]), 6) AS m4, round(1 - hz[1], 6) AS first_mass, round(least(hz[1], hz[2]) - least(hz[1], hz[2], hz[3]), 6) AS third_mass FROM ({HAZ})")
def monotone_survival_masses(t, spark):
    m = hazards(t).select("o_orderkey", T.running_least(F.col("hz")).alias("m"))
    s = m.withColumn("s", T.steps_of(F.col("m")))
    return s.select("o_orderkey", r6(F.col("m")[1]).alias("m2"), r6(F.col("m")[3]).alias("m4"), r6(F.col("s")[0]).alias("first_mass"), r6(F.col("s")[2]).alias("third_mass"))


@query(f"""WITH p AS ({FACTS}), d AS (SELECT DISTINCT o_custkey, y FROM p), l AS (SELECT d.o_custkey, d.y, [CASE WHEN d.y + 1 <= 2000 THEN CASE WHEN EXISTS (SELECT 1 FROM d e WHERE e.o_custkey = d.o_custkey AND e.y = d.y + 1) THEN 1 ELSE 0 END END, CASE WHEN d.y + 2 <= 2000 THEN CASE WHEN EXISTS (SELECT 1 FROM d e WHERE e.o_custkey = d.o_custkey AND e.y = d.y + 2) THEN 1 ELSE 0 END END] AS x FROM d)
SELECT o_custkey, y, CAST(CASE WHEN x[1] IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN x[2] IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_observed, CAST(CASE WHEN x[1] = 1 THEN 0 WHEN x[2] = 1 THEN 1 ELSE -1 END AS BIGINT) AS period, coalesce(x[1] = 1, false) OR coalesce(x[2] = 1, false) AS any_default, CAST(CASE WHEN x[2] < x[1] THEN 1 ELSE 0 END AS BIGINT) AS falls FROM l""")
def survival_period_labels(t, spark):
    from ..operators import relational as R

    f = facts(t)
    got = R.censored_labels(f.select("o_custkey", "y").distinct(), f, ("o_custkey", "y"), 2, F.lit(2000))
    return got.select("o_custkey", "y", *[c.alias(k) for k, c in T.period_labels(F.col("labels")).items()])


@query(f"""WITH x AS (SELECT o_orderkey, hz, CAST(o_orderkey % 6 AS BIGINT) - 1 AS p FROM ({HAZ})), y AS (SELECT o_orderkey, hz, CASE WHEN p >= 4 THEN -1 ELSE p END AS p, CAST(o_orderkey % 4 + 1 AS BIGINT) AS obs FROM x)
SELECT round(avg(-(CASE WHEN (CASE WHEN p >= 0 THEN p ELSE obs END) > 0 THEN ln(1 - hz[1]) ELSE 0 END + CASE WHEN (CASE WHEN p >= 0 THEN p ELSE obs END) > 1 THEN ln(1 - hz[2]) ELSE 0 END + CASE WHEN (CASE WHEN p >= 0 THEN p ELSE obs END) > 2 THEN ln(1 - hz[3]) ELSE 0 END + CASE WHEN (CASE WHEN p >= 0 THEN p ELSE obs END) > 3 THEN ln(1 - hz[4]) ELSE 0 END) - CASE WHEN p >= 0 THEN ln(hz[CAST(p AS INTEGER) + 1]) ELSE 0 END), 6) AS loss FROM y""")
def survival_log_loss(t, spark):
    p = big(F.col("o_orderkey") % 6) - 1
    x = hazards(t).withColumns({"p": F.when(p >= 4, -1).otherwise(p), "obs": big(F.col("o_orderkey") % 4 + 1)})
    return x.select(r6(F.avg(T.survival_loss(F.col("hz"), F.col("p"), F.col("obs")))).alias("loss"))


@query(f"""WITH f AS ({FACTS}), ev AS (SELECT o_custkey, min(o_orderdate) AS failed FROM f WHERE o_orderstatus = 'P' GROUP BY 1), cut AS (SELECT max(o_orderdate) AS c FROM f), r AS (SELECT f.o_orderkey, f.o_orderdate + INTERVAL 35 DAY AS opens, f.o_orderdate + INTERVAL 401 DAY AS closes, ev.failed, cut.c FROM f LEFT JOIN ev USING (o_custkey), cut WHERE f.o_orderstatus != 'P')
SELECT CAST(CASE WHEN failed > opens AND failed <= closes THEN 1 ELSE 0 END AS BIGINT) AS label, count(*) AS n FROM r WHERE closes <= c AND (failed IS NULL OR failed > opens) GROUP BY 1""")
def lagged_horizon_frame(t, spark):
    f = facts(t)
    failed = f.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("failed"))
    cut = f.agg(F.max("o_orderdate").alias("cut"))  # one row
    r = f.where("o_orderstatus != 'P'").join(failed, "o_custkey", "left").crossJoin(F.broadcast(cut)).withColumns({"opens": F.col("o_orderdate") + F.expr("INTERVAL 35 DAYS"), "closes": F.col("o_orderdate") + F.expr("INTERVAL 401 DAYS")})
    kept = r.where("closes <= cut and (failed is null or failed > opens)")
    return kept.groupBy(big(F.coalesce((F.col("failed") <= F.col("closes")), F.lit(False)).cast("int")).alias("label")).agg(F.count("*").alias("n"))
