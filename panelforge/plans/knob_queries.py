"""Knobs of generated tables, samplers, target transforms, mixed partitions and boosted scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import knobs as K
from ..operators import targets as G
from .metric_queries import SC, scores
from .registry import big, h, query, r6

CUST = "SELECT c_custkey AS k, c_mktsegment AS g, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer"


def cust(t):
    return t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("g"), F.when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_acctbal")).alias("x"))


def u(key: str) -> str:
    return f"({h(key)} / 4294967296e0)"


@query(f"WITH c AS ({CUST}), m AS (SELECT g, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY 1) SELECT k, round(CASE WHEN x IS NULL THEN 0 ELSE (x - m) / s END, 6) AS z, CASE WHEN x IS NOT NULL THEN round((exp(15e-1 * (x - m) / s) - exp(-15e-1 * (x - m) / s)) / 2 / 15e-1, 6) END AS heavy FROM c JOIN m USING (g)")
def shaped_columns(t, spark):
    z = K.standardised(cust(t), ["g"], "x", "z")
    return K.heavy_tail(z, ["g"], "x", 1.5, "heavy").select("k", r6("z").alias("z"), r6("heavy").alias("heavy"))


@query(f"""WITH c AS ({CUST}), b AS (SELECT min(x) AS lo, max(x) AS hi, quantile_cont(x, 3e-1) AS cut FROM c) SELECT k, round(round_even((x - lo) / (hi - lo) * 6, 0) / 6 * (hi - lo) + lo, 6) AS tied, CASE WHEN x IS NOT NULL AND {u("concat(k, '|pm')")} < 25e-2 THEN 0e0 ELSE x END AS mass, round(greatest(x - cut, CASE WHEN x IS NOT NULL THEN 0e0 END), 6) AS zeros FROM c, b""")
def tie_columns(t, spark):
    c = cust(t)
    b = c.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).crossJoin(K.quantiles(c, [], "x", [0.3]).select(F.col("q")[0].alias("cut")))  # one row
    x = c.crossJoin(F.broadcast(b))
    return x.select("k", r6(K.tied(F.col("x"), F.col("lo"), F.col("hi"), 7)).alias("tied"), K.point_mass(F.col("x"), "k", 0.25, F.lit(0.0), "pm").alias("mass"), r6(K.zero_inflated(F.col("x"), F.col("cut"))).alias("zeros"))


@query(None)
def zipf_category_codes(t, spark):
    """Codes of quantile bins with Zipf sizes; how many rows each code has."""
    return K.unordered_codes(cust(t), "x", 5, 1.0, "s", "code").groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH c AS (SELECT * FROM ({CUST}) WHERE x IS NOT NULL) SELECT k, round(((row_number() OVER (PARTITION BY g ORDER BY x, k) - 1) / CAST(count(*) OVER (PARTITION BY g) - 1 AS DOUBLE) - 5e-1) * 2, 6) AS r FROM c")
def rank_activation(t, spark):
    return K.rank_activation(cust(t).where("x is not null"), ["g"], "x", "k", "r").select("k", r6("r").alias("r"))


@query("WITH p AS (SELECT p_partkey, [p_size / 1e1, p_retailprice / 1e3, -p_size / 2e1] AS v FROM part), e AS (SELECT p_partkey, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM p) SELECT p_partkey, round(e[1] / list_sum(e), 6) AS soft, round(greatest(v[1], 0e0) / list_sum(list_transform(v, lambda x: greatest(x, 0e0))), 6) AS share FROM e")
def row_activations(t, spark):
    v = F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0, -F.col("p_size") / 20.0)
    return t("part").select("p_partkey", r6(K.softmax(v)[0]).alias("soft"), r6(K.shares_of(v)[0]).alias("share"))


@query(f"WITH c AS (SELECT * FROM ({CUST}) WHERE x IS NOT NULL), q AS (SELECT quantile_cont(x, 6e-1) AS cut FROM c WHERE k % 2 = 0) SELECT k, CAST(x > cut AS BIGINT) AS x, g AS label, CAST(x > cut AS BIGINT) AS y FROM c, q")
def swapped_tasks(t, spark):
    """A column cut at a quantile of the context rows becomes the label, and the label a column."""
    c = cust(t).where("x is not null").withColumn("label", F.col("g"))
    b = K.binarised(c, "x", F.col("k") % 2 == 0, 0.6, "y")
    return K.swapped(K.swapped(b, "label", "y"), "x", "label").select("k", F.col("x").alias("x"), F.col("y").alias("label"), F.col("x").alias("y"))


@query(f"SELECT _row_id, y AS kept, 1 - y AS inverted, y * 0 AS none, CASE WHEN {u("concat(_row_id, '|flip')")} < 2e-1 THEN 1 - y ELSE y END AS flipped, CAST(o_custkey % 2 AS BIGINT) AS unrelated FROM ({SC})")
def context_label_conditions(t, spark):
    y, key = F.col("y"), F.col("_row_id")
    return scores(t).select("_row_id", K.context_labels(y, "true", key).alias("kept"), K.context_labels(y, "inverted", key).alias("inverted"), K.context_labels(y, "none", key).alias("none"), K.context_labels(y, "flip_0.2", key).alias("flipped"), K.context_labels(y, "unrelated", key, F.col("o_custkey") % 2).alias("unrelated"))


@query(f"SELECT _row_id, CASE WHEN {u("concat(_row_id, '|m')")} >= 3e-1 THEN round(p * 15e-1 + 2, 6) END AS x, y FROM ({SC})")
def nuisance_axes(t, spark):
    return scores(t).select("_row_id", r6(K.nuisance(F.col("p"), "_row_id", "m", 0.3, 2.0, 0.5)).alias("x"), "y")


PART = "SELECT p_partkey AS k, p_size / 1e1 AS a, p_retailprice / 1e3 AS b FROM part"


@query(f"""WITH p AS ({PART}) SELECT k, round(a * 1e-2, 6) AS sa, round(b * 1e-1, 6) AS sb, b AS pa, a AS pb, a AS da, round(round_even(a * 4, 0) / 4, 6) AS ca, CASE WHEN {h("concat(k, '|a')")} % 5 > 0 THEN a END AS ma FROM p""")
def schema_edits(t, spark):
    """One table under each layout edit, side by side."""
    p = t("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 1000.0).alias("b"))
    take = lambda edit, **names: K.edited_schema(p, ["a", "b"], edit, "k").select("k", *[F.col(c).alias(n) for n, c in names.items()])
    out = take("scaled", sa="a", sb="b").join(take("permuted", pa="a", pb="b"), "k").join(take("duplicated", da="a_again"), "k").join(take("discretised", ca="a"), "k").join(take("missing", ma="a"), "k")
    return out.select("k", r6("sa").alias("sa"), r6("sb").alias("sb"), "pa", "pb", "da", r6("ca").alias("ca"), "ma")


@query(f"WITH p AS (SELECT c_custkey AS k, {u("concat(c_custkey, '|source')")} AS u FROM customer) SELECT CASE WHEN u < 5e-1 THEN 'financial' WHEN u < 8e-1 THEN 'graph' ELSE 'tree' END AS source, count(*) AS n FROM p GROUP BY 1")
def drawn_sources(t, spark):
    """Tasks by the generator that a hash draws for them, by weights."""
    return t("customer").select(K.drawn_source("c_custkey", {"financial": 5, "graph": 3, "tree": 2}).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT late, k, round(c, 9) AS cdf FROM (SELECT false AS late, i AS k, (1 - pow(7e-1, i + 1)) / (1 - pow(7e-1, 5)) AS c FROM range(0, 5) r(i) UNION ALL SELECT true, i, (pow(7e-1, 4 - i) - pow(7e-1, 5)) / (1 - pow(7e-1, 5)) FROM range(0, 5) r(i))")
def regime_distributions(t, spark):
    rows = [(late, k, round(c, 9)) for late in (False, True) for k, c in enumerate(K.regime_distribution(5, 0.7, late))]
    return spark.createDataFrame(rows, "late boolean, k bigint, cdf double")


@query("SELECT c_custkey, CAST(6 AS INTEGER) AS years, true AS ends_right FROM customer")
def macro_paths(t, spark):
    """Paths made by recursion: their length, and whether the backward one ends at the value given (the twin states both)."""
    c = t("customer").select("c_custkey", K.persistent_path("c_custkey", 6, 0.8, 0.3).alias("p"), K.cycle_to(F.col("c_acctbal"), "c_custkey", 6, 0.6).alias("m"), "c_acctbal")
    return c.select("c_custkey", F.size("p").alias("years"), ((F.element_at("m", -1) == F.col("c_acctbal")) & (F.size("m") == 6) & F.forall("p", lambda x: F.abs(x) < 10)).alias("ends_right"))


@query(f"""WITH s AS (SELECT * FROM ({SC})), c AS (SELECT sum(y) AS pos, count(*) - sum(y) AS neg FROM s) SELECT 5e-2 AS rate, CAST(floor(neg * 5e-2 / 95e-2) AS BIGINT) AS positives, CAST(neg AS BIGINT) AS negatives FROM c""")
def rate_thinned_rows(t, spark):
    """Rows at a positive rate of 5 %: negatives whole, positives thinned."""
    got = K.rate_thinned(scores(t), "y", 0.05, ["_row_id"])
    return got.agg(F.sum("y").alias("positives"), F.sum(1 - F.col("y")).alias("negatives")).select(F.lit(0.05).alias("rate"), "positives", "negatives")


@query(f"""WITH p AS (SELECT _row_id, y FROM ({SC})), d AS (SELECT * FROM p WHERE y = 0 ORDER BY _row_id LIMIT 60), i AS (SELECT _row_id FROM p WHERE y = 1 ORDER BY {h("concat(_row_id, '|in')")}, _row_id LIMIT 12), o AS (SELECT _row_id FROM d ORDER BY {h("concat(_row_id, '|out')")}, _row_id LIMIT 12) SELECT _row_id, CAST(1 AS BIGINT) AS y FROM i UNION ALL SELECT _row_id, y FROM d WHERE _row_id NOT IN (SELECT _row_id FROM o)""")
def both_classes_drawn(t, spark):
    """A draw without positives is topped up to twelve with real rows of the panel."""
    p = scores(t).select("_row_id", "y")
    return K.both_classes(p, p.where("y = 0").orderBy("_row_id").limit(60), "y", "_row_id", 12)


@query(f"""WITH s AS (SELECT _row_id, g FROM ({SC})), f AS (SELECT s.*, i AS fold, {h("concat(i, '|', _row_id)")} AS h FROM s, range(0, 3) r(i)), r AS (SELECT *, rank() OVER (PARTITION BY fold, g ORDER BY h) + count(*) OVER (PARTITION BY fold, g, h) - 1 AS e, count(*) OVER (PARTITION BY fold, g) AS n FROM f)
SELECT fold, g, count(*) AS n, count(CASE WHEN n > 1 AND e <= round_even(n * 25e-2, 0) THEN 1 END) AS test, CAST(sum(CASE WHEN n > 1 AND e <= round_even(n * 25e-2, 0) THEN _row_id ELSE 0 END) AS BIGINT) AS keys FROM r GROUP BY 1, 2""")
def shuffle_folds(t, spark):
    got = K.shuffle_folds(scores(t).select("_row_id", "g"), "g", ["_row_id"], 3, 0.25)
    test = F.col("part") == "test"
    return got.groupBy("fold", "g").agg(F.count("*").alias("n"), F.count_if(test).alias("test"), F.sum(F.when(test, F.col("_row_id")).otherwise(0)).alias("keys"))


@query(f"""WITH s AS (SELECT y, CAST(g AS VARCHAR) AS a, CAST(_row_id % 3 AS VARCHAR) AS b, CAST(round(p * 4) AS VARCHAR) AS c FROM ({SC})), l AS (SELECT 'a' AS feature, a AS v, y FROM s UNION ALL SELECT 'b', b, y FROM s), n AS (SELECT feature, v, y, count(*) AS n FROM l GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY feature, v) AS nv, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM n) SELECT feature, round(sum(n / CAST(t AS DOUBLE) * ln(n * CAST(t AS DOUBLE) / (nv * ny))), 8) AS mi FROM m GROUP BY 1""")
def mutual_information(t, spark):
    s = scores(t).select("y", F.col("g").alias("a"), (F.col("_row_id") % 3).alias("b"))
    return K.mutual_information(s, ["a", "b"], "y").select("feature", F.round("mi", 8).alias("mi"))


@query(f"WITH c AS ({CUST}), q AS (SELECT DISTINCT unnest(quantile_disc(x, [1e0 / 6, 2e0 / 6, 5e-1, 4e0 / 6, 5e0 / 6])) AS t FROM c), u AS (SELECT t FROM q WHERE t < (SELECT max(x) FROM c)) SELECT (SELECT count(*) FROM u WHERE t < x) AS interval, count(*) AS n, round(avg(x), 6) AS mean FROM c WHERE x IS NOT NULL GROUP BY 1")
def threshold_intervals(t, spark):
    c = cust(t)
    return G.interval_means(c, "x", G.thresholds(c, "x", 5)).select("interval", "n", r6("mean").alias("mean"))


@query(f"""WITH c AS (SELECT o_orderkey, o_totalprice AS v FROM orders), b AS (SELECT min(v) AS lo, max(v) AS hi FROM c) SELECT o_orderkey, round(greatest(exp(ln(1 + v) + ln(11234567e-7)) - 1, 0), 2) AS smeared, round(least(greatest(v * 2, lo - 1e-1 * (hi - lo)), hi + 1e-1 * (hi - lo)), 4) AS clipped, round(ln((v / hi * 8e-1 + 1e-1) / (9e-1 - v / hi * 8e-1)), 6) AS z FROM c, b""")
def target_readout(t, spark):
    c = t("orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    x = c.crossJoin(F.broadcast(G.clip_bounds(c, "v", 0.1))).crossJoin(F.broadcast(c.agg(F.max("v").alias("hi"))))  # one row each
    p = F.col("v") / F.col("hi") * 0.8 + 0.1
    return x.select("o_orderkey", F.round(G.log_inverse(F.log1p("v"), 1.1234567), 2).alias("smeared"), F.round(F.least(F.greatest(F.col("v") * 2, F.col("low")), F.col("high")), 4).alias("clipped"), r6(G.clipped_logit(p)).alias("z"))


@query(f"SELECT _row_id, round(p * 7e-1, 6) AS a, round((1 - p) * 7e-1, 6) AS b, 3e-1 AS c FROM ({SC})")
def leaf_mixed_with_global(t, spark):
    """A leaf that knows two of three classes takes the third from the whole model."""
    leaf = F.create_map(F.lit("a"), F.col("p"), F.lit("b"), 1 - F.col("p"))
    whole = F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.2), F.lit("c"), F.lit(0.3))
    m = G.filled_from_global(leaf, whole, ["a", "b", "c"])
    return scores(t).select("_row_id", *[r6(F.element_at(m, c)).alias(c) for c in "abc"])


@query(f"WITH s AS (SELECT *, abs(y - p) AS r FROM ({SC})), m AS (SELECT g, avg(r) AS m, avg(exp(r)) AS e, count(*) AS n FROM s GROUP BY 1) SELECT _row_id, round((r + 1e-12 * m) / ((m + 1e-12 * m) * n), 9) AS a, round(exp(r) / (e * n), 9) AS e FROM s JOIN m USING (g)")
def residual_weights(t, spark):
    s = scores(t).withColumn("r", F.col("y") - F.col("p"))
    a = G.residual_weights(s, ["g"], "r").withColumnRenamed("weight", "a")
    return G.residual_weights(a, ["g"], "r", "exp").select("_row_id", F.round("a", 9).alias("a"), F.round("weight", 9).alias("e"))


@query(f"WITH s AS (SELECT g, y, p - 5e-1 AS h FROM ({SC})), k AS (SELECT i * 2e0 / 64 AS gamma FROM range(0, 65) r(i)), l AS (SELECT g, gamma, avg(greatest(gamma * h, 0) + ln(1 + exp(-abs(gamma * h))) - y * gamma * h) AS loss FROM s, k GROUP BY 1, 2) SELECT g, min_by(gamma, struct_pack(l := round(loss, 9), g := gamma)) AS gamma, round(min(loss), 6) AS loss FROM l GROUP BY 1")
def boosting_line_search(t, spark):
    s = scores(t).select("g", "y", F.lit(0.0).alias("f"), (F.col("p") - 0.5).alias("h"))
    return G.line_search(s, ["g"], "f", "h", "y", 2.0).select("g", "gamma", r6("loss").alias("loss"))


@query(f"""WITH s AS (SELECT _row_id, g, y, p - 5e-1 AS h1, CAST(_row_id % 3 AS DOUBLE) - 1 AS h2 FROM ({SC})), k AS (SELECT i * 1e0 / 64 AS gamma FROM range(0, 65) r(i)), l1 AS (SELECT g, gamma, avg(greatest(gamma * h1, 0) + ln(1 + exp(-abs(gamma * h1))) - y * gamma * h1) AS loss FROM s, k GROUP BY 1, 2), g1 AS (SELECT g, min_by(gamma, struct_pack(l := round(loss, 9), g := gamma)) AS a FROM l1 GROUP BY 1),
f AS (SELECT s.*, a * h1 AS f FROM s JOIN g1 USING (g)), l2 AS (SELECT g, gamma, avg(greatest(f + gamma * h2, 0) + ln(1 + exp(-abs(f + gamma * h2))) - y * (f + gamma * h2)) AS loss FROM f, k GROUP BY 1, 2), g2 AS (SELECT g, min_by(gamma, struct_pack(l := round(loss, 9), g := gamma)) AS b FROM l2 GROUP BY 1) SELECT _row_id, round(f + b * h2, 6) AS score FROM f JOIN g2 USING (g)""")
def boosted_contexts(t, spark):
    """Two weak scores added in turn, each with the step of its own line search by group."""
    s = scores(t)
    got = G.boosted_scores(s, ["g"], "y", [F.col("p") - 0.5, (F.col("_row_id") % 3).cast("double") - 1], 1.0)
    return got.select("_row_id", r6("score").alias("score"))


@query(f"""WITH p AS (SELECT c_custkey AS k, {u("concat(c_custkey, '|z1')")} AS x1, {u("concat(c_custkey, '|z2')")} AS z FROM customer), o AS (SELECT k, CAST(CASE WHEN z > 5e-1 THEN 1 ELSE 0 END AS BIGINT) AS zc, CAST(CASE WHEN x1 < (CASE WHEN z > 5e-1 THEN 8e-1 ELSE 2e-1 END) THEN 1 ELSE 0 END AS BIGINT) AS x, CAST(CASE WHEN x1 < 5e-1 THEN 1 ELSE 0 END AS BIGINT) AS dx FROM p)
SELECT count(*) AS n, CAST(sum(x * zc) AS BIGINT) AS together, CAST(sum(dx * zc) AS BIGINT) AS intervened, round(sum(x * zc) / CAST(sum(x) AS DOUBLE), 6) AS seen, round(sum(dx * zc) / CAST(sum(dx) AS DOUBLE), 6) AS done FROM o""")
def observed_and_intervened(t, spark):
    """A confounder z moves x; setting x by a coin of its own cuts the link."""
    q = lambda s: S.uniform("c_custkey", F.lit(s))
    z = (q("z2") > 0.5).cast("bigint")
    o = t("customer").select(z.alias("zc"), (q("z1") < F.when(z == 1, 0.8).otherwise(0.2)).cast("bigint").alias("x"), (q("z1") < 0.5).cast("bigint").alias("dx"))
    both = lambda c: F.sum(F.col(c) * F.col("zc"))
    return o.agg(F.count("*").alias("n"), both("x").alias("together"), both("dx").alias("intervened"), r6(both("x") / F.sum("x")).alias("seen"), r6(both("dx") / F.sum("dx")).alias("done"))


@query(f"SELECT c_custkey, CAST({u("concat(c_custkey, '|ca')")} < 6e-1 AS BIGINT) AS a, CAST({u("concat(c_custkey, '|cb')")} < 3e-1 AS BIGINT) AS b, CAST({u("concat(c_custkey, '|ca')")} < 6e-1 AND {u("concat(c_custkey, '|cb')")} < 3e-1 AS BIGINT) AS composed FROM customer")
def composed_rules(t, spark):
    """Labels of two rules over columns of their own, and of both together."""
    a, b = (S.uniform("c_custkey", F.lit(s)) < p for s, p in (("ca", 0.6), ("cb", 0.3)))
    return t("customer").select("c_custkey", big(a).alias("a"), big(b).alias("b"), big(a & b).alias("composed"))


@query("""WITH a AS (SELECT md5(CAST(c_nationkey AS VARCHAR)) AS h, c_mktsegment AS s FROM customer), n AS (SELECT s, count(DISTINCT h) AS n FROM a GROUP BY 1), p AS (SELECT a.s AS candidate, b.s AS reference, count(DISTINCT a.h) AS shared FROM a JOIN a b ON a.h = b.h AND a.s != b.s GROUP BY 1, 2), c AS (SELECT candidate, reference, shared, round(shared / CAST(n AS DOUBLE), 6) AS share FROM p JOIN n ON n.s = candidate), r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY share >= 5e-1 DESC, share DESC, reference) AS r FROM c) SELECT candidate, reference, shared, share, share >= 5e-1 AS overlaps FROM r WHERE r = 1""")
def best_content_match(t, spark):
    """The reference that holds most of a candidate's hashes, for every candidate."""
    from ..operators.overlap import best_match, content_report

    c = t("customer").select(F.col("c_mktsegment").alias("name"), F.md5(F.col("c_nationkey").cast("string")).alias("h"))
    return best_match(content_report(c, c, "name", "h")).select("candidate", "reference", "shared", r6("share").alias("share"), "overlaps")


@query(f"""WITH c AS (SELECT k, g, x FROM ({CUST}) WHERE x IS NOT NULL) SELECT 'x' AS feature, count(*) AS n, round(quantile_cont(x, 1e-1), 4) AS p10, round(quantile_cont(x, 5e-1), 4) AS p50, round(quantile_cont(x, 9e-1), 4) AS p90, round(avg(CASE WHEN x BETWEEN 0 AND 5000 THEN 1e0 ELSE 0e0 END), 6) AS inside FROM c""")
def quantile_profile(t, spark):
    c = cust(t).where("x is not null")
    q = K.quantiles(c, [], "x", [0.1, 0.5, 0.9])
    one = c.agg(F.count("*").alias("n"), r6(F.avg(F.col("x").between(0, 5000).cast("double"))).alias("inside"))
    return one.crossJoin(q).select(F.lit("x").alias("feature"), "n", *[F.round(F.col("q")[i], 4).alias(f"p{p}") for i, p in enumerate((10, 50, 90))], "inside")  # one row each


@query(f"""WITH s AS (SELECT _row_id, y, p FROM ({SC})), o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {h("concat(_row_id, '|ctx')")}, _row_id) AS r FROM s), w AS (SELECT *, CASE WHEN r <= 8 THEN 0 ELSE 1 END AS late FROM o), z AS (SELECT _row_id, y, row_number() OVER (ORDER BY late, {h("concat(_row_id, '|ctx')")}, _row_id) AS place FROM w) SELECT place, _row_id, y FROM z WHERE place <= 64""")
def context_floor(t, spark):
    """The first 64 places of a task in which each class has eight rows; classes and places are few, the rest is cut before."""
    order = S.hash32("_row_id", F.lit("ctx"))
    s = scores(t).select("_row_id", "y").withColumn("o", order)
    # each class sends its first 64 rows
    front = s.withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("o", "_row_id"))).where("r <= 64")
    placed = front.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.when(F.col("r") <= 8, 0).otherwise(1), "o", "_row_id")))
    return placed.where("place <= 64").select(big("place").alias("place"), "_row_id", "y")
