"""Weighted and disjoint draws, boosted contexts, features fitted without the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contexts as K
from ..operators.scoring import LogisticScorer
from .metric_queries import SC, scores
from .panel_queries import PANEL, panel
from .registry import h, query, r6

U = f"(({h("concat(_row_id, '|r1')")} + 5e-1) / 4294967296e0)"


@query(f"WITH s AS ({SC}), w AS (SELECT g, _row_id, y, abs(y - p) AS w FROM s), d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY -ln({U}) / w, _row_id) AS k FROM w WHERE w > 0) SELECT g, _row_id, y, round(w, 6) AS w FROM d WHERE k <= 60")
def weighted_contexts(t, spark):
    """Sixty rows of each group, drawn in proportion to the size of their residual."""
    rows = scores(t).withColumn("w", F.abs(F.col("y") - F.col("p")))
    return K.weighted_draw(rows, ["g"], "w", "_row_id", 60, "r1").select("g", "_row_id", "y", r6("w").alias("w"))


@query(None)
def context_boosting(t, spark):
    """Rounds of logistic scorers on contexts of 200 rows of the panel: what each round drew, its step and the loss after it."""
    p = panel(t).select(F.concat_ws("-", "o_custkey", "y").alias("key"), (F.col("total") / 1e5).alias("total"), F.col("n").cast("double").alias("n"), "label")
    fitted = K.BoostedContexts(lambda: LogisticScorer(["total", "n"], "label"), ["total", "n"], "label", "key", rounds=3, size=200).fit(p)
    return spark.createDataFrame([(r["round"], r["rows"], r["positives"], round(r["step"], 6), round(r["loss"], 6)) for r in fitted.history], "round int, rows bigint, positives bigint, step double, loss double")


DRAW = f"""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), e AS (SELECT o_custkey, row_number() OVER (ORDER BY {h("concat(o_custkey, '|entity')")}, o_custkey) AS k FROM (SELECT DISTINCT o_custkey FROM o)),
s AS (SELECT o.*, CASE WHEN k <= 40 THEN 'query' ELSE 'context' END AS side FROM o JOIN e USING (o_custkey)), c AS (SELECT count(CASE WHEN y = 1 THEN 1 END) AS pos, count(*) AS al FROM s WHERE side = 'query'),
p AS (SELECT s.*, CASE WHEN side = 'query' THEN y ELSE -1 END AS part FROM s), r AS (SELECT p.*, row_number() OVER (PARTITION BY side, part ORDER BY {h("concat(o_orderkey, '|row')")}, o_orderkey) AS k, count(*) OVER (PARTITION BY side, part) AS n, CASE part WHEN -1 THEN 300 WHEN 1 THEN 360 ELSE 240 END AS want FROM p)
SELECT o_orderkey, o_custkey, y, side, z + 1 AS copy, round(CASE part WHEN 1 THEN (pos / CAST(al AS DOUBLE)) / 6e-1 WHEN 0 THEN (1 - pos / CAST(al AS DOUBLE)) / 4e-1 END, 6) AS weight FROM r, c, range(0, 600) q(z) WHERE k + z * n <= want"""


@query(DRAW)
def disjoint_rows(t, spark):
    """300 context rows and 600 queries, six in ten positive, of entities that are on one side only; short sides repeat rows."""
    o = t("orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return K.disjoint_draw(o, "o_custkey", "o_orderkey", "y", 40, 300, 600, 0.6).withColumn("weight", r6("weight"))


def _llr(c: str) -> str:
    part = lambda k: f"-5e-1 * (ln({c}v{k}) + ({c} - {c}m{k}) * ({c} - {c}m{k}) / {c}v{k})"
    return f"round({part(1)} - ({part(0)}), 5) AS {c}_llr"


@query(f"WITH p AS (SELECT o_custkey, y, total / 1e5 AS total, CAST(n AS DOUBLE) AS n, label, {h("concat(o_custkey, '|fold')")} % 4 AS fold FROM ({PANEL})), k AS (SELECT f.fold, " + ", ".join(f"avg(CASE WHEN label = {k} THEN {c} END) AS {c}m{k}, var_pop(CASE WHEN label = {k} THEN {c} END) AS {c}v{k}" for c in ("total", "n") for k in (0, 1)) + f" FROM (SELECT DISTINCT fold FROM p) f JOIN p ON p.fold <> f.fold GROUP BY 1) SELECT o_custkey, y, fold, {_llr('total')}, {_llr('n')} FROM p JOIN k USING (fold)")
def crossfit_representation(t, spark):
    """Each firm-year by how likely its values are among the firm-years of each label in the other folds of firms."""
    p = panel(t).select("o_custkey", "y", (F.col("total") / 1e5).alias("total"), F.col("n").cast("double").alias("n"), "label")
    out = K.crossfit_representation(p, "o_custkey", "label", ["total", "n"], 4)
    return out.select("o_custkey", "y", F.col("fold").cast("bigint").alias("fold"), *[F.round(c, 5).alias(c) for c in ("total_llr", "n_llr")])
