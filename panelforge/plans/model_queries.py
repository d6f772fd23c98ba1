"""Fitted scorers, clusters, Elo and bootstrap: results without a SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import scalars as S
from ..operators import bootstrap, comparison, scoring, splits
from .metric_queries import results, scores
from .panel_queries import panel
from .registry import big, query, r6


@query(None)
def logistic_out_of_time(t, spark):
    """A logistic baseline fitted before a cut and scored after it, by year."""
    p = panel(t).withColumn("total", F.col("total") / 1e5)
    placed = splits.by_time(p, "o_custkey", "y", F.lit(1997), F.lit(1999))
    model = scoring.LogisticScorer(["total", "n"], "label").fit(placed.where("part = 'train'"))
    return M.rank_metrics(model.score(placed.where("part = 'test'")), ["y"], "label", "p").select("y", "n", "positives", r6("auc").alias("auc"), r6("ap").alias("ap"))


@query(None)
def out_of_fold_logistic(t, spark):
    p = panel(t).withColumn("total", F.col("total") / 1e5)
    return scoring.out_of_fold_scores(p, "o_custkey", lambda: scoring.LogisticScorer(["total", "n"], "label")).select("o_custkey", "y", r6("p").alias("p"))


@query(None)
def label_tree_contexts(t, spark):
    placed = scoring.leaf_contexts(panel(t), ["total"], "label")
    return placed.groupBy("leaf", "usable").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query(None)
def clustered_query_groups(t, spark):
    g = scoring.query_groups(t("embeddings").select("vec_id", "embedding"), "embedding", 8, 40, "vec_id")
    return g.groupBy("group").agg(F.count("*").alias("n"))


@query(None)
def prototype_context(t, spark):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") == 3).cast("int").alias("y"))
    return scoring.prototypes(e, "embedding", "vec_id", "y", 40).select("vec_id", "y")


@query(None)
def random_feature_ridge(t, spark):
    p = panel(t).select(F.concat_ws("-", "o_custkey", "y").alias("_row_id"), (F.col("total") / 1e5).alias("total"), F.col("n").cast("double").alias("n"))
    got = scoring.ridge_on_random_features(p, ["total"], "n", width=16)
    return spark.createDataFrame([(float(a), float(e), a == got["alpha"]) for a, e in got["errors"].items()], "alpha double, error double, best boolean")


@query(None)
def elo_ratings(t, spark):
    r = results(t)
    return comparison.elo_table(r, "task", ["split"], "method", "error", "3-MEDIUM").select("method", *[F.round(c, 3).alias(c) for c in ("elo", "low", "high")])


@query(None)
def paired_bootstrap(t, spark):
    s = scores(t).withColumn("b", S.uniform("_row_id", F.lit("b")))
    got = bootstrap.paired_difference(s, "o_custkey", "y", "p", "b")
    return got.select(r6("diff").alias("diff"), big("drawn").alias("drawn"), r6("low").alias("low"), r6("high").alias("high"), r6("p").alias("p"))
