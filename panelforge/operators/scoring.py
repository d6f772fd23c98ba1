"""Scorers: context rows and query rows in, a probability for each query row out."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bucket, hash32
from .quantiles import quantiles


class InContextScorer(Protocol):
    """fit takes labelled rows (with a group column if they have one), score adds a column p to rows."""

    def fit(self, rows: DataFrame) -> InContextScorer: ...

    def score(self, rows: DataFrame) -> DataFrame: ...


class LogisticScorer:
    """Logistic regression over standardised features; nulls are filled by 0 after a median shift."""

    def __init__(self, features: list[str], label: str, penalty: float = 1e-3):
        self.features, self.label, self.penalty = features, label, penalty

    def fit(self, rows: DataFrame) -> LogisticScorer:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in self.features])).alias("x")
        found = {r.c: r.q[0] for r in quantiles(rows.select(cells).select("x.*"), ["c"], "v", [0.5]).collect()}  # a row for each feature
        self.medians = {c: found.get(c) for c in self.features}
        stages = [VectorAssembler(inputCols=self.features, outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol=self.label, regParam=self.penalty, maxIter=50, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")]
        self.model = Pipeline(stages=stages).fit(self._filled(rows.where(F.col(self.label).isNotNull())))
        return self

    def _filled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians[c] or 0.0))) for c in self.features})

    def score(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._filled(rows)).withColumn("p", vector_to_array("__p")[1]).drop("__x", "__z", "__r", "__p", "__y")


def out_of_fold_scores(rows: DataFrame, unit: str, make, folds: int = 3) -> DataFrame:
    """Every row scored by a model fitted on the other folds; units (entities) are whole in a fold."""
    placed = rows.withColumn("__fold", bucket(folds, unit))
    out = None
    for k in range(folds):
        some = make().fit(placed.where(F.col("__fold") != k)).score(placed.where(F.col("__fold") == k))
        out = some if out is None else out.unionByName(some)
    return out.drop("__fold")


def leaf_contexts(rows: DataFrame, features: list[str], label: str, depth: int = 3, least_rows: int = 50, least_class: int = 5) -> DataFrame:
    """Adds leaf (of a shallow tree fitted on the label) and usable: enough rows, and enough of each class."""
    filled = rows.na.fill(0.0, features)
    x = VectorAssembler(inputCols=features, outputCol="__x").transform(filled)
    tree = DecisionTreeClassifier(featuresCol="__x", labelCol=label, maxDepth=depth, seed=1, leafCol="leaf", predictionCol="__y", rawPredictionCol="__r", probabilityCol="__p").fit(x)
    placed = tree.transform(x).drop("__x", "__r", "__p", "__y").withColumn("leaf", F.col("leaf").cast("bigint"))
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("__n"), F.sum(F.col(label).cast("bigint")).alias("__pos"))
    usable = (F.col("__n") >= least_rows) & (F.least(F.col("__pos"), F.col("__n") - F.col("__pos")) >= least_class)
    return placed.join(F.broadcast(sizes.select("leaf", usable.alias("usable"))), "leaf")  # at most 2 ** depth rows


def query_groups(rows: DataFrame, vector: str, groups: int, most: int, row: str) -> DataFrame:
    """Adds cluster and group: k-means clusters, those of more than `most` rows cut up."""
    x = rows.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=groups, seed=1, featuresCol="__x", predictionCol="cluster", maxIter=10).fit(x)
    placed = model.transform(x).drop("__x")
    part = F.floor((F.row_number().over(W.partitionBy("cluster").orderBy(hash32(row), row)) - 1) / most)
    return placed.withColumn("group", F.concat_ws("-", "cluster", part.cast("string")))


def prototypes(rows: DataFrame, vector: str, row: str, label: str, context: int, minority_ratio: float = 0.5) -> DataFrame:
    """A context of whole rows: of each majority cluster the row nearest its centre, and minority rows up to a ratio."""
    minority = int(context * minority_ratio)
    major = rows.where(F.col(label) == 0).withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=max(1, context - minority), seed=1, featuresCol="__x", predictionCol="__c", maxIter=10).fit(major)
    centres = [c.tolist() for c in model.clusterCenters()]
    at = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    d = F.aggregate(F.zip_with(vector, F.element_at(at, F.col("__c") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = model.transform(major).groupBy("__c").agg(F.min_by(row, F.struct(d.alias("d"), F.col(row))).alias(row)).select(row)
    few = rows.where(F.col(label) == 1).select(row).orderBy(hash32(row), row).limit(minority)
    return rows.join(best.union(few), row, "left_semi")


def ridge_on_random_features(rows: DataFrame, features: list[str], target: str, width: int = 64, seed: int = 5, alphas: tuple[float, ...] = (1e-3, 1e-1, 10.0), folds: int = 3, unit: str = "_row_id") -> dict:
    """Ridge on random Fourier features. Sufficient statistics (width + 1 squared) are added up by fold on the executors;
    folds are left out by subtraction, and only those small matrices come to the driver. Returns alpha, weights, errors."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(len(features), width)), rng.uniform(0, 2 * np.pi, width)

    def stats(batches):
        sums: dict[int, list] = {}
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            z = np.sqrt(2 / width) * np.cos(np.nan_to_num(x) @ w + b)
            z = np.hstack([z, np.ones((len(z), 1))])
            y = pdf[target].to_numpy(float)
            for k in np.unique(pdf["__fold"]):
                m = (pdf["__fold"] == k).to_numpy()
                s = sums.setdefault(int(k), [np.zeros((width + 1, width + 1)), np.zeros(width + 1), 0.0, 0])
                s[0] += z[m].T @ z[m]
                s[1] += z[m].T @ y[m]
                s[2] += float(y[m] @ y[m])
                s[3] += int(m.sum())
        yield pd.DataFrame([{"fold": k, "gram": s[0].ravel().tolist(), "zy": s[1].tolist(), "yy": s[2], "n": s[3]} for k, s in sums.items()], columns=["fold", "gram", "zy", "yy", "n"])

    placed = rows.select(*features, target, bucket(folds, unit).alias("__fold"))
    parts = placed.mapInPandas(stats, "fold int, gram array<double>, zy array<double>, yy double, n long")
    tot: dict[int, list] = {}
    for r in parts.toLocalIterator():  # one small matrix for each task and fold
        s = tot.setdefault(r.fold, [np.zeros((width + 1, width + 1)), np.zeros(width + 1), 0.0, 0])
        s[0] += np.array(r.gram).reshape(width + 1, width + 1)
        s[1] += np.array(r.zy)
        s[2] += r.yy
        s[3] += r.n
    g, zy, yy, n = (sum(s[i] for s in tot.values()) for i in range(4))
    solve = lambda a, gram, rhs: np.linalg.solve(gram + a * np.eye(width + 1), rhs)
    errors = {a: sum(s[2] - 2 * (v := solve(a, g - s[0], zy - s[1])) @ s[1] + v @ s[0] @ v for s in tot.values()) / max(n, 1) for a in alphas}
    best = min(errors, key=errors.get)
    return {"alpha": best, "weights": solve(best, g, zy), "errors": errors, "n": n}
