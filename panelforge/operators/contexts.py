"""Contexts drawn from rows: by weight, with entities on one side only, boosted round by round; features fitted without the row."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bucket, hash32
from .running import row_ranks
from .scoring import InContextScorer
from .tables import settled
from .targets import clipped_logit, line_search, residual_weights


def weighted_draw(rows: DataFrame, by: list[str], weight: str, key: str, k: int, salt: str = "") -> DataFrame:
    """k rows of each group (all, if it has fewer) without replacement, each draw in proportion to the weights that are left.

    A row waits -ln(u) / weight, u a uniform number from a hash of (key, salt); the first k are the draw. They are found
    as a top k, cut before rows are sent, so k (a parameter) bounds what meets. Rows of weight 0 or null are never drawn.
    Equal waits are in the order of key, which tells rows apart.
    """
    u = (hash32(key, F.lit(salt)) + 0.5) / 4294967296.0
    waits = rows.where(F.col(weight) > 0).withColumn("__wait", -F.log(u) / F.col(weight))
    if not by:
        return waits.orderBy("__wait", key).limit(k).drop("__wait")
    place = F.row_number().over(W.partitionBy(*by).orderBy("__wait", key))
    return waits.withColumn("__place", place).where(F.col("__place") <= k).drop("__wait", "__place")


def both_classes(drawn: DataFrame, rows: DataFrame, weight: str, key: str, y: str) -> DataFrame:
    """The drawn rows; where they lack a class (y is 0 or 1) that rows have, its heaviest row takes the place of the lightest."""
    for c in (0, 1):
        if drawn.where(F.col(y) == c).isEmpty():
            heaviest = rows.where(F.col(y) == c).orderBy(F.desc(weight), key).limit(1)
            if not heaviest.isEmpty():
                lightest = drawn.orderBy(weight, key).limit(1).select(key)
                drawn = drawn.join(F.broadcast(lightest), key, "left_anti").select(*rows.columns).unionByName(heaviest)  # one row
    return drawn


@dataclass
class BoostedContexts:
    """Rounds of scorers, each fitted on a small context drawn by residuals, added up as log-odds.

    Round by round: every row's residual under the scores so far becomes its weight; a context of `size` rows is drawn
    and has both classes; a scorer is fitted on it; its log-odds beyond the context's own rate are the evidence, of which
    the step with the least log-loss on the rows outside the context (0, if none helps) is added, times the rate.
    Rows are written once a round. features, the label (0 or 1) and key are all that is kept of them.
    """

    make: Callable[[], InContextScorer]
    features: list[str]
    y: str
    key: str
    rounds: int = 4
    size: int = 256
    rate: float = 0.5
    weighting: str = "abs"
    most: float = 4.0
    salt: str = "context"
    learners: list[tuple[InContextScorer, float, float]] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def fit(self, rows: DataFrame) -> BoostedContexts:
        if self.rounds < 1 or self.size < 2 or self.rate <= 0:
            raise ValueError("rounds must be 1, size 2 and rate above 0 at least")
        kept = rows.where(F.col(self.y).isNotNull()).select(self.key, *self.features, F.col(self.y).cast("double").alias(self.y))
        share = kept.agg(F.avg(self.y).alias("m")).first().m
        if share is None or share in (0.0, 1.0):
            raise ValueError("the rows hold one class")
        self.base = math.log(share / (1 - share))
        pool = settled(kept.withColumn("__f", F.lit(self.base)), "pool")
        for m in range(self.rounds):
            residual = pool.withColumn("__r", F.col(self.y) - 1 / (1 + F.exp(-F.col("__f"))))
            weighted = residual_weights(residual, [], "__r", self.weighting)
            drawn = weighted_draw(weighted, [], "weight", self.key, self.size, f"{self.salt}{m}")
            context = settled(both_classes(settled(drawn, "drawn"), weighted, "weight", self.key, self.y), "context")
            got = context.agg(F.avg(self.y).alias("rate"), F.count("*").alias("n")).first()
            own = math.log(got.rate / (1 - got.rate))
            learner = self.make().fit(context.select(self.key, *self.features, self.y))
            scored = settled(learner.score(pool).withColumn("__h", clipped_logit(F.col("p")) - own).select(*pool.columns, "__h"), "evidence")
            outside = scored.join(F.broadcast(context.select(self.key)), self.key, "left_anti")  # `size` rows
            best = line_search(outside, [], "__f", "__h", self.y, self.most).first()
            step = best.gamma if best and best.gamma is not None else 0.0
            self.learners.append((learner, own, step))
            pool = settled(scored.withColumn("__f", F.col("__f") + self.rate * step * F.col("__h")).select(*pool.columns), "pool")
            z = F.col("__f")
            loss = pool.agg(F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col(self.y) * z).alias("l")).first().l
            self.history.append({"round": m, "rows": got.n, "positives": round(got.rate * got.n), "step": step, "loss": loss})
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds p; rows are scored by all learners in turn, in one plan."""
        out = rows.withColumn("__f", F.lit(self.base))
        for learner, own, step in self.learners:
            if step:
                out = learner.score(out).withColumn("__f", F.col("__f") + self.rate * step * (clipped_logit(F.col("p")) - own)).drop("p")
        return out.withColumn("p", 1 / (1 + F.exp(-F.col("__f")))).select(*rows.columns, "p")


def disjoint_draw(rows: DataFrame, entity: str, key: str, y: str, query_entities: int, context_rows: int, query_rows: int, positive_share: float | None = None, salt: str = "") -> DataFrame:
    """The drawn rows with side ('context' or 'query'), copy and weight; no entity is on both sides.

    The first query_entities in a hash order supply the queries, the others the context. Each side has exactly the rows
    asked for: the first in a hash order, and if a side has fewer, the same again and again (copy counts from 1). With
    positive_share that share of the queries (one at least of either class) is of y = 1, and weight is the true rate of
    the class over its drawn rate; it is null for the context, for plain draws, and where a class has no queries (then
    the draw is plain). Rows without entity or y take no part. Orders are ranks from sums over ranges, so entities and
    rows may be many.
    """
    rows = rows.where(F.col(entity).isNotNull() & F.col(y).isNotNull())
    entities = row_ranks(rows.select(F.col(entity).alias("__e")).distinct().withColumn("__h", hash32("__e", F.lit(salt + "entity"))), [], "__h", ["__e"], "__rank")
    held = entities.where(F.col("__rank") <= query_entities).select("__e", F.lit("query").alias("__q"))
    sided = rows.join(held, F.col(entity) == F.col("__e"), "left").withColumn("side", F.coalesce("__q", F.lit("context"))).select(*rows.columns, "side")
    yes = F.col(y).cast("int") == 1
    counts = sided.where("side = 'query'").agg(F.count_if(yes).alias("__pos"), F.count("*").alias("__all"))  # one row
    pos_rows = min(max(1, round(query_rows * positive_share)), query_rows - 1) if positive_share is not None else 0
    classed = (F.col("__pos") > 0) & (F.col("__pos") < F.col("__all")) & F.lit(positive_share is not None)
    known = sided.crossJoin(F.broadcast(counts)).withColumn("__part", F.when((F.col("side") == "query") & classed, yes.cast("int")).otherwise(-1)).withColumn("__h", hash32(key, F.lit(salt + "row")))
    known = settled(known, "sides")
    ranked = row_ranks(known, ["side", "__part"], "__h", [key], "__rank")
    sizes = known.groupBy(F.col("side").alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))  # four rows at most
    wanted = F.when(F.col("side") == "context", context_rows).when(F.col("__part") == 1, pos_rows).when(F.col("__part") == 0, query_rows - pos_rows).otherwise(query_rows)
    joined = ranked.join(F.broadcast(sizes), (F.col("side") == F.col("__s")) & (F.col("__part") == F.col("__p"))).where(F.col("__rank") <= wanted)
    true, drawn = F.col("__pos") / F.col("__all"), pos_rows / query_rows
    weight = F.when(F.col("__part") == 1, true / F.lit(drawn or 1.0)).when(F.col("__part") == 0, (1 - true) / F.lit(1 - drawn))
    return joined.select(*rows.columns, "side", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("1L") + F.floor((wanted - F.col("__rank")) / F.col("__n")))).alias("copy"), weight.alias("weight"))


def crossfit_representation(rows: DataFrame, unit: str, y: str, features: list[str], folds: int = 5, salt: str = "") -> DataFrame:
    """Adds fold and, for each feature, <feature>_llr: how much likelier its value is among the positives than among the
    negatives of the other folds, as the log ratio of two normal densities. Units (entities) are whole in a fold.

    Folds' sums are taken off the sums of all, so rows are read once for the fit and once to be represented, and no row
    sees itself or its unit. A missing value, or a class without two different values outside the fold, gives null.
    Rows without y are represented, and fitted on by none; rows without a unit are one unit.
    """
    placed = rows.withColumn("fold", bucket(folds, F.coalesce(F.col(unit).cast("string"), F.lit("")), F.lit(salt + "fold")))
    x = lambda c: F.col(c).cast("double")
    sums = [f(c).alias(f"__{n}{i}") for i, c in enumerate(features) for n, f in (("n", lambda c: F.count(x(c)).cast("double")), ("s", lambda c: F.sum(x(c))), ("q", lambda c: F.sum(x(c) * x(c))))]
    own = settled(placed.where(F.col(y).isNotNull()).groupBy("fold", F.col(y).cast("int").alias("__y")).agg(*sums), "fold-sums")  # a row for each fold and class
    names = [f"__{n}{i}" for i in range(len(features)) for n in "nsq"]
    grid = own.sparkSession.range(folds).select(F.col("id").alias("__fold"))
    other = grid.join(F.broadcast(own), F.col("fold") != F.col("__fold")).groupBy("__fold").pivot("__y", [0, 1]).agg(*[F.sum(n).alias(n) for n in names])

    def density(v: Column, c: int, i: int) -> Column:
        n, s, q = (F.col(f"{c}___{k}{i}") for k in "nsq")
        var = q / n - (s / n) * (s / n)
        return F.when((n > 1) & (var > 1e-12 * (q / n)), -0.5 * (F.log(var) + (v - s / n) * (v - s / n) / var))

    joined = placed.join(F.broadcast(other), F.col("fold") == F.col("__fold"), "left")  # a row for each fold
    return joined.select(*rows.columns, "fold", *[(density(x(c), 1, i) - density(x(c), 0, i)).alias(f"{c}_llr") for i, c in enumerate(features)])
