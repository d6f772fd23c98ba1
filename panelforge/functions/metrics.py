"""Grouped scores of predictions: each function takes rows and gives one row for each group in `by`.

y is 0 or 1, p a score; rows with a null in either are left out. A metric that isn't defined (one class only) is null.
Rank metrics first add up the rows of equal scores, then take running sums over the distinct scores, so ties have
mid-ranks (AUC) or count as one threshold (average precision) and no task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.quantiles import matches
from ..operators.running import mid_ranks_of, row_ranks, running_sum
from ..operators.tables import settled


def by_score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """(by, p, n, pos, cum_n, cum_pos): distinct scores, from the highest, with running counts; total, positives."""
    tied = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    return settled(running_sum(settled(tied, "tied"), by, "p", {"cum_n": "n", "cum_pos": "pos"}, descending=True), "by-score")


def rank_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(by, n, positives, auc, ap, best_f1, best_threshold)."""
    return ranks_of(by_score(df, by, y, p), by)


def ranks_of(s: DataFrame, by: list[str]) -> DataFrame:
    """rank_metrics of a table that by_score made."""
    above_neg = (F.col("cum_n") - F.col("n")) - (F.col("cum_pos") - F.col("pos"))
    neg = F.col("n") - F.col("pos")
    # pairs lost: a positive below a negative; half for ties
    parts = s.withColumns({"lost": F.col("pos") * (above_neg + neg / 2.0), "gain": F.col("pos") * F.col("cum_pos") / F.col("cum_n"), "neg": neg})
    total = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum("lost").alias("lost"), F.sum("gain").alias("gain"), F.sum("neg").alias("negatives"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    scores = total.select(*by, "n", "positives", F.when(both, 1 - F.col("lost") / (F.col("positives") * F.col("negatives")).cast("double")).alias("auc"), F.when(F.col("positives") > 0, F.col("gain") / F.col("positives")).alias("ap"))
    named = total.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("positives").alias("__positives"))
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    f1 = parts.join(named, cond).select(*by, "p", F.try_divide(2.0 * F.col("cum_pos"), F.col("cum_n") + F.col("__positives")).alias("f1"))
    # of equal F1 the highest threshold
    best = f1.groupBy(*by).agg(F.max(F.struct("f1", "p")).alias("best")).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("best.f1").alias("best_f1"), F.col("best.p").alias("best_threshold"))
    return scores.join(best, cond).select(*scores.columns, "best_f1", "best_threshold")


def calibration_table(df: DataFrame, by: list[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_p, rate) over equal-width bins; a score on an edge (k * 0.1 as a double) goes up, 1.0 to the last."""
    edge = " + ".join(f"IF({p} >= {k}*{1 / bins:e}, 1, 0)" for k in range(1, bins))
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.expr(edge).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, by: list[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    table = calibration_table(df, by, y, p, bins)
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def calibration_of(s: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """calibration_error of a table that by_score made."""
    edge = " + ".join(f"IF(p >= {k}*{1 / bins:e}, 1, 0)" for k in range(1, bins))
    table = s.groupBy(*by, F.expr(edge).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("sp"), F.sum("pos").alias("pos"))
    return table.groupBy(*by).agg((F.sum(F.abs(F.col("sp") - F.col("pos"))) / F.sum("n")).alias("ece"))


def moments_of(s: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, mean_p, brier, brier_skill, log_loss, rmse, sd, p50, p99, ratio, near_constant) of a table that by_score
    made: every figure is a sum over distinct scores, and quantiles are where the running counts pass their ranks."""
    totals = s.groupBy(*[F.col(c).alias(f"__t_{c}") for c in by]).agg(F.sum("n").alias("__all"))
    both = s.join(totals, matches(by, "__t_")) if by else s.crossJoin(F.broadcast(totals))  # one row
    neg, below = F.col("n") - F.col("pos"), F.col("__all") - F.col("cum_n") + F.col("n")
    safe = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    mean = lambda x: F.sum(x) / F.sum("n")
    at = lambda rank: F.min(F.when(below > rank, F.col("p")))
    ends = {name: F.lit(q) * (F.col("__all") - 1) for name, q in (("p50", 0.5), ("p99", 0.99))}
    out = both.groupBy(*by).agg(
        mean(F.col("pos").cast("double")).alias("rate"), mean(F.col("n") * F.col("p")).alias("mean_p"), mean(F.col("pos") * (F.col("p") - 1) * (F.col("p") - 1) + neg * F.col("p") * F.col("p")).alias("brier"),
        mean(-(F.col("pos") * F.log(safe) + neg * F.log(1 - safe))).alias("log_loss"), mean(F.col("n") * F.col("p") * F.col("p")).alias("__square"), (F.min("p") == F.max("p")).alias("__one"),
        *[at(f(r)).alias(f"{name}_{k}") for name, r in ends.items() for k, f in (("l", F.floor), ("h", F.ceil))], *[F.max(r - F.floor(r)).alias(f"{name}_s") for name, r in ends.items()],
    )
    out = out.withColumns({name: F.col(f"{name}_l") + (F.col(f"{name}_h") - F.col(f"{name}_l")) * F.col(f"{name}_s") for name in ends})
    out = out.withColumn("sd", F.when(F.col("__one"), 0.0).otherwise(F.sqrt(F.greatest(F.col("__square") - F.col("mean_p") * F.col("mean_p"), F.lit(0.0)))))
    out = out.withColumns({"brier_skill": 1 - F.try_divide(F.col("brier"), F.col("rate") * (1 - F.col("rate"))), "rmse": F.sqrt("brier"), "ratio": F.when(F.col("p50") > 0, F.col("p99") / F.col("p50"))})
    out = out.withColumn("near_constant", (F.col("sd") == 0) | F.coalesce(F.col("ratio") < 1.5, F.lit(False)))
    return out.select(*by, "rate", "mean_p", "brier", "brier_skill", "log_loss", "rmse", "sd", "p50", "p99", "ratio", "near_constant")


def moments(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(by, n, rate, mean_p, brier, brier_skill, log_loss, rmse, sd, p50, p99, ratio, near_constant)."""
    s = by_score(df, by, y, p)
    n = s.groupBy(*[F.col(c).alias(f"__n_{c}") for c in by]).agg(F.sum("n").alias("n"))
    got = moments_of(s, by)
    return (got.join(n, matches(by, "__n_")) if by else got.crossJoin(F.broadcast(n))).select(*by, "n", *got.columns[len(by) :])  # one row where by is empty


def scorecard(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Rank metrics, calibration and spread in one row a group; degenerate: an AUC of at most 0.55. Rows are read once, to
    be counted by score."""
    s = by_score(df, by, y, p)
    ranks, error, mean = ranks_of(s, by), calibration_of(s, by), moments_of(s, by)
    out = ranks.join(error, by).join(mean, by) if by else ranks.crossJoin(error).crossJoin(mean)  # one row each
    return out.withColumn("degenerate", F.col("auc") <= 0.55)


def recall_at(df: DataFrame, by: list[str], k: Column, y: str = "y", p: str = "p", row: str = "_row_id") -> DataFrame:
    """Positives among the k highest scores (equal ones by row id), and their share of all."""
    ranked = row_ranks(df.where(F.col(p).isNotNull()), by, p, [row], "__r", descending=True)
    hit = F.sum(F.when(F.col("__r") <= k, F.col(y)).otherwise(0))
    return ranked.groupBy(*by).agg(hit.cast("bigint").alias("hits"), F.try_divide(hit.cast("double"), F.sum(y)).alias("recall"))


def ap_top_decile(df: DataFrame, by: list[str], y: str = "y", p: str = "p", row: str = "_row_id") -> DataFrame:
    """Precision summed over the hits among the top ceil(n / 10) rows, over min(that many, positives)."""
    ranked = row_ranks(df.where(F.col(p).isNotNull()), by, p, [row], "__place", descending=True)
    sizes = df.where(F.col(p).isNotNull()).groupBy(*by).agg(F.ceil(F.count("*") / 10.0).alias("__k"), F.sum(y).alias("__pos")).withColumnsRenamed({c: f"__s_{c}" for c in by})
    joined = ranked.join(sizes, matches(by, "__s_")) if by else ranked.crossJoin(F.broadcast(sizes))  # one row
    top = running_sum(joined.where("__place <= __k").select(*by, "__place", "__k", "__pos", F.col(y).alias("__y")), by, "__place", {"__hits": "__y"})
    return top.groupBy(*by).agg((F.sum(F.col("__hits") / F.col("__place") * F.col("__y")) / F.max(F.least(F.col("__k"), F.col("__pos")))).alias("ap_top_decile"))


def mid_ranks(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Adds rank_<c>: average ranks within the group."""
    out = df
    for c in columns:
        out = mid_ranks_of(out, by, c, f"rank_{c}")
    return out


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks; null if either side is constant."""
    ranked = mid_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, [a, b])
    return ranked.groupBy(*by).agg(F.when((F.stddev_pop(f"rank_{a}") > 0) & (F.stddev_pop(f"rank_{b}") > 0), F.corr(f"rank_{a}", f"rank_{b}")).alias("rho"))


def holm(df: DataFrame, family: list[str], p: str, row: str, alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and reject: the step-down adjustment within a family. Null p-values count in the family's size and stay null."""
    order = W.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), row)
    n = F.count("*").over(W.partitionBy(*family))
    stepped = df.withColumn("__adj", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(order) + 1))))
    top = F.max("__adj").over(order.rowsBetween(W.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), top)).withColumn("reject", F.coalesce(F.col("p_holm") <= alpha, F.lit(False))).drop("__adj")


def hanley_mcneil(auc: Column, positives: Column, negatives: Column) -> Column:
    """The variance of an AUC in closed form."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return (auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)) / (positives * negatives)


def sign_test_p(wins: Column, losses: Column) -> Column:
    """The exact two-sided binomial p-value of wins against losses, ties left out: twice the smaller tail, at most 1.

    Each tail term is the one before it times (n - i + 1) / i.
    """
    n, k = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.pow(F.lit(0.5), n.cast("double")).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.filter(F.sequence(F.lit(0), k), lambda i: i > 0)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda s: s["sum"])))
