"""Uncertainty of comparisons: group bootstraps of rank metrics, families, permutation tests, power."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import hanley_mcneil, holm
from .bootstrap import drawn_levels, poisson_weight
from .quantiles import matches
from .running import running_sum
from .tables import settled

#: The normal quantiles of a two-sided test at 5 %, and of a power of 80 %.
Z_TEST, Z_POWER = 1.959963984540054, 0.8416212335729143


def interval(each: DataFrame, by: list[str], least: int = 100) -> DataFrame:
    """From (by, draw, diff), draw 0 being the sample itself: diff, drawn, low, high, p.

    p is twice the smaller share of resamples on either side of 0, between 1 / (drawn + 1) and 1. A resample on which
    the metric isn't defined has a null diff and doesn't count; with fewer than `least` others the interval and p are null.
    """
    real = F.col("draw") > 0
    drawn = F.when(real, F.col("diff"))
    got = each.groupBy(*by).agg(
        F.max(F.when(~real, F.col("diff"))).alias("diff"), F.count(drawn).alias("drawn"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"),
        F.count_if(real & (F.col("diff") <= 0)).alias("below"), F.count_if(real & (F.col("diff") >= 0)).alias("above"),
    )
    p = F.least(F.lit(1.0), F.greatest(2.0 * F.least("below", "above") / F.col("drawn"), 1.0 / (F.col("drawn") + 1)))
    enough = F.col("drawn") >= least
    return got.select(*by, "diff", "drawn", *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high")], F.when(enough, p).alias("p"))


def rank_difference(scores: DataFrame, by: list[str], group: str, y: str, a: str, b: str, metric: str = "auc", draws: int = 200, least: int = 100) -> DataFrame:
    """(by, diff, drawn, low, high, p): AUC ("auc") or average precision ("ap") of score a less that of score b on the same
    rows, with a bootstrap over whole groups.

    A draw weights each group by a Poisson(1) number from a hash of (draw, group), on both scores alike. Rows are added up
    by score for all draws at once; running sums over the scores of a draw are cut into ranges.
    """
    rows = scores.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(group).alias("__g"), F.col(y).alias("__y"), F.col(a).alias("a"), F.col(b).alias("b"))
    keys = [*by, "draw", "which"]
    levels = settled(drawn_levels(rows, by, "__g", "__y", ["a", "b"], draws), "levels")
    run = running_sum(levels, keys, "p", {"cum_n": "n", "cum_pos": "pos"}, descending=True, ranges=8)
    neg, above = F.col("n") - F.col("pos"), (F.col("cum_n") - F.col("n")) - (F.col("cum_pos") - F.col("pos"))
    total = run.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum(neg).alias("N"), F.sum(F.col("pos") * (above + neg / 2.0)).alias("lost"), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("gain"))
    value = 1 - F.col("lost") / (F.col("P") * F.col("N")).cast("double") if metric == "auc" else F.col("gain") / F.col("P")
    scored = total.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), value).alias("v"))
    each = scored.groupBy(*by, "draw").agg((F.max(F.when(F.col("which") == "a", F.col("v"))) - F.max(F.when(F.col("which") == "b", F.col("v")))).alias("diff"))
    return interval(each, by, least)


def family(compared: DataFrame, units: list[str], row: str, alpha: float = 0.05) -> DataFrame:
    """Comparisons with their step-down adjusted p-values over each family (units)."""
    return holm(compared, units, "p", row, alpha)


def smallest_adjusted(draws: int, size: Column | int) -> Column:
    """The least adjusted p-value that `draws` resamples can show in a family of some size."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.least(F.lit(1.0), size / F.lit(draws + 1.0))


def refuse_coarse(draws: int, size: int, alpha: float = 0.05, allow: bool = False) -> None:
    """Refuse a bootstrap whose least adjusted p-value isn't below alpha."""
    if not allow and size / (draws + 1) >= alpha:
        raise ValueError(f"{draws} draws can't reject at {alpha} in a family of {size}")


def ordered_pairs(methods: DataFrame, name: str, rank: str, against: list[str] | None = None) -> DataFrame:
    """(a, b) of a small table of methods: b before a in rank; where baselines are named, each other method against each of
    them, and baselines among themselves in rank order."""
    a, b = methods.select(F.col(name).alias("a"), F.col(rank).alias("ra")), methods.select(F.col(name).alias("b"), F.col(rank).alias("rb"))
    if not against:
        return a.join(F.broadcast(b), F.col("rb") < F.col("ra")).select("a", "b")
    base = lambda c: F.col(c).isin(against)
    return a.join(F.broadcast(b.where(base("b"))), (F.col("a") != F.col("b")) & (~base("a") | (F.col("rb") < F.col("ra")))).select("a", "b")


def difference_variance(auc1: Column, auc2: Column, positives: Column, negatives: Column, r: float) -> Column:
    """The variance of the difference of two AUCs whose estimates have correlation r."""
    v1, v2 = hanley_mcneil(auc1, positives, negatives), hanley_mcneil(auc2, positives, negatives)
    return v1 + v2 - 2 * r * F.sqrt(v1 * v2)


def half_width(auc: Column, positives: Column, negatives: Column) -> Column:
    return Z_TEST * F.sqrt(hanley_mcneil(auc, positives, negatives))


def detectable_gain(auc: Column, positives: Column, negatives: Column, r: float, steps: int = 40) -> Column:
    """The AUC gain that is found with a power of 80 % at 5 %: the fixed point of gain = z * sd(gain), from 0.01 on; null if
    it doesn't fit below an AUC of 0.9999."""
    z = Z_TEST + Z_POWER
    step = lambda g, _: F.when(auc + g < 0.9999, z * F.sqrt(difference_variance(auc, auc + g, positives, negatives, r)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.01), step)


def rho_permutation(df: DataFrame, by: list[str], a: str, b: str, most_exact: int = 7, draws: int = 2000) -> DataFrame:
    """(by, rho, p_two, p_one, exact): Spearman's rho of the few rows of each group and its permutation p-values. All orders
    of up to most_exact rows are tried, `draws` random ones of more. A constant side has nulls."""
    import itertools

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[c].rank().to_numpy(float) for c in (a, b))
        x, y = x - x.mean(), y - y.mean()
        size, n = float(np.sqrt((x * x).sum() * (y * y).sum())), len(pdf)
        if n < 2 or size == 0:
            return pd.DataFrame([(*key, None, None, None, n <= most_exact)], columns=[*by, "rho", "p_two", "p_one", "exact"])
        orders = np.array(list(itertools.permutations(range(n)))) if n <= most_exact else np.argsort(np.random.default_rng(0).random((draws, n)), axis=1)
        got, seen = y[orders] @ x / size, float(x @ y / size)
        return pd.DataFrame([(*key, seen, (np.abs(got) >= abs(seen) - 1e-12).mean(), (got >= seen - 1e-12).mean(), n <= most_exact)], columns=[*by, "rho", "p_two", "p_one", "exact"])

    kinds = dict(df.dtypes)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).applyInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "rho double, p_two double, p_one double, exact boolean"]))


def rho_interval(df: DataFrame, by: list[str], unit: str, a: str, b: str, draws: int = 200) -> DataFrame:
    """(by, low, high): percentile interval of Spearman's rho over Poisson-weighted draws of units. Ranks are those of the
    weighted sample: weights below a value plus half of its own."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(unit).alias("__u"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", poisson_weight("draw", "__u")).where("w > 0")
    for c in ("__a", "__b"):
        over, own = W.partitionBy(*by, "draw").orderBy(c), W.partitionBy(*by, "draw", c)
        drawn = drawn.withColumn(f"r{c}", F.sum("w").over(over) - F.sum("w").over(own) / 2.0)
    x, y, w = F.col("r__a"), F.col("r__b"), F.col("w")
    s = drawn.groupBy(*by, "draw").agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    vx, vy = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    rho = F.when((vx > 1e-9) & (vy > 1e-9), (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy))
    return s.select(*by, rho.alias("rho")).groupBy(*by).agg(F.percentile("rho", F.lit(0.025)).alias("low"), F.percentile("rho", F.lit(0.975)).alias("high"))


def shift_to_mean(df: DataFrame, by: list[str], p: str, target: float, passes: int = 8, width: int = 64) -> DataFrame:
    """Adds `shifted`: p with a constant added to its logit in each group, so that the group's mean is `target`; the order
    of rows stays. Each pass tries `width` shifts in one aggregate and narrows to the step that holds the target."""
    z = F.log(F.col(p) / (1 - F.col(p)))
    bounds = df.select(*by).distinct().withColumns({"__lo": F.lit(-30.0), "__hi": F.lit(30.0)})
    for _ in range(passes):
        bounds = settled(bounds, "bounds")
        named = bounds.withColumnsRenamed({c: f"__k_{c}" for c in by})
        on = reduce(lambda s, c: s & F.col(c).eqNullSafe(F.col(f"__k_{c}")), by, F.lit(True))
        rows = df.withColumn("__z", z).join(F.broadcast(named), on)  # a row for each group
        at = lambda i: F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (i / width)
        means = rows.groupBy(*by, "__lo", "__hi").agg(*[F.avg(1 / (1 + F.exp(-(F.col("__z") + at(i))))).alias(f"__m{i}") for i in range(1, width)])
        below = sum((F.when(F.col(f"__m{i}") < target, 1).otherwise(0) for i in range(1, width)), F.lit(0))
        step = (F.col("__hi") - F.col("__lo")) / width
        bounds = means.select(*by, (F.col("__lo") + below * step).alias("__lo"), (F.col("__lo") + (below + 1) * step).alias("__hi"))
    named = settled(bounds, "bounds").withColumnsRenamed({c: f"__k_{c}" for c in by})
    on = reduce(lambda s, c: s & F.col(c).eqNullSafe(F.col(f"__k_{c}")), by, F.lit(True))
    out = df.join(F.broadcast(named), on)  # a row for each group
    return out.select(*df.columns, (1 / (1 + F.exp(-(z + (F.col("__lo") + F.col("__hi")) / 2)))).alias("shifted"))


def regret(scores: DataFrame, by: list[str], y: str, best: str, model: str) -> DataFrame:
    """(by, auc_best, auc_model, regret, regret_norm): the AUC of the true probabilities less the model's, and that over the
    lift above 0.5 (null where there is none). A group of one class has nulls."""
    from ..functions.metrics import rank_metrics

    a = rank_metrics(scores, by, y, best).select(*by, F.col("auc").alias("auc_best"))
    b = rank_metrics(scores, by, y, model).select(*by, F.col("auc").alias("auc_model"))
    both = a.join(b, by).withColumn("regret", F.col("auc_best") - F.col("auc_model"))
    return both.withColumn("regret_norm", F.when(F.col("auc_best") - 0.5 > 1e-9, F.col("regret") / (F.col("auc_best") - 0.5)))


def recovered(importance: DataFrame, by: list[str], column: str, drop: str, true: list[str]) -> DataFrame:
    """(by, top_col, top_hit, exact, true_share) of one importance a column: the largest (of equal ones the first by name),
    whether it is a true column, whether the largest len(true) are the true ones, and their share of the positive importance."""
    order = W.partitionBy(*by).orderBy(F.col(drop).desc(), column)
    ranked = importance.withColumn("__r", F.row_number().over(order))  # a row for each column of a task
    yes, gain = F.col(column).isin(true), F.greatest(F.col(drop), F.lit(0.0))
    got = ranked.groupBy(*by).agg(F.max(F.when(F.col("__r") == 1, F.col(column))).alias("top_col"), F.sum(F.when((F.col("__r") <= len(true)) & yes, 1).otherwise(0)).alias("__hit"), F.sum(F.when(yes, gain).otherwise(0.0)).alias("__yes"), F.sum(gain).alias("__all"))
    return got.select(*by, "top_col", F.col("top_col").isin(true).alias("top_hit"), (F.col("__hit") == len(true)).alias("exact"), F.try_divide("__yes", "__all").alias("true_share"))


def many_differences(scores: DataFrame, by: list[str], group: str, y: str, names: list[str], pairs: list[tuple[str, str]], metric: str = "auc", draws: int = 200, least: int = 100, least_rows: int = 1) -> DataFrame:
    """(by, a, b, diff, drawn, low, high, p, p_holm): AUC ("auc") or average precision ("ap") of score a less that of b for
    all pairs of score columns, with one bootstrap over whole groups, and p-values adjusted as one family.

    A group's weight in a draw is a Poisson(1) number made once for each (draw, group) and shared by all units (by),
    scores and pairs. Rows are added up by (unit, score) for all draws at once. A unit (by) with fewer than least_rows
    rows, or one class only, is left out and doesn't count in the family; rows without y or any of the scores take no part.
    """
    rows = scores.where(F.col(y).isNotNull())
    for c in names:
        rows = rows.where(F.col(c).isNotNull())
    keys = [*by, "draw", "which"]
    every = settled(drawn_levels(rows, by, group, y, names, draws), "levels")
    whole = every.where((F.col("draw") == 0) & (F.col("which") == names[0])).groupBy(*by).agg(F.sum("n").alias("__n"), F.sum("pos").alias("__pos"))
    usable = whole.where((F.col("__n") >= least_rows) & (F.col("__pos") > 0) & (F.col("__pos") < F.col("__n"))).select(*[F.col(c).alias(f"__u_{c}") for c in by])
    kept = every.join(usable, matches(by, "__u_")) if by else every.crossJoin(F.broadcast(usable))  # one row or none
    levels = kept.select(*keys, "p", "n", "pos")
    run = running_sum(levels, keys, "p", {"cum_n": "n", "cum_pos": "pos"}, descending=True, ranges=8)
    neg, above = F.col("n") - F.col("pos"), (F.col("cum_n") - F.col("n")) - (F.col("cum_pos") - F.col("pos"))
    total = run.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum(neg).alias("N"), F.sum(F.col("pos") * (above + neg / 2.0)).alias("lost"), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("gain"))
    value = 1 - F.col("lost") / (F.col("P") * F.col("N")).cast("double") if metric == "auc" else F.col("gain") / F.col("P")
    scored = total.where((F.col("P") > 0) & (F.col("N") > 0)).withColumn("v", value).groupBy(*by, "draw").agg(*[F.max(F.when(F.col("which") == c, F.col("v"))).alias(f"__v_{c}") for c in names])
    diffs = scored.select(*by, "draw", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"__v_{a}") - F.col(f"__v_{b}")).alias("diff")) for a, b in pairs])).alias("x")).select(*by, "draw", "x.*")
    compared = interval(diffs, [*by, "a", "b"], least)
    # the family has a row for each unit and pair; its order is that of p, then of the names
    named = compared.withColumn("__family", F.lit(1)).withColumn("__row", F.concat_ws("|", *by, "a", "b"))
    return family(named, ["__family"], "__row").drop("__family", "__row")
