"""Histogram trees, grown level by level for many trees at once; partitioned quantile heads; boosting with halving.

Rows carry a `tree` column; each level is one aggregate by (tree, node, feature, bin), so what is shuffled and what
reaches the driver has a row for each cell of the histograms, whatever the rows are. A tree itself is a few splits, and
routing is an expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from .quantiles import quantiles
from .running import row_ranks
from .tables import settled


def feature_cuts(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Of each feature the distinct values at its inner quantiles that some row lies above; bins - 1 of them at most."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in features])).alias("x")
    found = {r.c: r.q for r in quantiles(rows.select(cells).select("x.*"), ["c"], "v", [k / bins for k in range(1, bins + 1)]).collect()}
    return {c: sorted({v for v in found.get(c, []) if v < found[c][-1]}) for c in features}


def bin_of(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below x; 0 for a null."""
    below = F.filter(F.array(*[F.lit(v) for v in cuts]).cast("array<double>"), lambda v: v < x)
    return F.when(x.isNotNull(), F.size(below)).otherwise(F.lit(0))


@dataclass
class Trees:
    """For each tree its splits, {node: (feature, cut)}: node n has the children 2n (value <= cut, or null) and 2n + 1."""

    depth: int
    splits: dict[int, dict[int, tuple[str, float]]] = field(default_factory=dict)

    def leaf(self, tree: Column) -> Column:
        """The node that a row ends in, 1 being the root."""
        node = F.lit(1)
        for level in range(self.depth):
            here = [(t, n, *split) for t, nodes in self.splits.items() for n, split in nodes.items() if n.bit_length() == level + 1]
            if not here:
                break
            # the node so far is bound to a name, so that each level is worked out once
            node = F.transform(F.array(node), one_down(here, tree))[0]
        return node


def one_down(splits: list[tuple[int, int, str, float]], tree: Column):
    def step(node: Column) -> Column:
        out = None
        for t, n, feature, cut in splits:
            met, to = (tree == t) & (node == n), F.when(F.col(feature).cast("double") > cut, 2 * n + 1).otherwise(2 * n)
            out = F.when(met, to) if out is None else out.when(met, to)
        return out.otherwise(node)

    return step


def grow(rows: DataFrame, cuts: dict[str, list[float]], gradient: str, hessian: str, depth: Column | int, least: Column | float, penalty: float = 0.0, most: int | None = None) -> Trees:
    """Trees on the rows' (tree, gradient, hessian): each node is split where G^2 / (H + penalty) of its two sides gains most
    over the whole (with hessian 1 and penalty 0, where the variance falls most).

    least: the fewest rows of a side, and depth: the deepest level, both may be columns that depend on tree. A gain must
    be above 1e-9 of the largest sum's; ties go to the first feature, then the lowest cut. Nulls go to the lower side.
    """
    most = most if most is not None else depth
    names, found = list(cuts), Trees(most)
    limit = depth if isinstance(depth, Column) else F.lit(depth)
    floor = least if isinstance(least, Column) else F.lit(float(least))
    cell = [F.struct(F.lit(i).alias("f"), bin_of(F.col(c).cast("double"), cuts[c]).alias("bin")) for i, c in enumerate(names)]
    placed = rows.select("tree", *names, gradient, hessian, floor.alias("__least"), limit.alias("__depth"), F.array(*cell).alias("__cells"))
    for level in range(most):
        here = placed.withColumn("__node", found.leaf(F.col("tree"))).where((F.col("__node") >= 1 << level) & (F.col("__depth") > level))
        cells = here.select("tree", "__node", "__least", gradient, hessian, F.explode("__cells").alias("c"))
        sums = cells.groupBy("tree", "__node", "c.f", "c.bin").agg(F.count("*").alias("n"), F.sum(gradient).alias("g"), F.sum(hessian).alias("h"), F.max("__least").alias("least")).collect()
        grouped: dict = {}
        for r in sums:
            grouped.setdefault((r.tree, r["__node"]), {}).setdefault(r.f, {})[r.bin] = (r.n, r.g, r.h, r.least)
        split = False
        for (tree, node), by_feature in sorted(grouped.items()):
            best = None
            for f, c in enumerate(names):
                cells_of = by_feature.get(f, {})
                n, g, h = (sum(v[k] for v in cells_of.values()) for k in range(3))
                floor_n = max((v[3] for v in cells_of.values()), default=0)
                nl = gl = hl = 0.0
                for b, cut in enumerate(cuts[c]):
                    x = cells_of.get(b, (0, 0.0, 0.0))
                    nl, gl, hl = nl + x[0], gl + x[1], hl + x[2]
                    if nl >= max(floor_n, 1) and n - nl >= max(floor_n, 1) and hl + penalty > 0 and h - hl + penalty > 0:
                        whole = g * g / (h + penalty)
                        gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - whole
                        scale = max(abs(whole), gl * gl / (hl + penalty), 1e-300)
                        # sums differ in their last digits from run to run: a gain counts as more only if it is clearly more
                        if gain > 1e-9 * scale and (best is None or gain > best[0] + 1e-9 * scale):
                            best = (gain, c, cut)
            if best:
                found.splits.setdefault(tree, {})[node] = best[1:]
                split = True
        if not split:
            break
    return found


def nth(i: int):
    return lambda q: q[i]


def bags(rows: DataFrame, key: str, count: int, share: float) -> DataFrame:
    """The rows of each of `count` bags, with tree: its number. A bag has round(share n) rows, the first in the order of a
    hash of (key, bag); one bag has all rows. key tells rows apart."""
    if count == 1:
        return rows.withColumn("tree", F.lit(0))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("__h", hash32(key, "tree"))
    size = rows.agg(F.round(F.count("*") * share).alias("__size"))  # one row
    return row_ranks(drawn, ["tree"], "__h", [key], "__rank").crossJoin(F.broadcast(size)).where(F.col("__rank") <= F.col("__size")).select(*rows.columns, "tree")


@dataclass
class PartitionedQuantiles:
    """Quantile heads of a target, one for each leaf of shallow trees; a leaf that is too small takes that of all rows."""

    features: list[str]
    target: str
    key: str
    depth: int = 2
    least_share: float = 0.05
    count: int = 1
    share: float = 0.6
    least_rows: int = 200
    least_values: int = 2
    bins: int = 16
    probs: tuple[float, ...] = (0.1, 0.5, 0.9)

    def fit(self, rows: DataFrame) -> PartitionedQuantiles:
        """Rows with a null target take no part. What reaches the driver are the trees; heads are a table of a row a leaf."""
        rows = settled(rows.where(F.col(self.target).isNotNull()), "partition-rows")
        self.cuts = feature_cuts(rows, self.features, self.bins)
        members = settled(bags(rows, self.key, self.count, self.share), "bags").withColumn("__one", F.lit(1.0)).withColumn("__y", F.col(self.target).cast("double"))
        least = members.groupBy("tree").agg(F.ceil(F.count("*") * self.least_share).cast("double").alias("__floor"))  # a row for each bag
        self.trees = grow(members.join(F.broadcast(least), "tree"), self.cuts, "__y", "__one", self.depth, F.col("__floor"))
        placed = members.withColumn("leaf", self.trees.leaf(F.col("tree")))
        usable = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.min("__y").alias("a"), F.max("__y").alias("z"), F.count_distinct("__y").alias("v")).where((F.col("n") >= self.least_rows) & (F.col("v") >= self.least_values)).select("tree", "leaf", "n")
        heads = quantiles(placed, ["tree", "leaf"], "__y", list(self.probs)).join(usable, ["tree", "leaf"])
        self.whole = settled(quantiles(rows, [], self.target, list(self.probs)).withColumnRenamed("q", "__all"), "head")  # one row
        self.heads = settled(heads.select(F.col("tree").alias("__tree"), F.col("leaf").alias("__leaf"), F.col("q").alias("__q"), "n"), "heads")
        return self

    def predict(self, rows: DataFrame, name: str = "q") -> DataFrame:
        """Adds an array of the quantiles (probs), each the mean over the bags, and how many bags had a leaf of their own."""
        routes = F.array(*[F.struct(F.lit(b).alias("tree"), self.trees.leaf(F.lit(b)).alias("leaf")) for b in range(self.count)])
        # a row for each leaf, of which there are count * 2^depth at most
        table = self.heads.agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("__tree").alias("tree"), F.col("__leaf").alias("leaf")), "__q"))).alias("__heads"))
        joined = rows.crossJoin(F.broadcast(self.whole)).crossJoin(F.broadcast(table)).withColumn("__met", F.transform(routes, lambda r: F.try_element_at("__heads", r)))
        filled = F.transform("__met", lambda q: F.coalesce(q, F.col("__all")))
        mean = F.array(*[F.aggregate(F.transform(filled, nth(i)), F.lit(0.0), lambda s, v: s + v) / self.count for i in range(len(self.probs))])
        return joined.select(*rows.columns, mean.alias(name), F.size(F.filter("__met", lambda q: q.isNotNull())).alias("own"))


@dataclass
class Boosted:
    """Gradient-boosted trees of a binary target: the trees and leaf values of each round of the chosen configuration."""

    base: float
    rate: float
    rounds: list[tuple[Trees, dict[int, float]]]
    config: dict

    def raw(self) -> Column:
        total = F.lit(self.base)
        for trees, values in self.rounds:
            total = total + self.rate * leaf_values(trees, {0: values}, F.lit(0))
        return total


def leaf_values(trees: Trees, values: dict[int, dict[int, float]], tree: Column) -> Column:
    pairs = [(t, n, v) for t, nodes in values.items() for n, v in nodes.items()]
    if not pairs:
        return F.lit(0.0)
    table = F.map_from_arrays(F.array(*[F.lit(t * (1 << 20) + n) for t, n, _ in pairs]), F.array(*[F.lit(float(v)) for *_, v in pairs]))
    return F.coalesce(F.try_element_at(table, (tree * (1 << 20) + trees.leaf(tree)).cast("int")), F.lit(0.0))


def tuned_boosting(fit: DataFrame, hold: DataFrame, features: list[str], label: str, configs: list[dict], rungs: list[int], bins: int = 32, penalty: float = 1.0) -> tuple[Boosted, list[dict]]:
    """Boosting by successive halving: all configurations (depth, rate, least) grow side by side, each level of
    a round in one pass over the rows; after each rung (a number of rounds in all) the better half by log-loss on `hold`
    goes on. Returns the model of the last one, and the losses by rung.

    Rows hold one score for each configuration that is left; they are written once a round, so no plan grows with the
    rounds. Rows without a label take no part.
    """
    rows = fit.where(F.col(label).isNotNull()).select(*features, F.col(label).cast("double").alias("__y"), F.lit(True).alias("__fit"))
    rows = rows.unionByName(hold.where(F.col(label).isNotNull()).select(*features, F.col(label).cast("double").alias("__y"), F.lit(False).alias("__fit")))
    rate = min(max(float(rows.where("__fit").agg(F.avg("__y")).first()[0]), 1e-6), 1 - 1e-6)
    base, cuts = math.log(rate / (1 - rate)), feature_cuts(rows.where("__fit"), features, bins)
    left, models, ladder = list(range(len(configs))), {i: [] for i in range(len(configs))}, []
    rows = settled(rows.withColumn("__f", F.array(*[F.lit(base)] * len(configs))), "boosting")
    done = 0
    for rung in rungs:
        while done < rung:
            of = lambda name: F.element_at(F.array(*[F.lit(float(configs[i][name])) for i in left]), F.col("__k") + 1)
            long = rows.where("__fit").select(*features, "__y", F.posexplode("__f").alias("__k", "__s"))
            p = 1 / (1 + F.exp(-F.col("__s")))
            long = long.select(*features, F.col("__k").alias("tree"), (F.col("__y") - p).alias("__g"), (p * (1 - p)).alias("__h"), of("depth").alias("__d"), of("least").alias("__l"))
            trees = grow(long, cuts, "__g", "__h", F.col("__d"), F.col("__l"), penalty, most=max(int(configs[i]["depth"]) for i in left))
            sums = long.withColumn("__leaf", trees.leaf(F.col("tree"))).groupBy("tree", "__leaf").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h")).collect()  # a row for each leaf
            values: dict[int, dict[int, float]] = {}
            for r in sums:
                values.setdefault(r.tree, {})[r["__leaf"]] = r.g / (r.h + penalty)
            for k, i in enumerate(left):
                models[i].append((Trees(trees.depth, {0: trees.splits.get(k, {})}), values.get(k, {})))
            rows = settled(rows.withColumn("__f", F.array(*[F.col("__f")[k] + float(configs[i]["rate"]) * leaf_values(trees, values, F.lit(k)) for k, i in enumerate(left)])), "boosting")
            done += 1
        z = lambda k: F.col("__f")[k]
        loss = lambda k: F.avg(F.greatest(z(k), F.lit(0.0)) + F.log1p(F.exp(-F.abs(z(k)))) - F.col("__y") * z(k))
        got = rows.where("not __fit").agg(*[loss(k).alias(str(k)) for k in range(len(left))]).first()
        order = sorted(range(len(left)), key=lambda k: (round(got[k], 9) if got[k] is not None else math.inf, left[k]))
        ladder += [{"rung": rung, "config": left[k], "loss": got[k], "kept": k in order[: max(1, len(left) // 2)]} for k in range(len(left))]
        keep = sorted(order[: max(1, len(left) // 2)])
        if rung != rungs[-1]:
            rows = rows.withColumn("__f", F.array(*[F.col("__f")[k] for k in keep]))
            left = [left[k] for k in keep]
    winner = left[order[0]]
    return Boosted(base, float(configs[winner]["rate"]), models[winner], configs[winner]), ladder
