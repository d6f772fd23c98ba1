"""Knobs of generated tables: column shapes, activations, label conditions, schema edits, paths and sources. Every draw is a
hash of (row, salt); parameters are columns or numbers, so a table of tasks needs one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket, hash32, inverse_normal, uniform
from .quantiles import matches, quantiles
from .running import row_ranks, running_sum


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def with_moments(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Adds __mean and __sd (population) of the column's finite values in each group; one row a group is joined back."""
    x = F.col(column).cast("double")
    stats = df.where(finite(x)).groupBy(*[F.col(c).alias(f"__m_{c}") for c in by]).agg(F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__sd"))
    joined = df.join(stats, matches(by, "__m_"), "left") if by else df.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*df.columns, "__mean", "__sd")


def standardised(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Adds the z-score over the group's finite values; 0 for a missing value, and where there is no spread."""
    z = F.when(finite(F.col(column).cast("double")) & (F.col("__sd") > 1e-12), (F.col(column) - F.col("__mean")) / F.col("__sd")).otherwise(0.0)
    return with_moments(df, by, column).withColumn(name, z).drop("__mean", "__sd")


def heavy_tail(df: DataFrame, by: list[str], column: str, sharpness: float, name: str) -> DataFrame:
    """Adds sinh(a z) / a of the z-score: order and ties stay, tails grow. Missing stays missing; no spread: unchanged."""
    x = F.col(column)
    z = (x - F.col("__mean")) / F.col("__sd")
    return with_moments(df, by, column).withColumn(name, F.when(finite(x.cast("double")) & (F.col("__sd") > 1e-12), F.sinh(sharpness * z) / sharpness).otherwise(x)).drop("__mean", "__sd")


def tied(x: Column, low: Column, high: Column, levels: int) -> Column:
    """x rounded to `levels` places of equal distance between low and high."""
    span = high - low
    return F.when(span > 0, F.rint((x - low) / span * (levels - 1)) / (levels - 1) * span + low).otherwise(x)


def point_mass(x: Column, key: Column | str, share: float, value: Column, salt: str) -> Column:
    """A share of the rows takes one value; missing stays missing."""
    return F.when(x.isNotNull() & (uniform(key, F.lit(salt)) < share), value).otherwise(x)


def zero_inflated(x: Column, cut: Column, side: int = 1) -> Column:
    """max(side x - cut, 0)."""
    return F.when(x.isNotNull(), F.greatest(side * x - cut, F.lit(0.0)))


def unordered_codes(df: DataFrame, column: str, levels: int, exponent: float, salt: str, name: str) -> DataFrame:
    """Adds category codes: quantile bins whose sizes follow a Zipf law in hashed order, named by hashed codes."""
    order = sorted(range(levels), key=lambda k: _hash(f"{k}|{salt}|size"))
    weights = [1.0 / (k + 1) ** exponent for k in order]
    names = sorted(range(levels), key=lambda k: _hash(f"{k}|{salt}|name"))
    total, cum = sum(weights), []
    for w in weights[:-1]:
        cum.append((cum[-1] if cum else 0.0) + w / total)
    edges = quantiles(df, [], column, cum, "__edges")  # one row
    bin_ = F.size(F.filter("__edges", lambda e: e <= F.col(column)))
    code = F.element_at(F.array(*[F.lit(n) for n in names]), bin_ + 1)
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), code)).drop("__edges")


def _hash(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def rank_activation(df: DataFrame, by: list[str], column: str, key: str, name: str) -> DataFrame:
    """Adds the rank of the value within its group (equal ones by key), from -1 to 1. Ranks are prefix sums over ranges."""
    totals = df.groupBy(*by).agg(F.count("*").alias("__all")).withColumnsRenamed({c: f"__t_{c}" for c in by})
    ranked = row_ranks(df, by, column, [key], "__rank")
    met = ranked.join(totals, matches(by, "__t_")) if by else ranked.crossJoin(F.broadcast(totals))  # one row
    return met.select(*df.columns, (((F.col("__rank") - 1) / F.greatest(F.col("__all") - 1, F.lit(1)) - 0.5) * 2).alias(name))


def softmax(values: Column) -> Column:
    """Array -> its softmax."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def shares_of(values: Column) -> Column:
    """Array -> negatives cut off, scaled to a sum of 1; zeros if nothing is left."""
    cut = F.transform(values, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(cut, F.lit(0.0), lambda s, x: s + x)
    return F.transform(cut, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def binarised(df: DataFrame, column: str, context: Column, q: float, name: str) -> DataFrame:
    """Adds column > its quantile over the context rows; refused if that leaves one class there."""
    cut = quantiles(df.where(context), [], column, [q]).select(F.col("q")[0].alias("__cut"))  # one row
    out = df.crossJoin(F.broadcast(cut)).withColumn(name, (F.col(column) > F.col("__cut")).cast("bigint")).drop("__cut")
    if out.where(context & F.col(name).isNotNull()).select(name).distinct().count() < 2:
        raise ValueError(f"{column} has one side only")
    return out


def swapped(df: DataFrame, label: str, column: str) -> DataFrame:
    """The label and a column change places."""
    return df.select(*[F.col({label: column, column: label}.get(c, c)).alias(c) for c in df.columns])


def context_labels(y: Column, condition: str, key: Column | str, other: Column | None = None) -> Column:
    """Labels of context rows: true, inverted, none (all 0), unrelated (another task's), or flip_<rate>."""
    if condition == "true":
        return y
    if condition == "inverted":
        return 1 - y
    if condition == "none":
        return y * 0
    if condition == "unrelated" and other is not None:
        return other
    if condition.startswith("flip_") and 0 <= (rate := float(condition[5:])) <= 1:
        return F.when(uniform(key, F.lit("flip")) < rate, 1 - y).otherwise(y)
    raise ValueError(f"unknown condition {condition}")


def nuisance(x: Column, key: Column | str, salt: str, missing: float = 0.0, shift: float = 0.0, widen: float = 0.0) -> Column:
    """x widened, shifted, then missing for a share of the rows; labels are not touched."""
    if not 0 <= missing <= 1 or widen <= -1:
        raise ValueError("missing must lie in [0, 1], widen above -1")
    return F.when(uniform(key, F.lit(salt)) >= missing, x * (1 + widen) + shift)


def with_noise(df: DataFrame, key: str, k: int, prefix: str = "noise") -> DataFrame:
    """Adds k standard normal columns that depend on the key only."""
    return df.withColumns({f"{prefix}_{i}": inverse_normal(uniform(key, F.lit(f"{prefix}{i}")) * (1 - 2e-9) + 1e-9) for i in range(k)})


def edited_schema(df: DataFrame, features: list[str], edit: str, key: str) -> DataFrame:
    """A layout edit of the features: scaled, permuted (names change places), duplicated, discretised, or missing (one in five)."""
    if edit == "scaled":
        return df.withColumns({c: F.col(c) * (10.0 ** (i % 5 - 2)) for i, c in enumerate(features)})
    if edit == "permuted":
        return df.withColumns({c: F.col(features[i - 1]) for i, c in enumerate(features)})
    if edit == "duplicated":
        return df.withColumns({f"{c}_again": F.col(c) for c in features})
    if edit == "discretised":
        return df.withColumns({c: F.rint(F.col(c) * 4) / 4 for c in features})
    if edit == "missing":
        return df.withColumns({c: F.when(bucket(5, key, F.lit(c)) > 0, F.col(c)) for c in features})
    raise ValueError(f"unknown edit {edit}")


def regime_distribution(horizons: int, decay: float, late: bool = False) -> list[float]:
    """Cumulative default periods of a geometric law, forward or reversed; ends at 1."""
    if not 0 < decay < 1:
        raise ValueError("decay lies between 0 and 1")
    mass = [decay**k for k in range(horizons)]
    mass = [m / sum(mass) for m in (mass[::-1] if late else mass)]
    return [sum(mass[: k + 1]) for k in range(horizons)]


def persistent_path(key: Column | str, years: int, ar: float, share: float) -> Column:
    """Array of yearly values of an entity: sqrt(share) times a lasting effect, and a stationary AR(1) path beside it."""
    z = lambda salt: inverse_normal(uniform(key, salt) * (1 - 2e-9) + 1e-9)
    shock = F.transform(F.sequence(F.lit(0), F.lit(years - 1)), lambda i: z(F.concat(F.lit("shock"), i.cast("string"))))
    step = lambda s, e: F.concat(s, F.array(F.when(F.size(s) == 0, e).otherwise(ar * F.element_at(s, -1) + (1 - ar * ar) ** 0.5 * e)))
    path = F.aggregate(shock, F.array().cast("array<double>"), lambda s, e: F.when(F.size(s) == 0, F.array(e)).otherwise(step(s, e)))
    return F.transform(path, lambda x: share**0.5 * z(F.lit("effect")) + (1 - share) ** 0.5 * x)


def cycle_to(final: Column, key: Column | str, years: int, ar: float) -> Column:
    """Array of yearly values that ends at `final`: an AR(1) path made backward from it."""
    z = lambda i: inverse_normal(uniform(key, F.concat(F.lit("cycle"), i.cast("string"))) * (1 - 2e-9) + 1e-9)
    back = F.aggregate(F.sequence(F.lit(1), F.lit(years - 1)), F.array(final), lambda s, i: F.concat(s, F.array(ar * F.element_at(s, -1) + (1 - ar * ar) ** 0.5 * z(i))))
    return F.reverse(back)


def source_shares(weights: dict[str, float]) -> dict[str, float]:
    """Weights as shares; a negative weight, or none above 0, is refused."""
    if any(w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be 0 or more, with one above 0")
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def drawn_source(key: Column | str, weights: dict[str, float]) -> Column:
    """The source of each task: the first whose cumulative share lies above the task's uniform number."""
    u, total, out = uniform(key, F.lit("source")), 0.0, None
    named = list(source_shares(weights).items())
    for name, share in named[:-1]:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return F.lit(named[-1][0]) if out is None else out.otherwise(named[-1][0])


def feature_bands(spec: str) -> list[tuple[float, float, float]]:
    """'low-high:weight,...' as (low, high, weight); weights above 0, bounds in order within [0, 1]."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        bounds, _, weight = part.partition(":")
        low, high = (float(b) for b in bounds.split("-"))
        if not 0 <= low <= high <= 1 or float(weight or 1) <= 0:
            raise ValueError(f"bad band {part}")
        out.append((low, high, float(weight or 1)))
    return out


def rate_thinned(df: DataFrame, label: str, rate: float, key: list[str], least: int = 4, least_rows: int = 200) -> DataFrame | None:
    """Rows at a positive rate: all positives and as many negatives as it implies, or all negatives and fewer positives; in
    the order of hashes. None if either class has under `least` rows, or fewer than least_rows rows would be left."""
    counts = {int(r[0]): r[1] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}  # two rows
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if min(pos, neg) < least:
        return None
    want = int(pos * (1 - rate) / rate)
    keep = {1: pos, 0: want} if want <= neg else {1: int(neg * rate / (1 - rate)), 0: neg}
    if keep[1] < least or sum(keep.values()) < least_rows:
        return None
    parts = [df.where(F.col(label) == k).orderBy(hash32(*key), *key).limit(n) if n < counts[k] else df.where(F.col(label) == k) for k, n in keep.items()]
    return parts[0].unionByName(parts[1])


def both_classes(panel: DataFrame, drawn: DataFrame, label: str, key: str, floor: int) -> DataFrame:
    """drawn, its negatives in hash order swapped for positives of the panel until it has `floor` positives, then the other
    way for one negative. Labels are never edited; a panel that can't supply both is refused. drawn fits one task's table."""
    out = drawn
    size = drawn.count()
    for cls, want in ((1, min(max(floor, 1), size - 1)), (0, 1)):
        have = out.where(F.col(label) == cls).count()
        pool = panel.where(F.col(label) == cls).join(out.select(key), key, "left_anti").orderBy(hash32(key, F.lit("in")), key).limit(max(0, min(want - have, size - have)))
        n = pool.count()
        if n:
            leave = out.where(F.col(label) != cls).orderBy(hash32(key, F.lit("out")), key).limit(n).select(key)
            out = out.join(leave, key, "left_anti").unionByName(pool.select(*out.columns))
    if out.select(label).distinct().count() < 2:
        raise ValueError("the panel can't supply both classes")
    return out


def shuffle_folds(df: DataFrame, label: str, key: list[str], folds: int, share: float) -> DataFrame:
    """(fold, part and the columns): for each fold, the first `share` of each class in that fold's hash order are test rows;
    the one row of a singleton class always trains. Classes are ranked by prefix sums, so a class may be large."""
    turns = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)).cast("array<bigint>")))
    h = hash32("fold", *key) * 1.0
    ranked = turns.withColumn("__h", h)
    counts = running_sum(ranked.groupBy("fold", label, "__h").agg(F.count("*").alias("__n")), ["fold", label], "__h", {"__end": "__n"}).withColumnsRenamed({"fold": "__f", label: "__l", "__h": "__hh"})
    sizes = df.groupBy(F.col(label).alias("__sl")).agg(F.count("*").alias("__size"))
    met = ranked.join(counts, (F.col("fold") == F.col("__f")) & F.col(label).eqNullSafe(F.col("__l")) & (F.col("__h") == F.col("__hh"))).join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__sl")))  # a row for each class
    test = (F.col("__size") > 1) & (F.col("__end") <= F.rint(F.col("__size") * share))
    return met.select(*df.columns, "fold", F.when(test, "test").otherwise("train").alias("part"))


def refuse_single_class(placed: DataFrame, by: list[str], label: str) -> None:
    """Refuse splits with a side of one class."""
    bad = placed.groupBy(*by).agg(F.count_distinct(label).alias("n")).where("n < 2").take(1)
    if bad:
        raise ValueError(f"one class only: {bad[0].asDict()}")


def member_columns(names: list[str], size: int, members: int, seed: str) -> list[list[str]]:
    """Subsets of `size` columns, dealt in turn from a hashed order until every column is in one."""
    order = sorted(names, key=lambda c: _hash(f"{seed}|{c}"))
    n = max(members, -(-len(names) // size))
    return [sorted((order[(i * size + j) % len(order)] for j in range(size)), key=names.index) for i in range(n)]


def mutual_information(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, mi) in nats between each discrete column and the label, from pair counts; rows with a null in either are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in features])).alias("x")
    pairs = df.where(F.col(label).isNotNull()).select(cells, F.col(label).alias("l")).select("x.*", "l").where("v is not null").groupBy("feature", "v", "l").agg(F.count("*").alias("n"))
    v = pairs.groupBy("feature", "v").agg(F.sum("n").alias("nv"))
    both = pairs.groupBy("feature", "l").agg(F.sum("n").alias("nl"))
    total = pairs.groupBy("feature").agg(F.sum("n").alias("all"))
    met = pairs.join(v, ["feature", "v"]).join(both, ["feature", "l"]).join(total, "feature")
    return met.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nv") * F.col("nl")))).alias("mi"))


def best_columns(df: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    """The k columns that tell most about the label, constant ones left out; of equal ones the earlier. A row a column comes back."""
    kept = df.agg(*[F.count_distinct(c).alias(c) for c in features]).first()
    some = [c for c in features if kept[c] > 1]
    score = {r.feature: r.mi for r in mutual_information(df, some, label).collect()} if some else {}
    return sorted(sorted(some, key=lambda c: (-round(score.get(c, 0.0), 12), features.index(c)))[:k], key=features.index)
