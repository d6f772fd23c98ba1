"""Column builders: deterministic hashing, tolerant parsing, guarded arithmetic, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash32(*keys: Column | str) -> Column:
    """The first 32 bits of the md5 of the keys, joined by '|'; the order that stands in for random draws."""
    text = F.concat_ws("|", *[as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return hash32(*keys) / F.lit(4294967296.0)


def bucket(n: int, *keys: Column | str) -> Column:
    return F.pmod(hash32(*keys), F.lit(n))


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(as_column(a).cast("double"), F.nullif(as_column(b).cast("double"), F.lit(0.0)))


def floored_ratio(num: Column, den: Column, floor: Column) -> Column:
    """num / den with the denominator kept at least `floor` away from 0, on its own side."""
    return num / F.when(den < 0, -F.greatest(F.abs(den), floor)).otherwise(F.greatest(F.abs(den), floor))


def clip(x: Column | str, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null (greatest and least alone would skip it)."""
    x = as_column(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def sum_any(*parts: Column | str) -> Column:
    """The sum of the parts that are there; null if none is."""
    parts = [as_column(p) for p in parts]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def money(x: Column | str) -> Column:
    """The number in a text like '$1,234.50'; null if there is none."""
    return F.regexp_replace(as_column(x), "[$,]", "").try_cast("double")


def sentinel(x: Column | str, missing: str) -> Column:
    """A number, null where the text is the field's mark for missing or no number."""
    return F.nullif(F.trim(as_column(x)), F.lit(missing)).try_cast("double")


def years_employed(x: Column | str) -> Column:
    """'10+ years' -> 10, '< 1 year' -> 0, text without digits -> null."""
    x = as_column(x)
    return F.when(x.startswith("< 1"), F.lit(0.0)).otherwise(F.nullif(F.regexp_extract(x, "([0-9]+)", 1), F.lit("")).try_cast("double"))


def code8(x: Column | str) -> Column:
    """A registry number: trimmed, upper case, at most 8 of A-Z and 0-9, digits alone padded by zeros; else null."""
    x = F.upper(F.trim(as_column(x)))
    return F.when(x.rlike("^[0-9]{1,8}$"), F.lpad(x, 8, "0")).when(x.rlike("^[A-Z0-9]{1,8}$"), x)


def parse_date(x: Column | str) -> Column:
    """dd/MM/yyyy or yyyy-MM-dd; else null."""
    x = F.trim(as_column(x))
    return F.coalesce(F.expr("CAST(NULL AS DATE)"), F.try_to_date(x, "d/M/yyyy"), F.try_to_date(x, "yyyy-MM-dd"))


def whole_months(earlier: Column | str, later: Column | str) -> Column:
    """Calendar months between two dates, one less if the later day of the month hasn't reached the earlier one."""
    a, b = as_column(earlier), as_column(later)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")).cast("bigint")


def industry_codes(columns: list[Column | str]) -> Column:
    """The five leading digits of each text that starts with five digits, in order."""
    heads = F.transform(F.array(*[as_column(c) for c in columns]), lambda c: F.substring(F.trim(c), 1, 5))
    return F.filter(heads, lambda c: c.rlike("^[0-9]{5}$"))


def folded(x: Column | str) -> Column:
    """Lower case, letters and digits only: names are compared so."""
    return F.regexp_replace(F.lower(as_column(x)), "[^a-z0-9]", "")


def same_name(a: Column, b: Column) -> Column:
    """Folded names that are equal, or of which the shorter one (6 or more characters) is part of the longer one."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) >= 6) & long.contains(short))


def tokens(x: Column | str, stop: list[str]) -> Column:
    """Distinct words of four or more letters, without the stop words."""
    found = F.regexp_extract_all(F.lower(as_column(x)), F.lit("[a-z]{4,}"), 0)
    return F.array_sort(F.array_except(found, F.array(*[F.lit(s) for s in stop]) if stop else F.expr("array('')")))


def licence_ok(x: Column | str) -> Column:
    """Whether a licence lets data be used and shared freely: CC0, public domain, MIT, or CC BY without NC, ND or SA."""
    flat = folded(x)
    by = flat.rlike("^ccby") & ~flat.rlike("(nc|nd|sa)") | flat.rlike("creativecommonsattribution") & ~flat.rlike("(noncommercial|noderiv|sharealike)")
    return F.coalesce(by | flat.rlike("^(cc0|publicdomain|mit)"), F.lit(False))


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds (null counts as not), else null."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules])


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]), lambda r: r.isNotNull())


def sigmoid(x: Column) -> Column:
    return F.lit(0.5) * (1 + F.tanh(0.5 * x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def squash(z: Column, limit: float = 3.0) -> Column:
    """z / sqrt(1 + (z / limit)^2): soft clipping."""
    return z / F.sqrt(1 + (z / limit) * (z / limit))


def entropy_bits(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def edges_below(x: Column, edges: Column) -> Column:
    """How many edges are at or below x: the bin above an edge takes the edge."""
    return F.size(F.filter(edges, lambda e: e <= x))


def quarter_label(index: Column) -> Column:
    """'2024q3' of year * 4 + quarter - 1."""
    return F.concat(F.floor(index / 4).cast("string"), F.lit("q"), (F.pmod(index, F.lit(4)) + 1).cast("string"))


def inverse_normal(p: Column) -> Column:
    """Acklam's rational approximation of the inverse normal distribution (relative error below 1.15e-9)."""
    # fixed values: the published coefficients
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    poly = lambda cs, x: reduce(lambda s, k: s * x + k, cs[1:], F.lit(cs[0]))
    mid = p - 0.5
    r = mid * mid
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda q: poly(c, q) / poly(d, q)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(mid * poly(a, r) / poly(b, r))
