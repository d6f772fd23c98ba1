"""Content fingerprints of tables that don't depend on the order or names of rows and columns."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settled

#: Fixed value: the unit separator between cells.
CELL = "\u001f"
LEAST_DISTINCT, LEAST_LEVELS, LEAST_CELLS = 10, 3, 2


#: Powers of ten from 0 on as two numbers each that add up to them: the nearest one, and what that lacks.
POWERS = [float(10**k) for k in range(281)]
LACKING = [float(Fraction(10**k) - Fraction(p)) for k, p in enumerate(POWERS)]


def _product_error(x: Column, y: Column) -> Column:
    """What the rounded product x * y lacks, exactly."""
    high = lambda v: 134217729.0 * v - (134217729.0 * v - v)
    xh, yh = high(x), high(y)
    xl, yl = x - xh, y - yh
    return ((xh * yh - x * y) + xh * yl + xl * yh) + xl * yl


def _below_tie(a: Column, six: Column, k: Column) -> Column:
    """Whether a is less than six / 10^k, or equal to it after an even figure; by exact products."""
    of = lambda numbers: F.get(F.split(F.lit(" ".join(map(repr, numbers))), " ").cast("array<double>"), F.abs(k))
    ten, rest = of(POWERS), of(LACKING)
    over = F.when(k >= 0, (a * ten - six) + (_product_error(a, ten) + a * rest)).otherwise((a - six * ten) - (_product_error(six, ten) + six * rest))
    return (over < 0) | ((over == 0) & (F.floor(six / 10) % 2 == 0))


def five_figures(x: Column) -> Column:
    """A number's text at five significant figures as C and SQL print it (%.4e): its exact binary value is rounded, and of two
    texts equally near it has the even one. Exact for 0 and absolute values from 1e-270 to 1e270.

    Java's formatter rounds the shortest decimal text of a number, halves away from 0. It differs only for numbers whose
    six figures end in 5: of those, the ones that are less than that tie, or equal to it after an even figure, go down.
    """
    a = F.abs(x)
    k = 5 - F.floor(F.log10(a))  # a * 10^k has six places
    scaled = a * F.pow(F.lit(10.0), k.cast("double"))
    six = F.rint(scaled)
    near = (six % 10 == 5) & (F.abs(scaled - six) < 1e-5)
    # bound to names: few numbers get here, and the compiled code of the others stays short
    down = F.transform(F.array(F.struct(a.alias("a"), six.alias("six"), k.cast("int").alias("k"))), lambda t: _below_tie(t["a"], t["six"], t["k"]))[0]
    return F.format_string("%.4e", F.when(near, F.when(down, x * (1 - 1e-9)).otherwise(x)).otherwise(x))


def row_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row_hash): md5 of each row's finite numbers at five significant figures, sorted as texts; rows of one number are skipped."""
    cells = [F.col(c).cast("double") for c in columns]
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in cells]
    enough = sum((F.when(f, 1).otherwise(0) for f in finite), F.lit(0)) >= LEAST_CELLS
    texts = F.sort_array(F.array(*[F.when(f, five_figures(x)) for f, x in zip(finite, cells)]))
    return df.where(enough).select(F.md5(F.array_join(texts, CELL)).alias("row_hash"))  # nulls aren't joined


def column_fingerprints(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(column, fingerprint): of numbers, md5 over their distinct rounded values and counts in order (10 distinct or more); of
    categories, md5 over their level counts in order (3 levels or more). Values are counted first, so only distinct ones meet."""
    parts = []
    for c in numeric:
        value = five_figures(F.col(c).cast("double"))
        counts = df.where(F.col(c).isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        item = F.concat_ws(":", "v", "n")
        parts.append(counts.agg(F.count("*").alias("k"), F.md5(F.array_join(F.array_sort(F.collect_list(item)), CELL)).alias("fingerprint")).where(F.col("k") >= LEAST_DISTINCT).select(F.lit(c).alias("column"), "fingerprint"))
    for c in categorical:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        parts.append(counts.agg(F.count("*").alias("k"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x.cast("string")), CELL)).alias("fingerprint")).where(F.col("k") >= LEAST_LEVELS).select(F.lit(c).alias("column"), "fingerprint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def containment(candidate: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """One row: distinct hashes of the candidate, how many the reference has, and their share."""
    a, b = candidate.select(column).distinct(), reference.select(column).distinct().withColumn("__in", F.lit(1))
    got = a.join(b, column, "left").agg(F.count("*").alias("n"), F.count("__in").alias("shared"))
    return got.withColumn("share", F.try_divide(F.col("shared").cast("double"), F.col("n")))


def sorted_set_digest(df: DataFrame, column: str, head: str) -> DataFrame:
    """One row: SHA-256 of head and the sorted distinct values, one a line."""
    lines = F.array_join(F.array_sort(F.collect_set(column)), "\n")
    return df.agg(F.sha2(F.concat(F.lit(head + "\n"), lines), 256).alias("digest"), F.count_distinct(column).alias("n"))


def content_report(candidates: DataFrame, references: DataFrame, name: str, hashed: str) -> DataFrame:
    """(candidate, reference, shared, n, share) for every pair of differently named tables that share a hash: distinct
    hashes meet by equality, so only tables with a common one do."""
    a = candidates.select(F.col(name).alias("candidate"), F.col(hashed).alias("h")).distinct()
    b = references.select(F.col(name).alias("reference"), F.col(hashed).alias("h")).distinct()
    n = a.groupBy("candidate").agg(F.count("*").alias("n"))
    pairs = a.join(b, "h").where("candidate != reference").groupBy("candidate", "reference").agg(F.count("*").alias("shared"))
    return pairs.join(n, "candidate").withColumn("share", F.col("shared") / F.col("n"))


def overlaps(row_share, columns, column_share):
    """Whether two tables hold the same data: half of the rows, or three columns or more that are half of all."""
    return (row_share >= 0.5) | ((columns >= 3) & (column_share >= 0.5))


def best_match(report: DataFrame) -> DataFrame:
    """For each candidate the best reference: overlapping ones first, then by share, then by name."""
    held = report.withColumn("overlaps", overlaps(F.col("share"), F.lit(0), F.lit(0.0)))
    best = held.groupBy("candidate").agg(F.min(F.struct((~F.col("overlaps")).alias("apart"), (-F.col("share")).alias("less"), "reference", "shared", "share", "overlaps")).alias("b"))
    return best.select("candidate", "b.reference", "b.shared", "b.share", "b.overlaps")


#: Bits of a filter of hashes, and how many of them stand for each hash. A filter is one row of BITS / 8 bytes.
BITS, PROBES = 1 << 20, 4


def probes(hashed: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(hashed, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def hash_filter(hashes: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """One row with `words`, an array of bits / 64 numbers in which the bits of every hash are set: a Bloom filter.

    Bits are set by an aggregate on each word; what is gathered is the filter itself, whatever the number of hashes.
    """
    spots = hashes.select(F.explode(F.array(*probes(F.col(column), bits))).alias("bit"))
    words = spots.groupBy((F.expr("bit div 64")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("v"))
    every = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("v")).unionByName(words)
    full = every.groupBy("word").agg(F.bit_or("v").alias("v"))
    return full.agg(F.sort_array(F.collect_list(F.struct("word", "v"))).alias("w")).select(F.col("w.v").alias("words"))


def may_be_in(rows: DataFrame, column: str, held: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose hash may be in the filter (of `bits` bits): all that are, and few that aren't; with no shuffle."""
    words = held.withColumnRenamed("words", "__words")
    met = F.lit(True)
    for spot in probes(F.col(column), bits):
        word = F.get("__words", F.floor(spot / 64).cast("int"))
        met = met & (F.call_function("shiftrightunsigned", word, (spot % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return rows.join(F.broadcast(words), met, "left_semi")  # one row of bits / 8 bytes


def table_hashes(tables: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(name, row_hash) and (name, column, fingerprint) of numeric tables, given as {name: (rows, columns)}.

    A column's fingerprint is the number of its distinct values at five significant figures and the sum of 60-bit hashes
    of each with its count: nothing is gathered, and order doesn't matter. Null and non-finite cells are left out.
    """
    rows = columns = None
    for name, (df, names) in tables.items():
        hashed = row_hashes(df, names).select(F.lit(name).alias("name"), "row_hash")
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in names])).alias("c")).select("c.*")
        counts = cells.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))).groupBy("column", five_figures(F.col("x")).alias("v")).agg(F.count("*").alias("n"))
        number = F.conv(F.substring(F.md5(F.concat_ws(":", "v", "n")), 1, 15), 16, 10).cast("decimal(38,0)")
        prints = counts.groupBy("column").agg(F.concat_ws("-", F.count("*"), F.sum(number)).alias("fingerprint")).select(F.lit(name).alias("name"), "column", "fingerprint")
        rows, columns = (hashed, prints) if rows is None else (rows.unionByName(hashed), columns.unionByName(prints))
    return rows, columns


def catalogue_report(candidates: dict[str, tuple[DataFrame, list[str]]], references: dict[str, tuple[DataFrame, list[str]]], bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """What every candidate table shares with every reference table.

    The first table has a row for each candidate: hashed (its distinct row hashes), best (the reference that it is most
    likely from: overlapping ones first, then by share of rows, share of columns, name; null if none shares anything),
    its row_share, column_share and shared_columns, and overlapping, the names of all references that overlap it. The
    second has a row for each reference: hashed, and kept (rows that passed the filter, repeats included).

    References are scanned once; a filter of all candidates' row hashes drops nearly all their rows before anything is
    sent, and equality of hashes decides on the rest, so the filter's size changes no result.
    """
    mine, my_columns = table_hashes(candidates)
    theirs, their_columns = table_hashes(references)
    mine = settled(mine.distinct(), "candidate-hashes")
    kept = settled(may_be_in(theirs, "row_hash", settled(hash_filter(mine.select("row_hash").distinct(), "row_hash", bits), "filter"), bits), "kept")
    n = mine.groupBy(F.col("name").alias("candidate")).agg(F.count("*").alias("hashed"))
    met = mine.select(F.col("name").alias("candidate"), "row_hash").join(kept.select(F.col("name").alias("reference"), "row_hash").distinct(), "row_hash")
    by_row = met.groupBy("candidate", "reference").agg(F.count("*").alias("shared"))
    width = my_columns.groupBy(F.col("name").alias("candidate")).agg(F.count("*").alias("width"))
    same = my_columns.select(F.col("name").alias("candidate"), "column", "fingerprint").join(their_columns.select(F.col("name").alias("reference"), "fingerprint").distinct(), "fingerprint")
    by_column = same.groupBy("candidate", "reference").agg(F.count_distinct("column").alias("shared_columns"))
    pairs = by_row.join(by_column, ["candidate", "reference"], "full").join(n, "candidate", "left").join(width, "candidate")
    scored = pairs.select(
        "candidate", "reference", F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("hashed")), F.lit(0.0)).alias("row_share"),
        F.coalesce(F.col("shared_columns") / F.col("width"), F.lit(0.0)).alias("column_share"), F.coalesce("shared_columns", F.lit(0)).cast("bigint").alias("shared_columns"),
    ).withColumn("over", overlaps(F.col("row_share"), F.col("shared_columns"), F.col("column_share")))
    first = F.min(F.struct((~F.col("over")).alias("apart"), (-F.col("row_share")).alias("r"), (-F.col("column_share")).alias("c"), "reference", "row_share", "column_share", "shared_columns"))
    best = scored.groupBy("candidate").agg(first.alias("b"), F.array_sort(F.collect_list(F.when(F.col("over"), F.col("reference")))).alias("overlapping"))  # names of tables
    names = mine.sparkSession.createDataFrame([(c,) for c in candidates], "candidate string")
    report = names.join(n, "candidate", "left").join(best, "candidate", "left").select("candidate", F.coalesce("hashed", F.lit(0)).alias("hashed"), F.col("b.reference").alias("best"), "b.row_share", "b.column_share", "b.shared_columns", F.coalesce("overlapping", F.array().cast("array<string>")).alias("overlapping"))
    totals = theirs.groupBy(F.col("name").alias("reference")).agg(F.count("*").alias("hashed"))
    passed = totals.join(kept.groupBy(F.col("name").alias("reference")).agg(F.count("*").alias("kept")), "reference", "left").select("reference", "hashed", F.coalesce("kept", F.lit(0)).alias("kept"))
    return report, passed
