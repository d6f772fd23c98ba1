"""Readers of raw filings, loans and registers: explicit schemas, tolerant parsing, column pruning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns that are never features, besides those that start with an underscore.
BOOKKEEPING = {"label", "loan_id", "cik", "period_end"}


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A delimited text with a schema: no inference pass; malformed cells become null."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, encoding=encoding, mode="PERMISSIVE")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Annual reports: ';'-separated texts to ids, a year, dates (dd.MM.yyyy) and flags ('Jah' is yes)."""
    names = ["report_id", "code", "form", "status", "year", "consolidated", "period_end", "filed", "audited"]
    raw = delimited(spark, path, ", ".join(f"{n} string" for n in names), sep=";")
    day = lambda c: F.try_to_date(F.trim(c), "dd.MM.yyyy")
    return raw.select(
        F.col("report_id").try_cast("long").alias("report_id"), F.col("code").try_cast("long").alias("code"), "form", "status", F.col("year").try_cast("int").alias("year"),
        (F.trim("consolidated") == "Jah").alias("consolidated"), day("period_end").alias("period_end"), day("filed").alias("filed"), (F.trim("audited") == "Jah").cast("int").alias("audited"),
    )


def elements(spark: SparkSession, paths: list[str], report_ids: DataFrame, wanted: list[str], skip_tables: str) -> DataFrame:
    """Report elements, long to wide: tables that match skip_tables and reports not asked for are left out before the
    shuffle; of repeated elements the first in file order stays."""
    raw = spark.read.schema("report_id string, `table` string, label string, element string, value string").csv(paths, sep=";", header=True)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = raw.where(~F.col("table").rlike(skip_tables) & F.col("element").isin(wanted)).select(F.col("report_id").try_cast("long").alias("report_id"), "element", F.col("value").try_cast("double").alias("value"), place.alias("place"))
    kept = rows.join(report_ids.select("report_id").distinct(), "report_id", "left_semi")
    first = kept.groupBy("report_id", "element").agg(F.min_by("value", "place").alias("value"))
    return first.groupBy("report_id").pivot("element", wanted).agg(F.first("value"))


def register_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(code, date): entries of one type from nested registry cards (company, cards, entries)."""
    schema = "code long, cards array<struct<entries: array<struct<date: string, type: string>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    entries = raw.select("code", F.explode("cards").alias("card")).select("code", F.explode("card.entries").alias("e"))
    return entries.where(F.col("e.type") == kind).select("code", F.coalesce(F.try_to_date("e.date", "dd.MM.yyyy"), F.try_to_date("e.date", "yyyy-MM-dd")).alias("date"))


def fundamentals(spark: SparkSession, sub: str, num: str, forms: list[str], tags: list[str]) -> DataFrame:
    """Filings with their first reported value of each tag (tab-separated sub and num tables): filter, first, pivot, join."""
    filings = spark.read.schema("adsh string, cik long, form string, period string, filed string").csv(sub, sep="\t", header=True).where(F.col("form").isin(forms))
    facts = spark.read.schema("adsh string, tag string, ddate string, qtrs int, value string").csv(num, sep="\t", header=True).where(F.col("tag").isin(tags) & F.col("qtrs").isin(0, 4))
    order = W.partitionBy("adsh", "tag").orderBy(F.desc("ddate"), "value")
    first = facts.withColumn("r", F.row_number().over(order)).where("r = 1").select("adsh", "tag", F.col("value").try_cast("double").alias("value"))
    wide = first.groupBy("adsh").pivot("tag", tags).agg(F.first("value"))
    day = lambda c: F.try_to_date(c, "yyyyMMdd").alias(c)
    return filings.select("adsh", "cik", "form", day("period"), day("filed")).join(wide, "adsh")


def distress_flags(spark: SparkSession, path: str, columns: int = 35, loan: int = 0, code: int = 8, bad: tuple[str, ...] = ("03", "09")) -> DataFrame:
    """(loan_id, label): whether any monthly row of a loan has a code of distress; '|'-separated, without a header. Two columns are read."""
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(columns))).csv(path, sep="|")
    return raw.groupBy(F.col(f"c{loan}").alias("loan_id")).agg(F.max(F.col(f"c{code}").isin(*bad).cast("int")).alias("label"))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BOOKKEEPING and not c.startswith("_")]


def panel(spark: SparkSession, path: str, forbidden: tuple[str, ...] = ("eval_only",)) -> DataFrame:
    """A Parquet panel; folders of a forbidden name are refused before anything is read."""
    if any(part in forbidden for part in re.split(r"[/\\]+", path)):
        raise ValueError(f"{path} is for evaluation only")
    return spark.read.parquet(path)


def panel_weights(spec: str) -> dict[str, float]:
    """'path=0.3,other=0.7' -> weights; refuses repeats, bad numbers and sums above 1."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        path, eq, weight = part.rpartition("=")
        if not eq or not path:
            raise ValueError(f"no weight in {part!r}")
        value = float(weight)
        if path in out or not 0 < value <= 1:
            raise ValueError(f"bad entry {part!r}")
        out[path] = value
    if sum(out.values()) > 1 + 1e-9:
        raise ValueError("weights add up to more than 1")
    return out


def arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF text as strings: attribute names from its head, one row for each data line; '?' is null."""
    text = spark.read.text(path)
    names = [r.n for r in text.where(F.lower("value").rlike(r"^\s*@attribute")).select(F.regexp_extract("value", r"(?i)@attribute\s+('[^']*'|\"[^\"]*\"|\S+)", 1).alias("n")).collect()]  # a head, not data
    names = [n.strip("'\"") for n in names]
    cells = F.split(F.trim("value"), r"\s*,\s*")
    data = text.where(~F.trim("value").rlike(r"^(@|%|$)")).select(cells.alias("c"))
    return data.select(*[F.nullif(F.get("c", F.lit(i)), F.lit("?")).alias(n) for i, n in enumerate(names)])


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """(repeat, fold, part, rows): sorted row ids of each side of each split, from an ARFF split file (type, rowid, repeat, fold)."""
    rows = arff(spark, path)
    kind, row, repeat, fold = rows.columns[:4]
    return rows.groupBy(F.col(repeat).cast("int").alias("repeat"), F.col(fold).cast("int").alias("fold"), F.lower(kind).alias("part")).agg(F.sort_array(F.collect_list(F.col(row).cast("double").cast("long"))).alias("rows"))


def zipped_table(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """CSV members of zip files, a file a task: Spark reads the bytes, so any store will do."""
    import io
    import zipfile

    fields = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    got = pd.read_csv(z.open(member))
                got.columns = fields
                yield got

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
