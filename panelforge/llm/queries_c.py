"""Queries over whole tables: op3, op7 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries_a import documents


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import edited_fingerprints

    return edited_fingerprints(documents(spark, sf_dir))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 10: classes of documents over banded, verified links."""
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .positions import contaminated

    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = "aggregate(transform(spans, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)"
    return found.select(
        "doc_id", "n_words", F.expr(hits).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.expr("sha2(array_join(array_sort(transform(items, x -> CAST(x AS STRING))), ','), 256)").alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_components

    found = line_components(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "classes", "n_links", "components")


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import removed, repeated_spans

    return removed(repeated_spans(documents(spark, sf_dir))).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import fuzzy_passages

    found = fuzzy_passages(documents(spark, sf_dir))
    sources = F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["source"])))
    return found.select("doc_id", "n_words", F.size("passages").cast("long").alias("n_passages"), sources.alias("sources"), "passages")
