"""A training-data pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents. They leave the session's Arrow batches at 512 rows or fewer. Nulls: a null text is rejected by the
first stage; null ids keep their rows apart (see the operators). An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.bpe import encode_documents
from panelforge.llm.cluster import broadcast_few, small_batches, through_table
from panelforge.llm.language import fit, predict
from panelforge.llm.lines import remove_lines
from panelforge.llm.positions import contaminated
from panelforge.llm.queries_b import tokenizer_path
from panelforge.llm.simhash import keep_one

#: A text is rejected if no language has this probability, or if it has no letter.
LEAST_SCORE = 0.5
#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with a probability of LEAST_SCORE; the model is fitted on those with a language."""
    small_batches(spark)
    sure = predict(docs, fit(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return sure.select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of each text the lines that stand before, equal or nearly so; n_chars follows."""
    return remove_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component, on shingles of five words.

    Links are op 2's, at two bits of 64, so copies of a Jaccard similarity of 0.8 are mostly kept (there about ten bits
    differ, which no segment variants can index). Null and empty texts are alike; of an empty table nothing is kept.
    """
    small_batches(spark)
    return keep_one(docs, shingle=SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs."""
    small_batches(spark)
    hashed = docs.select(F.xxhash64("text").alias("th"), "text")
    found = contaminated(hashed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="th").where(F.size("spans") > 0)
    hits = through_table(found.select(F.col("doc_id").alias("__th")).distinct(), "contaminated")
    return docs.join(broadcast_few(hits), F.xxhash64("text") == F.col("__th"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digest of the bytes that they decode to."""
    small_batches(spark)
    coded = encode_documents(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), decode=True)
    return coded.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Language models, SimHash and BPE have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
