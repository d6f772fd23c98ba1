"""Queries over whole tables: op1, op5 and op8, which need a vocabulary file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries_a import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import describe_file, write_ids

    return describe_file(spark, write_ids(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after two edits: 16 characters of its middle are replaced, and a sentence is added to its end."""
    import public_tokenizers

    from .token_tree import count_edited

    half = "CAST(floor(char_length(text) / 2) AS BIGINT)"
    edits = F.expr(f"array(named_struct('start', {half}, 'end', {half} + 16, 'new', ' an edited passage'), named_struct('start', CAST(char_length(text) + 64 AS BIGINT), 'end', CAST(NULL AS BIGINT), 'new', ' It was added later.'))")
    docs = documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits"))
    counted = count_edited(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_tokens", "n_pieces", "n_tokens_edited", "n_encoded", F.sha2("edited", 256).alias("edited_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    coded = encode_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), decode=True)
    return coded.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
