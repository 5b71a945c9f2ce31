"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, codes, decontaminate, divergence, jaccard, linededup, lm, pieces, quality, secrets, sql, suffixdedup, toxicity
from ._common import read_table


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def codec() -> bpe.Codec:
    import public_tokenizers

    return bpe.codec_from(tokenizer_path(), public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_docs(spark, sf_dir), codec())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(_docs(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(_docs(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_docs(spark, sf_dir), read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_docs(spark, sf_dir))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_docs(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_docs(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report(_docs(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir, "lang", "source"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_docs(spark, sf_dir), pieces.codec_from(tokenizer_path("piece_bpe_32k.model")))


def queries() -> dict:
    own = (op1_line_dedup, op2_jaccard_join, op3_suffix_dedup, op4_chat, op5_decontaminate, op6_quality, op7_suffix_tree_lm, op8_byte_bpe, op9_toxicity, op10_secrets, op11_vector_codes, op12_source_divergence, op13_sentencepiece)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
