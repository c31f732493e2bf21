"""Queries of the corpus operators, one for each, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.llm import bpe, chat, mincut, mixing, orderhash, quality, severity, substring, tokens, winnow
from phylospark.llm import common as c


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edits(c.table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return chat.read_back(chat.examples(talks.unionByName(spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = c.stored(quality.scored(c.table(spark, sf_dir, "documents")), "scored")
    return quality.judge(marked, c.table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(c.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(c.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return severity.predict(docs, severity.fit(docs, c.table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(c.table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return bpe.digest(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.near_duplicates(c.table(spark, sf_dir, "documents"))


def op10_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(c.table(spark, sf_dir, "pages"))


def queries():
    own = (op1_winnowing, op2_chat_formatting, op3_quality_rules, op4_token_counts, op5_source_mixing, op6_toxic_severity, op7_substring_dedup, op8_byte_bpe, op9_order_minhash, op10_html_mincut)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.SQL, "op3_quality_rules": quality.SQL, "op5_source_mixing": mixing.SQL, "op7_substring_dedup": substring.SQL}
