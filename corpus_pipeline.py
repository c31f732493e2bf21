"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, byte-level BPE. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs; all but the last
return the columns of documents.

Nulls in any column, empty texts, ties, repeated rows, empty tables and further columns (also ones named as columns that
operators use inside) are handled by every stage as its docstring says; columns other than text and n_chars come out as
they went in."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from phylospark.llm import bpe, mixing, orderhash, quality, substring
from phylospark.llm import common as c


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or their language's proven cutoff go: those of null or empty texts, too. Repeated
    rows are judged each. No documents give none."""
    return quality.passing(docs, c.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the least doc_id (null last), of equal ids the least text hash.
    Repeated rows are copies; null and empty texts are copies of each other. No documents give none."""
    return orderhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur twice go from every text, with n_chars counted anew there. A null text stays
    null; repeated rows lose what windows cover; a document may end up empty, but stays. No documents give none."""
    return substring.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with null as a source of its own. Documents of sources without words go;
    rows that are equal in id and text are taken equally often. No documents give none."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to; a null text is an empty one, a null doc_id stays
    null, repeated rows come out each."""
    return bpe.digest(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mixing", source_mixing), ("byte_bpe", byte_bpe)]

#: Near-dedup and byte-level BPE have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
