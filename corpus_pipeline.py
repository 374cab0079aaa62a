"""From raw documents to token ids: STAGES applied in order to the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilmill.llm import line_dedup, mixing, ngram_join, quality_rules, registry, spm
from veilmill.llm.common import load, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a learned rule rejects go."""
    return quality_rules.keep_good(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go from later ones."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return ngram_join.first_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per turn in which the mix takes words of it."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_units, n_pieces, ids, decoded_sha256 of each document of the mix."""
    return spm.encode_decode(docs, spm.Pieces.load(registry.PIECE_MODEL))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("mixing", mixture), ("sentencepiece", pieces)]

#: The stages learn from labels, align sequences and merge symbols, which SQL can't express; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
