"""A corpus pipeline of five stages: rules, classifier, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; a runner writes it as Parquet and gives it to the next
as docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, mixing, quality_model, quality_rules, simhash
from quillon.llm.common import stored, table


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list rejects go.

    Null, blank and short texts fail the base test and go; null ids, ties and repeated rows are judged by their text alone; an empty table gives
    none; a very long text is measured whole; columns of any name pass through.
    """
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    return quality_rules.apply_rules(docs, rules)


def keep_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go.

    A null or blank text scores by the model's bias alone; a score of just 0.3 stays; null ids are scored, never learned from; repeated rows
    score alike; an empty table gives none; without labels every score is one half, so all stay; columns of any name pass through.
    """
    return quality_model.keep_good(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays: shingles of five words, 256-bit fingerprints, texts compared.

    Texts without words are one class; null ids come last; of rows that share an id or have none each stays whose text is of a class of its own;
    of equal ids in a class one row stays; an empty table gives none; a very long text is read whole; columns of any name pass through.
    """
    return simhash.keep_one(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says.

    A null text has no words and is emitted as its source's rate says; a null source is a source of its own; rows of one id, and those without
    one, share a draw; a source without words has rate 0; an empty table gives none; columns of any name pass through.
    """
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its token count and the digests of its ids and of what they decode to.

    A null text is empty and has no ids; null ids and repeated rows are rows like others; an empty table gives none; other columns are left.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_model),
    ("near-duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", to_tokens),
]

#: The learned stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
