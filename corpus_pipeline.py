"""The corpus pipeline: quality, exact copies, near copies, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import exact, jaccard, mixing, pieces, quality
from packetloom.llm.common import fold, stored, table


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1; labels of held-out ids stay unseen."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    return docs.filter(quality.scorer(docs, model) >= F.lit(0.3))


def drop_exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.survivors(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least id."""
    return jaccard.survivors(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by the mix."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the id and source of each document."""
    return pieces.encode(docs, carry=("doc_id", "lang", "source"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

# The trained classifier, the forest and the tokenizer have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
