"""From raw documents to packed sequences; each stage works on all that the one before it kept.

Every stage takes nulls in any column, empty and very long texts (read whole), ties, repeated rows, columns beyond those of
documents, and empty tables, which stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chordgrid.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from chordgrid.llm.common import WORD, documents, numbered, stored, text_of
from chordgrid.llm.tokenizing import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the fitted model does not reject. Null and empty texts have no sign of toxicity; repeated rows share a fate."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id; null counts as empty, a null doc_id as the largest."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 80 of 100 five-word shingles in common join; texts without words stay."""
    return ngram_join.drop_near_duplicates(docs, width=5, similarity=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and parts of documents that the mix takes, in the order of its slots; empty and blank texts are never taken."""
    docs = numbered(docs)
    words = F.regexp_count(text_of("text"), F.lit(WORD))
    return mixing.mixed_rows(docs, *mixing.mix(docs, size=words, carry=["doc_id"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in sequences of at most 2,048; an empty text is the lone end id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again. An empty table gives an empty result."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
