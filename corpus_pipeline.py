"""The corpus pipeline: quality rules, near-dedup, mixing, packing, each on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of
``documents``. An empty table passes through every stage without rows; nulls are
treated as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylocus.llm import common, mixing, packing, quality, similar
from skylocus.llm.queries import MIX_WEIGHTS, tokenizer_path

#: Words of a shingle, similarity of near copies, and bits in which linked fingerprints differ at most.
DEDUP_WORDS, DEDUP_SIMILARITY, DEDUP_BITS = 5, 0.8, 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current policy keeps."""
    return quality.apply(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return similar.without_similar(docs, DEDUP_WORDS, DEDUP_SIMILARITY, DEDUP_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: copies are rows of their own."""
    copies = mixing.mix(docs, MIX_WEIGHTS).select("doc_id", "copies")
    return mixing.taken_rows(docs, copies)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 ids."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Fingerprints and tokens are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole ``documents`` table, each read back from the shared folder."""
    rows = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            folder = common.new_folder(spark, f"pipeline-{k}-{name}")
            rows.write.parquet(folder)
            rows = spark.read.parquet(folder)
    return rows
