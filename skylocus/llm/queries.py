"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, common, ctw, hilbert, mixing, packing, quality, simhash, tokenfiles, urlfilter, warc

DOC_CELLS_BITS = 7


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards along a curve through language, source and size; shard row counts at most one apart.

    Equal texts of equal language and source are neighbours on it, but may lie on both sides of a cut.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_md5"),
    )
    classes = {
        "lang_cell": hilbert.category_class(F.col("lang")), "source_cell": hilbert.category_class(F.col("source")), "size_cell": hilbert.size_class(F.col("size")),
    }
    # texts are read once: what follows reads a few dozen bytes of each
    docs = hilbert.equal_cells(common.checkpoint(docs), classes, DOC_CELLS_BITS)
    out = hilbert.shard(docs, {c: F.col(c) for c in classes}, DOC_CELLS_BITS, 8, ["text_md5", "doc_id"], ["doc_id", "size", "text_crc32", "text_md5"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve", *classes, "text_md5",
    )


#: Weights of the sources in turn.
MIX_WEIGHTS = [5, 2, 1]


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by systematic sampling to 150 % of all words."""
    out = mixing.mix(common.table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' SimHash of 4-word shingles and their components at 4 bits or fewer."""
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), words=4, errors=4)


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' rule measurements, failure bits and the current policy's verdict."""
    entries = quality.ledger(common.table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.BASE.kept(F.col("failed"))).alias("base_failed"), quality.CURRENT.kept(F.col("failed")).alias("kept"), "failed",
    )


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised, cut and packed into sequences of 1024 ids."""
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, 2)


#: Verdict, host and path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlfilter.judge(common.table(spark, sf_dir, "pages"), rules)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to flat files in order of doc_id and read back from them."""
    folder = common.new_folder(spark, "tokens")
    manifest = tokenfiles.write(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder)
    return tokenfiles.read(manifest)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to whole-file gzip archives, normalised, and read back by offset."""
    folder = common.new_folder(spark, "warc")
    manifest = warc.archive_pages(common.table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' log10 probability under context-tree weighting, and the unigram base."""
    return ctw.score_documents(common.table(spark, sf_dir, "documents"))


AUDIO = audio.Config()


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' bytes as a stored media column, read back, and their tensors' files, read back, with digests of both."""
    folder = common.new_folder(spark, "media")
    audio.store(common.table(spark, sf_dir, "documents"), AUDIO.rate).write.option("compression", "zstd").parquet(folder)
    return audio.digests(spark.read.parquet(folder), common.new_folder(spark, "tensors"), AUDIO)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (
    op1_hilbert_shards, op2_simhash_trie, op3_warc_normaliser, op4_systematic_mix, op5_context_tree, op6_rule_ledger,
    op7_audio_features, op8_best_fit, op9_url_trie, op10_token_files, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.sql()
