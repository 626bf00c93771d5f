"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bilinear, codes, fingerprint, licenses, lines, mixing, neighbours, ngram_join, pieces, quality, radix, spellings, suffixes
from .common import fold_of, table, texts
from .oracles import ORACLES  # noqa: F401


def piece_model() -> str:
    """Path of the public 32k piece vocabulary."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, lines deleted as aligned with an earlier document, and a digest of what is left."""
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_count", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeat from earlier documents in strings of 50, and a digest of the rest."""
    out = suffixes.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, class and component of near copies of every document."""
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score per document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows by cosine of every row whose id is divisible by 50."""
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, unigram score and model score of every document."""
    return bilinear.score(table(spark, sf_dir, "documents"))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn row: its source, pass, block, the block's place in the pass, and tokens."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to it."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load(spark, piece_model()))


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out fold, score and decision per document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(texts(docs), model)
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_kept").cast("int").alias("predicted"))


def op11_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, and the row that stays, of every document."""
    return radix.groups(table(spark, sf_dir, "documents"))


def op12_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, the error of its label, and a digest of the codebooks."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the corpus."""
    return spellings.variants(spellings.words(table(spark, sf_dir, "documents")))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6."""
    return bilinear.score(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op9."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_suffix_dedup, op3_ngram_jaccard, op4_license_scan, op5_multi_index_hashing, op6_log_bilinear, op7_temperature_mixing, op8_sentencepiece, op9_syncmer_fingerprints, op10_quality_ranking, op11_radix_dedup, op12_dual_tree_codes, op13_spelling_variants, license_base, token_counts, edited_texts)}
