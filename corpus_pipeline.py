"""A training corpus in five stages: quality, line dedup, near duplicates, source mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
and read again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from routeloom.llm import lines, mixing, ngram_join, pieces, quality
from routeloom.llm.common import table
from routeloom.llm.queries import piece_model
from routeloom.session import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A source may be drawn so often at most: small sources gain a little, none is repeated much.
MAX_REPEATS = 1.25


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars as the text is now."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def quality_ranking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality cut go. The labels are those of the corpus; documents without text have no score to speak of and are judged like any other."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _columns(quality.score(docs.select(*COLUMNS), model).where("quality_kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines aligned with an earlier document go; a document that loses all of its text goes with them."""
    return _columns(lines.dedup(docs.select(*COLUMNS)).where("lines_left"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; of repeated rows one stays, and texts that
    share an id but are no near copies all stay."""
    return _columns(ngram_join.kept_rows(docs.select(*COLUMNS)))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights over as many tokens as there are; a document drawn in two passes has two rows."""
    return _columns(mixing.mix(docs.select(*COLUMNS), max_repeats=MAX_REPEATS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with a flag that they decode to its text."""
    return pieces.encode(docs, pieces.load(spark, piece_model()))


STAGES = [("quality classifier", quality_ranking), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("source mixing", source_mixing), ("SentencePiece encoding", sentencepiece)]

#: Trained scores, alignment and pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
