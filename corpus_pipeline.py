"""A corpus pipeline of five of the training-data operators, each stage over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import language, mixing
from gridloom.llm.common import Scratch, table
from gridloom.llm.line_dedup import without_recurring
from gridloom.llm.ngram_join import near_duplicates_removed
from gridloom.llm.packing import pack, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without letters and those that the model calls a toss-up go; lang becomes the prediction.

    Each row is judged by itself: a null id, repeated rows and very long texts change nothing; null and empty texts go. Where no
    language can be learned all go.
    """
    found = language.with_language(docs.select(*COLUMNS), language.fit(docs, folds=None)).where("lang_pred != 'und' and score >= 0.4")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier documents have; those that lose all their lines go.

    Rows with a null id stay as they are, and so do texts without such lines, empty and null ones included. Rows that repeat an id count as one document.
    """
    out = without_recurring(docs, Scratch(spark, "pipeline-lines"))
    return out.where("n_dropped = 0 or length(trim(text)) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id: five-word shingles, a similarity of 0.8 or more.

    Texts without words and rows with a null id all stay; of rows that repeat an id all stay or none.
    """
    return near_duplicates_removed(docs, Scratch(spark, "pipeline-near"), size=5, percent=80).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: a document stands as often as the mix takes it.

    A null source is the last of the sources; null ids and repeated rows are documents as any other, texts without words come along with their place.
    """
    return mixing.shards_of(mixing.mix(docs, Scratch(spark, "pipeline-mix")), docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece of a document, with its place. A text without tokens is its end alone."""
    return pack(docs, Scratch(spark, "pipeline-pack"), vocabulary(), capacity=4096, end_id=1)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("mixing", mixed), ("best_fit_packing", packed)]
#: Trained models, shingle sets and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is removed once its own rows are written."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    return docs
