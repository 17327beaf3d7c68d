"""From raw documents to packed training sequences: judged, without repeats, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.cuts import replaced
from lexloom.llm.line_runs import line_deduplicated
from lexloom.llm.minmax import near_duplicates
from lexloom.llm.mixing import mixed_documents
from lexloom.llm.packing import pack
from lexloom.llm.quality import accepted, fit_quality
from lexloom.session import work_path
from lexloom.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers accept; rejected ones go.

    Null and empty texts, repeated rows and rows without an id are judged like any other and stay as they are, columns of
    any name included. Scores at the limit are accepted. Without labels of both kinds all stay.
    """
    return accepted(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


#: Words whose ids a worker keeps in packing. Executors still hold the memory of the stages before, so these are fewer than op1's.
KNOWN_WORDS = 200_000
#: Documents link from this share of common shingles on; op3's own limit is that of its query.
NEAR_PERCENT = 80


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one of which nothing is left goes. n_chars follows the text.

    Null and empty texts stay. Rows alike in id and text lose the same lines; of several documents the smallest id keeps a
    run, rows without an id first, then that of the least hash of its text. Other columns stay, whatever their names.
    """
    return replaced(line_deduplicated(docs), docs, "text", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Rows that share an id stay or go together.

    Null and empty texts are like nothing and stay, as do rows without an id. Other columns stay, whatever their names.
    """
    gone = near_duplicates(docs, percent=NEAR_PERCENT).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it.

    A null source is a source. Null and empty texts have no words and take no part of a target; ties of size go by the ids'
    hashes. Other columns stay, whatever their names.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequences and places.

    A null or empty text is the end id alone, repeated rows are packed each for itself, and no rows give no pieces.
    """
    return pack(docs, known_words=KNOWN_WORDS)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]

#: Tokens and a trained classifier are beyond SQL; a test compares the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returns is stored in the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), work_path(spark, name.replace(" ", "_"))
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
