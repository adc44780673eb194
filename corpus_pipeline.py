"""The corpus pipeline: stages that each apply one operator to all documents that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Results
are written to the shared folder between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import stored, table
from batchloom.llm.minhash import one_of_each_group
from batchloom.llm.mixing import mixed_copies
from batchloom.llm.secret_scan import redact_secrets
from batchloom.llm.segment import segment
from batchloom.llm.toxicity import train, without_toxic


#: Similarity from which two documents are near duplicates, in percent.
NEAR = 80
#: Bytes of texts in a block of the last stage, small since workers of the stages before it still hold memory.
BLOCK = 1 << 19


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones, does not reject.

    Null and empty texts have no words and stay; long texts are judged by all their words; rows that repeat an id are judged
    each by its own text; an empty table, or labels of one kind only, reject nothing; further columns pass, whatever their names.
    """
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by five-word shingles from ``NEAR`` percent on.

    Null, empty and blank texts link with nothing and stay, as do rows with a null id; of rows that repeat id and text one
    stays, and rows that share an id but not their text are judged each by its own; an empty table stays empty.
    """
    return one_of_each_group(docs, NEAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; ``n_chars`` follows the text.

    A null text stays null with its ``n_chars``; texts of any length are scanned whole; repeated rows stay repeated; an empty
    table stays empty; further columns pass, whatever their names.
    """
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words are not taken; a null source is a source; texts of any length count whole, so a very long one may be
    all that a source misses its target by; ties in the key are broken by id and size, and rows that repeat the last one taken
    are taken with it; an empty table stays empty; further columns pass, whatever their names.
    """
    return mixed_copies(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, of copies by their number: ``doc_id, copy, n_pieces, ids, lossless``.

    Null and empty texts have no pieces; texts of any length are encoded whole; rows that repeat id and text are its copies,
    numbered from 0 wherever they lie; an empty table gives an empty result; further columns are ignored.
    """
    return segment(docs, copies=True, block=BLOCK)


STAGES = [
    ("toxicity", toxicity),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]
#: SQL expresses neither the chain nor the sketches; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
