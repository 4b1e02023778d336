"""The corpus pipeline: quality, near duplicates, contamination, mixture, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each stage's rows as
Parquet into a shared folder and reads them back for the next. All stages but the last return the columns of documents;
the mixture adds the training position, by which the last stage orders the sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import cotrain, curriculum, postings, simhash, wavelet
from quernstone.llm.common import shared_folder, stored, table
from quernstone.llm.wavelet import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts, fitted on ``labels``.

    Null texts read as empty and null metadata is a value of its own; rows with equal doc_id and text stay or go
    together; without labels of both classes all stay; an empty table stays empty; further columns are kept as they are.
    """
    return cotrain.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: its smallest doc_id (null last), then the smallest digest of the text.

    Null, empty and wordless texts are one group; of repeated rows one stays; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate.

    Null and empty texts have no words and stay; rows of equal text stay or go together; an empty table stays empty and
    an empty benchmark contaminates nothing.
    """
    return postings.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a row for each time that the mix takes a document, its last take cut to the target, with its
    training position.

    Texts without words (null, empty, blank) take nothing and are absent; a null source is a source, the last; repeated
    rows are each taken; an empty table gives an empty sequence.
    """
    return curriculum.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet shards of the sequence's tokens in training order, and what is read back from them.

    Equal positions go by doc_id (null first); without a position column all rows go by doc_id. A null or empty text holds the end id alone; rows with the same doc_id stay apart; an empty table gives no rows.
    """
    order = tuple(c for c in (curriculum.POSITION,) if c in docs.columns)
    return wavelet.token_output(docs, vocabulary(), shared_folder(spark, "wavelet"), order=order)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: No stage but the third can be told in SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
