"""From raw documents to sampled training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns the columns of ``docs``; the last one adds the sampled pieces.  Rows go for one
reason a stage: toxic text, poor text, a near-duplicate with a smaller id, no room in the
budget of their leaf.

All stages take nulls in any column and texts of any length, whole; give an empty table for an
empty one; carry all columns of ``docs``, whatever their names; and treat equal rows alike,
but for the choice of one of each group.  ``docs`` needs doc_id, text, lang and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import stored, table
from marlstone.llm.mixing import mixed_rows
from marlstone.llm.near_dedup import one_of_each
from marlstone.llm.quality import without_junk
from marlstone.llm.segmentation import sample_pieces
from marlstone.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5.

    It is learnt from ``labels`` of documents still here, outside the held-out fold; with no
    labels all stay.  Null and empty texts have the score of a text without known terms.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.3 or more.

    It is learnt from the good ones of ``labels`` and from documents without a label; with no
    good ones all stay.  Null and empty texts are scored by the features that say so.
    """
    return without_junk(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates.

    Null and empty texts, and rows with a null doc_id, are like nothing and stay.  Of rows that
    share a doc_id one stays, that of the least text (then by a hash of all columns).
    """
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the words, shared out by domain, language and source; no row more than once.

    Null languages and sources are leaves of their own.  Texts without words cost nothing: they
    stay where the leaf's prefix reaches over them.  Ties in the seeded order go by a hash of the text.
    """
    return mixed_rows(docs, budget_share=0.8, max_epochs=1)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document, seeded by its doc_id: pieces, n_pieces and lossless are added.

    Null and empty texts have no pieces; a null doc_id is a seed like others.  Columns with
    those three names give way.
    """
    return sample_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("segmentation", segment),
]

#: Learnt models and sampled segmentations have no SQL; the tests hold the stages against planted
#: cases, and each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
