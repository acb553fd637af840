"""The corpus pipeline: each stage works on all that its predecessor kept, and what it decides holds for the next.

All columns of a row are carried to the end, whatever their names; the last stage adds the struct
`pieces`. A null text counts as empty (of several, exact dedup keeps one). A row without doc_id has a
number of its own for the time of a stage, above all others, so what the stage decides holds for it too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprucelake.llm.common import discard, fresh, small, written
from sprucelake.llm.decontaminate import overlaps
from sprucelake.llm.exact_dedup import exact_groups, normalised
from sprucelake.llm.minhash import near_groups
from sprucelake.llm.pieces import encoded
from sprucelake.llm.toxicity import fitted_score
from sprucelake.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.7
#: Words of the shortest benchmark item whose presence condemns a document; a shorter one (`yes`) is no passage.
LEAST_WORDS = 5
MODEL = "piece_bpe_32k.model"


def numbered(stage: Stage) -> Stage:
    """The stage with a doc_id for each row that has none; such ids are above all others, or below if there is no room."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lost = docs.where("doc_id is null")
        if not lost.limit(1).count():
            return stage(spark, docs, sf_dir)
        low, high = (x or 0 for x in docs.agg(F.min("doc_id"), F.max("doc_id")).first())
        above, kind = high < 2**63 - 2**56, docs.schema["doc_id"].dataType
        own = F.monotonically_increasing_id()
        lost = written(lost.withColumn("doc_id", F.lit(high + 1) + own if above else F.lit(low - 1) - own), "no-id")
        kept = stage(spark, docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(lost), sf_dir)
        return kept.withColumn("doc_id", F.when(F.col("doc_id") <= high if above else F.col("doc_id") >= low, F.col("doc_id")).cast(kind))

    return run


def all_but(docs: DataFrame, ids: DataFrame, purpose: str) -> DataFrame:
    """docs without those whose doc_id is among ids (one column)."""
    gone = fresh(docs.columns, "gone")
    ids = written(ids.toDF(gone), purpose)
    return docs.join(small(ids), F.col("doc_id") == F.col(gone), "left_anti")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC stay. The scorer is fitted to the labelled rows of docs that are not held out."""
    return docs.where(fitted_score(docs, table(spark, sf_dir, "labels")) < TOXIC)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; of rows that repeat that too, one (which of them, where other columns differ, is not fixed)."""
    own, copy_id, copy_sha, copy_kept = (fresh(docs.columns, name) for name in ("own_sha", "copy_id", "copy_sha", "copy_kept"))
    copies = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    copies = written(copies.select(F.col("doc_id").alias(copy_id), F.col("text_sha256").alias(copy_sha), F.col("kept").alias(copy_kept)), "copies")
    marked = docs.withColumn(own, F.sha2(normalised(F.col("text")), 256))
    key = F.col("doc_id").eqNullSafe(F.col(copy_id)) & (F.col(own) == F.col(copy_sha))
    stay = marked.join(small(copies), key, "left_anti")
    # Rows that stay once though they were repeated.
    again = marked.join(small(copies.where(copy_kept)), key, "left_semi").dropDuplicates(["doc_id", own])
    return stay.unionByName(again).drop(own)


@numbered
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at similarity 0.8 or more on five-word shingles the document with the smallest doc_id stays."""
    return all_but(docs, near_groups(docs).where("not kept").select("doc_id"), "near-copies")


@numbered
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item of LEAST_WORDS words or more stay."""
    return all_but(docs, overlaps(docs, table(spark, sf_dir, "benchmark"), least_words=LEAST_WORDS).select("doc_id").distinct(), "leaks")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its best segmentations, ids and all, and whether decoding gives its text back."""
    return encoded(docs, public_tokenizers.path(MODEL), n=4, carry=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("minhash", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", pieces),
]
#: SQL can't express the first, third and fifth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return docs
