"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. Words, pairs of neighbours and pairs with one word between are hashed to 2**BITS
coordinates; a text has each coordinate once, however often it occurs, so a long text is not
diluted. FTRL-proximal gives each coordinate a rate of its own and, by its L1 term, keeps few
weights; these are broadcast as two short arrays (2**BITS numbers at most).

Fitting takes at most SAMPLE labelled rows, chosen by a hash of their id, as sets of coordinates
in one task, which goes over them EPOCHS times. Rows of ids that are held out never reach it. Scoring reads every whole text once, without a shuffle.

Defined results: null and empty texts have the score of no words (the intercept); repeated rows
score alike; labels that are null, or whose id is null or in no document, are left out, and of
several labels of an id the largest counts, and of its several texts one is fitted (the first by its
coordinates, whatever the order of the rows); without any label every score is the intercept 0.5.
Columns other than id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import WordHashes, few_rows_a_batch, give_back, mix, small_batches, tidy
from sprucelake.llm.decontaminate import plain_words

BITS = 20
#: At most so many labelled rows are fitted, each so often.
SAMPLE, EPOCHS = 12_000, 4
#: FTRL: learning rate, its smoothing, L1 and L2; what a row of label 1 weighs.
ALPHA, BETA, L1, L2, POSITIVE = 1.0, 1.0, 12.0, 0.5, 4.0
SKIP, PAIR = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def coordinates(h: np.ndarray) -> np.ndarray:
    """Coordinates of a text's word hashes, repeats included."""
    grams = np.concatenate([mix(h), mix(h[:-1] * PAIR + h[1:]), mix(h[:-2] * SKIP + h[2:])])
    return (grams >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, intercept) fitted to (distinct coordinates, label)."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weight(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in rows:
            w = weight(at)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + w.sum())))) - label
            g *= POSITIVE if label else 1.0
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
            bias_n += g * g
            bias -= g * ALPHA / (BETA + math.sqrt(bias_n))
    return weight(slice(None)), bias


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, intercept) from the labelled rows of docs (doc_id, text) that are not held out."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, 0.95 * sample / max(1, ids.count()))  # 5 % below, so that chance does not take it beyond
    order = F.xxhash64("doc_id", F.lit("fit"))
    ids = ids.where(order <= F.lit(int((share - 0.5) * (2**64 - 1024)))) if share < 1 else ids
    ids = F.broadcast(ids)  # at most `sample` rows of two numbers

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in small_batches(batches, "text"):
            at = [np.unique(coordinates(memo.of(plain_words(t)))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a.tobytes() for a in at], pa.binary())], ["doc_id", "label", "at"])

    def sequence(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id"])
        weights, bias = ftrl([(np.frombuffer(a, np.int32), y) for a, y in zip(pdf["at"], pdf["label"], strict=True)])
        at = np.flatnonzero(weights)
        return pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "w": [weights[at].tobytes()], "bias": [bias]})

    rows = docs.join(ids, "doc_id").select("doc_id", "text", "label").mapInArrow(tidy(features), "doc_id long, label int, at binary")
    rows = rows.groupBy("doc_id", "label").agg(F.min("at").alias("at"))  # however many texts an id has, a task sends one on
    fitted = rows.withColumn("turn", F.xxhash64("doc_id", F.lit("turn"))).groupBy(F.lit(0).alias("all")).applyInPandas(sequence, "at binary, w binary, bias double").collect()
    if not fitted:
        return np.empty(0, np.int64), np.empty(0), 0.0
    return np.frombuffer(fitted[0]["at"], np.int32), np.frombuffer(fitted[0]["w"]), fitted[0]["bias"]


def scorer(model: Broadcast):
    """A column function text -> score by a broadcast (coordinates, weights, intercept)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = WordHashes()
        at, w, bias = model.value
        table = np.zeros(1 << BITS)
        table[at] = w
        used = table != 0
        for texts in batches:
            scores = []
            for t in texts:
                c = coordinates(memo.of(plain_words(t)))
                x = bias + table[np.unique(c[used[c]])].sum()
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
            yield pd.Series(scores, dtype="float64")
        memo.clear()
        give_back()

    return score


def fitted_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The score of docs' text column, by a model fitted to labels (doc_id, toxic)."""
    spark = docs.sparkSession
    few_rows_a_batch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scorer(spark.sparkContext.broadcast(fit(rows, labels)))(F.col(text_col))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    scored = docs.select(F.col(id_col).alias("doc_id"), fitted_score(docs, labels, id_col, text_col).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
