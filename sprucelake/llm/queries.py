"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprucelake.llm.alignment import token_links
from sprucelake.llm.decontaminate import overlaps
from sprucelake.llm.exact_dedup import EXACT_SQL, exact_groups
from sprucelake.llm.hard_negatives import NEGATIVES_SQL, hard_negatives, relabelled
from sprucelake.llm.html_text import HTML_SQL, main_texts
from sprucelake.llm.minhash import near_groups
from sprucelake.llm.pieces import encoded
from sprucelake.llm.repeats import without_repeats
from sprucelake.llm.sharding import sharding_sql, shards_by_key
from sprucelake.llm.simhash import simhash_groups
from sprucelake.llm.token_counts import token_counts
from sprucelake.llm.toxicity import toxicity_scores
from sprucelake.llm.warc import WARC_SQL, archived
from sprucelake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


MODEL = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).drop("url")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the ids of its best segmentation, the four best by score, size, digest and changes to the best, and whether decoding gives the text back."""
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), n=4)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_key(table(spark, sf_dir, "documents"), shards=40)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a passage."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", relabelled()), F.col("id") % 50 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(MODEL))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES |= {q.__name__: q for q in (op1_toxicity, op2_token_counts, op3_warc, op4_sentencepiece, op5_suffix_dedup, op6_exact_dedup, op7_sharding, op8_minhash, op9_decontamination, op10_html_text, op11_hard_negatives, op12_alignment, op13_simhash)}
ORACLE["op6_exact_dedup"] = EXACT_SQL
ORACLE["op3_warc"] = WARC_SQL
ORACLE["op7_sharding"] = sharding_sql(40)
ORACLE["op10_html_text"] = HTML_SQL
ORACLE["op11_hard_negatives"] = NEGATIVES_SQL
