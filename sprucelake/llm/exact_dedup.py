"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Method. Rows that share id and text are combined before anything is dealt, with their number, and rows are dealt to blocks
by a hash of both, so neither many rows without id nor many of one id fill a block. Each block sorts the distinct
48-bit fingerprints of its texts and sends every owner (a range of fingerprints) its part,
Golomb-coded as gaps. An owner merges what it gets and answers each block with a bitmap that
marks the fingerprints which another block has too. Rows whose fingerprint is marked, or occurs
more than once in their own block, are suspects. Only suspects' texts are shuffled, grouped by
fingerprint and all their bytes, with counts combined before the shuffle. A fingerprint is never
trusted: it only decides what is looked at.

A block sends a fingerprint once however many copies it has, so a text that holds a third of all
rows costs an owner one number from each block.

Defined results: null is as empty; texts are equal when identical after lower-casing A-Z only;
of equal texts the largest id stays, and of rows that repeat that id too, one; a null id is below
all others. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import discard, join_groups, small, written

FINGERPRINT_BITS = 48
#: Documents in a block, and the fingerprints that an owner gets, on average; every block writes to
#: every owner, so beyond MOST_BLOCKS blocks grow instead of getting more.
BLOCK_ROWS, MOST_BLOCKS = 50_000, 10_000
#: Copies of one row that a task makes at most.
COPIES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def golomb_encode(values: np.ndarray, span: int) -> tuple[bytes, int]:
    """(code, parameter bits) of sorted distinct values in [0, span): gaps, low bits plain and high bits unary."""
    n = len(values)
    low = max(0, int(math.log2(max(1.0, span / max(n, 1) * math.log(2)))))
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    high = gaps >> low
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    plain = ((gaps[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, plain])).tobytes(), low


def golomb_decode(code: bytes, n: int, low: int) -> np.ndarray:
    """The n values that golomb_encode was given."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    high = np.diff(ends, prepend=-1) - 1
    first = int(ends[-1]) + 1 if n else 0
    plain = bits[first : first + n * low].reshape(n, low)
    gaps = high.astype(np.int64) << low
    for i in range(low):
        gaps += plain[:, i].astype(np.int64) << i
    return np.cumsum(gaps + 1) - 1


def _own(prints: np.ndarray, owners: int) -> np.ndarray:
    return prints * owners >> FINGERPRINT_BITS


def _send(owners: int):
    """A block's fingerprints -> one coded list for each owner."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(pdf["print"].to_numpy())
        own = _own(prints, owners)
        out = []
        for part in np.split(prints, np.flatnonzero(np.diff(own)) + 1):
            owner = int(_own(part[:1], owners)[0])
            base = -(-(owner << FINGERPRINT_BITS) // owners)
            code, low = golomb_encode(part - base, (1 << FINGERPRINT_BITS) // owners + 1)
            out.append((int(pdf["block"].iloc[0]), owner, base, len(part), low, code))
        return pd.DataFrame(out, columns=["block", "owner", "base", "n", "low", "code"])

    return work


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's lists -> for each block a bitmap over its list: which values other blocks sent too."""
    lists = [golomb_decode(c, n, low) for c, n, low in zip(pdf["code"], pdf["n"], pdf["low"], strict=True)]
    merged, counts = np.unique(np.concatenate(lists), return_counts=True)
    marks = [np.packbits(counts[np.searchsorted(merged, x)] > 1).tobytes() for x in lists]
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "n": pdf["n"], "bits": marks})


def _suspects(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """A block's rows and the bitmaps it got -> its rows with `suspect`."""
    prints, at, counts = np.unique(rows["print"].to_numpy(), return_inverse=True, return_counts=True)
    marks = marks.sort_values("owner")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(marks["bits"], marks["n"], strict=True)]
    marked = np.concatenate([*bits, np.empty(0, np.uint8)]).astype(bool) | (counts > 1) if len(prints) else counts > 1
    out = rows[["doc_id", "sha", "rows"]].copy()
    out["suspect"] = marked[at] | (rows["rows"].to_numpy() > 1)
    return out


def _copies(rows: DataFrame) -> DataFrame:
    """Each of rows as often as its column `rows` says, numbered by `copy`; what is very often there is written by several tasks."""
    first, last = F.lit(0).cast("long"), F.col("rows") - 1
    if not rows.where(F.col("rows") > COPIES).limit(1).count():
        return rows.withColumn("copy", F.explode(F.sequence(first, last)))
    lots = rows.withColumn("lot", F.explode(F.sequence(first, F.floor(last / COPIES)))).repartition("doc_id", "sha", "lot")
    return lots.withColumn("copy", F.explode(F.sequence(F.col("lot") * COPIES, F.least(last, (F.col("lot") + 1) * COPIES - 1)))).drop("lot")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs."""
    text = normalised(F.col(text_col))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    n = docs.count()
    blocks = max(1, min(MOST_BLOCKS, math.ceil(n / BLOCK_ROWS)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prints = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 64 - FINGERPRINT_BITS).alias("print"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = prints.groupBy("doc_id", "print", "sha").agg(F.count("*").alias("rows"))
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(blocks)).cast("int")), "prints")
    coded = rows.select("block", "print").groupBy("block").applyInPandas(_send(blocks), "block int, owner int, base long, n long, low int, code binary")
    marks = coded.groupBy("owner").applyInPandas(_answer, "block int, owner int, n long, bits binary")
    seen = written(rows.groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(_suspects, "doc_id long, sha binary, rows long, suspect boolean"), "suspects")
    discard(rows)

    # Suspects' whole texts meet; equal bytes make a group.
    ids = written(seen.where("suspect").select(F.col("doc_id").alias("id")).distinct(), "suspect-ids")
    texts = docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    groups = texts.groupBy(F.xxhash64("text").alias("print"), "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(groups.where("group_size > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    out = _copies(written(join_groups(seen, groups, ["sha"], "group_size", n, "left").select("doc_id", "sha", "rows", "keep_id", "group_size"), "grouped"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 0)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


EXACT_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""
