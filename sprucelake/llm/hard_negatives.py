"""Hard negatives by k-means inverted lists, visited in the order of their Cauchy-Schwarz bounds.

Method. Vectors of whole numbers stand on the list of their nearest centroid (itself of whole numbers), with which the
largest distance of a member is stored as the list's radius. By Cauchy-Schwarz no member of a list scores more against an
anchor q than q.c + |q| r, and none less than q.c - |q| r. An anchor has slots: one for its positives (any score), then one
for each positive, with that positive's window of scores. Lists are visited from the highest upper bound down; one
that lies outside all of an anchor's windows is skipped, and a slot is done when the bound falls strictly below
its k-th best score so far (at the same score a smaller id may still come). The search is exact.

Distribution. Anchors visit lists in rounds, FIRST lists in the first and WIDER times as many in each further one; after a
round the best of each slot are merged (k rows for each slot leave a chunk, and Spark cuts them again before the shuffle), and the k-th scores go into
the next. Lists are cut into chunks and their callers into blocks (operators/inverted.py), so a list with a third of all
rows is spread over tasks. Centroids, radii and sizes (at most 4096 lists) are all that the driver and each task hold.

Vectors without structure have lists that reach everywhere: then all lists are visited, and the work is one product of
each block of anchors with each chunk.

Defined results: rows with a null id or label, a null vector or any null or non-finite component take no part; of rows
that share an id the one with the least (label, vector) does; shorter vectors count as padded with zeros; scaled components are held within
+-LARGEST. An anchor without another row of its label, and a positive without a negative in its window, give no row.
Of an empty table nothing comes. Columns besides id, vector and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import discard, quoted, written
from sprucelake.operators.groups import top_per_group
from sprucelake.operators.inverted import Lists, best_columns, build, matrix, visits

#: Lists that an anchor visits in the first round, and how many times as many in each further round.
FIRST, WIDER = 8, 8
#: Scores of vectors of 64 components within +-LARGEST fit a long.
LARGEST = 2**28
NONE = -(2**62)
CALLS = "list int, query long, label int, v binary, more struct<slots: array<int>, lows: array<long>, highs: array<long>>"
FOUND = "anchor long, slot int, other long, score long"


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, held within +-LARGEST."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-2.0**40)), F.lit(2.0**40))), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as int64: by floating point where these are exact."""
    bound = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (v.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    if bound < 2**52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _best(scores: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k best scores among those that are ok, ties by place; -1 where there are fewer."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 2**61 // max(n, 1):
        keys = np.where(ok, scores * n + np.arange(n - 1, -1, -1), NONE)
        at = best_columns(keys, k)
        return np.where(np.take_along_axis(keys, at, axis=1) > NONE, at, -1)
    out = np.full((len(scores), min(k, n)), -1)
    for i in range(len(scores)):
        own = np.flatnonzero(ok[i])
        own = own[np.argsort(-scores[i, own], kind="stable")][:k]
        out[i, : len(own)] = own
    return out


def _score(same: bool, k: int):
    """The k best members for each slot of each anchor; same: of its own label, else of other labels."""

    def work(anchors, labels, q, more, ids, member_labels, v) -> Iterator[pa.RecordBatch]:
        scores = _products(q, v)
        fit = ((labels[:, None] == member_labels) == same) & (anchors[:, None] != ids)
        sizes = np.array([len(m["slots"]) for m in more])
        starts = np.cumsum(sizes) - sizes
        slots, lows, highs = (np.array([x for m in more for x in m[name]], np.int64) for name in ("slots", "lows", "highs"))
        for i in range(sizes.max(initial=0)):
            rows = np.flatnonzero(sizes > i)
            s, at = scores[rows], starts[rows] + i
            best = _best(s, fit[rows] & (s >= lows[at][:, None]) & (s <= highs[at][:, None]), k)
            row, col = np.nonzero(best >= 0)
            place = best[row, col]
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(anchors[rows][row]), pa.array(slots[at][row].astype(np.int32)), pa.array(ids[place]), pa.array(s[row, place])], ["anchor", "slot", "other", "score"])

    return work


def _plan(index: Lists, start: int, stop: int):
    """Anchors (query, label, v, more) -> their calls to the lists at places start to stop in the order of their upper bounds."""
    shared, dtype, size = index.members.sparkSession.sparkContext.broadcast((index.centroids, index.radii)), index.dtype, index.width

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radii = shared.value
        for batch in batches:
            q = matrix(batch.column("v"), dtype, size).astype(np.float64)
            near = q @ centroids.T
            reach = np.sqrt((q * q).sum(axis=1))[:, None] * radii
            slack = 1 + 1e-9 * (np.abs(near) + reach)  # what rounding may have taken off
            high, low = near + reach + slack, near - reach - slack
            lists = np.argsort(-high, axis=1, kind="stable")[:, start:stop]
            high, low = np.take_along_axis(high, lists, axis=1), np.take_along_axis(low, lists, axis=1)
            needed = np.zeros(lists.shape, bool)
            for i, m in enumerate(batch.column("more").to_pylist()):
                for a, b in zip(m["lows"], m["highs"], strict=True):
                    needed[i] |= (high[i] >= a) & (low[i] <= b)
            row, col = np.nonzero(needed)
            for a in range(0, len(row), 2000):
                at = pa.array(row[a : a + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, col][a : a + 2000].astype(np.int32)), *[batch.column(c).take(at) for c in ("query", "label", "v", "more")]], ["list", "query", "label", "v", "more"])

    return work


def search(index: Lists, anchors: DataFrame, count: int, same: bool, k: int) -> DataFrame:
    """(anchor, slot, other, score, rank): the k best of each slot of the anchors (query, label, v, slot, low, high), `count` anchors in all."""
    best: DataFrame | None = None
    start, width = 0, FIRST
    while start < len(index.centroids):
        # A slot's window is cut from below at its k-th score so far.
        slots = anchors
        if best is not None:
            last = best.where(F.col("rank") == k).select(F.col("anchor").alias("query"), "slot", F.col("score").alias("kth"))
            slots = anchors.join(last, ["query", "slot"], "left").withColumn("low", F.greatest("low", "kth"))  # greatest skips nulls
        packed = slots.where("low <= high").groupBy("query").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("slot", "low", "high"))).alias("m"))
        packed = packed.select("query", "label", "v", F.struct(F.col("m.slot").alias("slots"), F.col("m.low").alias("lows"), F.col("m.high").alias("highs")).alias("more"))
        found = visits(index, packed.mapInArrow(_plan(index, start, start + width), CALLS), count, _score(same, k), FOUND, "found")
        both = found if best is None else found.unionByName(best.drop("rank"))
        merged = written(top_per_group(both, ["anchor", "slot"], [F.desc("score"), F.col("other")], k), "best")
        discard(found, *([best] if best is not None else []))
        best, start, width = merged, start + width, width * WIDER
    return best


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` (a condition on `id`) picks.

    A positive is one of the `positives` rows of the anchor's label that score highest; its negatives are
    the best `negatives` rows of other labels that score from low to high per cent of it. Ties go to smaller ids.
    """
    vector = quoted(vec_col)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = rows.select(quoted(id_col).cast("long").alias("id"), quoted(label_col).cast("int").alias("label"), F.when(usable, whole_numbers(vector, scale)).alias("v")).dropna()
    rows = written(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "vectors")
    index = build(rows, "<i4")
    own = written(index.members.where(anchor).select(F.col("id").alias("query"), "label", "v"), "anchors")
    count = own.count()
    limit = F.lit(2**62)
    any_score = own.withColumns({"slot": F.lit(0), "low": -limit, "high": limit})
    found = search(index, any_score, count, True, positives).select(F.col("anchor").alias("query"), F.col("rank").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    # 100 s >= low p and 100 s <= high p in whole numbers (a negative p has none where low < high).
    p = F.col("positive_score").cast("decimal(20,0)")
    windows = found.withColumns({"low": F.ceil(p * low / 100).cast("long"), "high": F.floor(p * high / 100).cast("long")}).where("low <= high")
    wanted = own.join(windows, "query")
    best = search(index, wanted.select("query", "label", "v", "slot", "low", "high"), count, False, negatives)
    out = best.join(found.withColumnRenamed("query", "anchor"), ["anchor", "slot"])
    discard(rows, own)
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The job's contract: labels of ids divisible by 7 are one higher, modulo 10.
def relabelled(id_col: str = "vec_id", label_col: str = "label") -> Column:
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)).cast("int")


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3"""
