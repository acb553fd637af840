"""Nearest neighbours over arrays of floats."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprucelake.operators.groups import numbered, top_per_group
from sprucelake.operators.inverted import Lists, best_columns, build, matrix, one_list, visits
from sprucelake.session import shared_folder, written

#: Lists of an index, times the root of its rows.
LISTS = 4
#: Queries by which the number of lists to visit is chosen, and the recall that is aimed at.
CALIBRATION, AIM = 200, 0.95


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", most_queries: int = 10_000) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest of each query among all vectors, exact.

    The query set is a stated one and is counted before it is broadcast; vectors are read once.
    For sets of any size there is nearest_in_blocks.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"at most {most_queries} queries at a time: split them in blocks")
    norm = F.sqrt(dot(F.col(vec_col), F.col(vec_col)))  # once for each vector, below the join
    q = F.broadcast(queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("_q"), norm.alias("_q_norm")))
    scored = vectors.select(id_col, vec_col, norm.alias("_norm")).join(q, F.col(id_col) != F.col("query_id"))
    scored = scored.select("query_id", id_col, (dot(F.col(vec_col), F.col("_q")) / (F.col("_norm") * F.col("_q_norm"))).alias("cosine"))
    return top_per_group(scored, ["query_id"], [F.col("cosine").desc(), F.col(id_col)], k)


def nearest_in_blocks(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 10_000) -> DataFrame:
    """nearest() for a query set of any size: `block` queries at a time, each block's k nearest appended to a shared folder."""
    own = numbered(queries.select(id_col, vec_col), "_number")
    blocks = (own.agg(F.max("_number")).first()[0] or 0) // block + 1
    path = shared_folder(queries.sparkSession, "nearest")
    for b in range(blocks):
        found = nearest(own.where(F.col("_number").between(b * block, (b + 1) * block - 1)).drop("_number"), vectors, k, id_col, vec_col, block)
        found.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(found.schema).parquet(path)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, label, v) of length 1, as a written table. Vectors that are null, of length 0, or have a component that is null or not finite have no direction and are left out."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("label"), F.when(whole, v.cast("array<double>")).alias("v")).where("id is not null and v is not null")
    own = own.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0")
    return written(own.select("id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("v")), "units")


def _cosines(k: int):
    """The k members nearest to each query, other than itself."""

    def work(queries, labels, q, more, ids, member_labels, v) -> Iterator[pa.RecordBatch]:
        scores = np.where(queries[:, None] != ids, q @ v.T, -np.inf)
        at = best_columns(scores, k)
        best = np.take_along_axis(scores, at, axis=1)
        # Members that tie with the last of the best come too: the smaller id counts.
        row, col = np.nonzero((scores >= best[:, -1:]) & (scores > -np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(ids[col]), pa.array(scores[row, col])], ["query_id", "id", "cosine"])

    return work


def _visited(index: Lists, calls: DataFrame, count: int, k: int, id_col: str) -> DataFrame:
    found = visits(index, calls, count, _cosines(k), "query_id long, id long, cosine double", "near").withColumnRenamed("id", id_col)
    return top_per_group(found, ["query_id"], [F.col("cosine").desc(), F.col(id_col)], k)


def nearest_by_products(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """nearest() for query sets of any size, by products of blocks of queries with blocks of vectors; ids are unique."""
    index = one_list(unit_vectors(vectors, id_col, vec_col), "<f8")
    asked = written(index.members.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").select("list", F.col("id").alias("query"), "label", "v", F.lit(0).alias("more")), "queries")
    return _visited(index, asked, asked.count(), k, id_col)


def vector_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None) -> Lists:
    """Inverted lists over all vectors' directions, their centroids fitted on a bounded sample (operators/inverted.py)."""
    units = unit_vectors(vectors, id_col, vec_col)
    return build(units, "<f8", lists or math.ceil(LISTS * math.sqrt(max(1, units.count()))))


def _nearest_lists(index: Lists, probes: int, places: bool = False):
    """Queries (query, label, v, more) -> their calls to the `probes` lists of nearest centroid.

    With places, `more` is the list of a vector that was sought, and what comes is at which place the query visits it.
    """
    shared, dtype, width = index.members.sparkSession.sparkContext.broadcast(index.centroids), index.dtype, index.width

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            q = matrix(batch.column("v"), dtype, width)
            order = np.argsort((centroids * centroids).sum(axis=1) / 2 - q @ centroids.T, axis=1, kind="stable")
            if places:
                at = np.argmax(order == batch.column("more").to_numpy()[:, None], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], ["place"])
                continue
            row = np.repeat(np.arange(len(q)), min(probes, len(centroids)))
            for a in range(0, len(row), 2000):
                at = pa.array(row[a : a + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(order[:, :probes].ravel()[a : a + 2000].astype(np.int32)), *[batch.column(c).take(at) for c in ("query", "label", "v", "more")]], ["list", "query", "label", "v", "more"])

    return work


def calibrated(index: Lists, k: int, aim: float = AIM, queries: int = CALIBRATION) -> int:
    """The lists to visit for a recall of `aim`, by the exact neighbours of at most about `queries` of the vectors among all of them."""
    n = int(index.rows.sum())
    share = min(1.0, queries / max(1, n))
    chosen = index.members.where(F.xxhash64("id", F.lit("calibration")) <= F.lit(int((share - 0.5) * (2**64 - 1024)))) if share < 1 else index.members
    asked = written(chosen.select(F.col("id").alias("query"), "label", "v", F.lit(0).alias("more")), "calibration")
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))).alias("list"), "query", "label", "v", "more")
    found = _visited(index, everywhere, queries, k, "id")
    held = found.join(index.members.select("id", "list"), "id").select(F.col("query_id").alias("query"), F.col("list").alias("held"))
    sought = asked.drop("more").join(held, "query").select("query", "label", "v", F.col("held").alias("more"))
    places = np.sort([r["place"] for r in sought.mapInArrow(_nearest_lists(index, 0, places=True), "place int").collect()])  # k for each of the queries
    return int(places[min(len(places) - 1, math.ceil(aim * len(places)))]) + 1 if len(places) else 1


def approximate_nearest(index: Lists, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest of each query (ids of the index) among the lists of its `probes` nearest centroids.

    Without probes their number is calibrated. Every row of the index is on a list and can be found.
    """
    probes = probes or calibrated(index, k)
    asked = index.members.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query"), "label", "v", F.lit(0).alias("more"))
    asked = written(asked, "queries")
    calls = asked.mapInArrow(_nearest_lists(index, probes), "list int, query long, label int, v binary, more int")
    return _visited(index, calls, asked.count(), k, id_col)
