"""Inverted lists over vectors: centroids, lists cut into chunks of bounded size, and visits of queries to lists.

Centroids are fitted by k-means in one task, on a sample of at most SAMPLE rows whatever the table's size; every row
is put on the list of its nearest centroid. A list is stored as chunks of about CHUNK rows, so one that holds a third
of the table is many rows of the written table and no task gets it whole. Queries that go to a list are packed in
blocks of about QUERIES, each of which meets each chunk once: one matrix product, whose rows are cut to the few best.

Vectors are the bytes of their components, all of one width, so blocks go through Spark as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprucelake.session import written

#: Rows that centroids are fitted to at most, and the number of centroids at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Rows of a chunk and queries of a block, on average.
CHUNK, QUERIES = 1000, 512
#: Rounds of k-means.
ROUNDS = 8
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most `rows` rows in an Arrow batch, for plans that run inside."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A column of vectors' bytes as a matrix."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def padded(column: pa.ListArray, dtype: str, width: int) -> np.ndarray:
    """A column of lists of numbers as a matrix; shorter lists end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def as_bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of bytes."""
    size = x.dtype.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centroids of the rows of x, rounded to whole numbers if x has whole numbers. A list that runs empty is dropped."""
    whole, x = np.issubdtype(x.dtype, np.integer), x.astype(np.float64)
    centroids = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64))]
    for _ in range(rounds):
        at = nearest_centroid(x, centroids)
        order = np.argsort(at, kind="stable")
        heads = np.flatnonzero(np.diff(at[order], prepend=-1))
        centroids = np.add.reduceat(x[order], heads) / np.diff(np.r_[heads, len(x)])[:, None]
    return np.unique(np.rint(centroids) if whole else centroids, axis=0)


@dataclass
class Lists:
    """What is small of an index (centroids, radii, rows of each list), and its written tables."""

    centroids: np.ndarray
    radii: np.ndarray
    rows: np.ndarray
    dtype: str
    width: int
    #: (list, id, label, v): every row.
    members: DataFrame
    #: (list, chunk, ids, labels, vs)
    chunks: DataFrame

    @property
    def parts(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // CHUNK))


def build(vectors: DataFrame, dtype: str, lists: int | None = None, sample: int = SAMPLE) -> Lists:
    """Inverted lists of vectors (id long, label int, v array of numbers): `lists` of them, or as many as the root of the rows.

    Shorter vectors count as padded with zeros. vectors is read several times: give a written table.
    """
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    k = min(MOST_LISTS, lists or math.ceil(math.sqrt(n)))
    share = min(1.0, 0.95 * sample / max(1, n))  # 5 % below, so that chance does not take it beyond
    order = F.xxhash64("id", F.lit("lists"))
    chosen = vectors.where(order <= F.lit(int((share - 0.5) * (2**64 - 1024)))) if share < 1 else vectors

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        found = k_means(padded(pa.array(pdf["v"], pa.list_(pa.from_numpy_dtype(np.dtype(dtype)))), dtype, width), k)
        return pd.DataFrame({"c": [c.tobytes() for c in found]})

    fitted = chosen.select(F.xxhash64("id", F.lit("turn")).alias("turn"), "v").groupBy(F.lit(0).alias("all")).applyInPandas(fit, "c binary").collect()
    centroids = np.frombuffer(b"".join(r["c"] for r in fitted), np.float64).reshape(-1, width) if fitted else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centroids)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded(batch.column("v"), dtype, width)
            at = nearest_centroid(x.astype(np.float64), shared.value)
            reach = np.sqrt(((x - shared.value[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("id"), batch.column("label"), as_bytes(x), pa.array(reach)], ["list", "id", "label", "v", "reach"])

    members = written(vectors.select("id", "label", "v").mapInArrow(put, "list int, id long, label int, v binary, reach double"), "members")
    radii, rows = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in members.groupBy("list").agg(F.max("reach").alias("reach"), F.count("*").alias("n")).collect():  # a row for each centroid
        radii[r["list"]], rows[r["list"]] = r["reach"], r["n"]
    return packed(Lists(centroids, radii, rows, dtype, width, members.drop("reach"), members))


def one_list(vectors: DataFrame, dtype: str) -> Lists:
    """All vectors (id long, label int, v array of numbers) on a single list, which every query goes to."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 0)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("id"), batch.column("label"), as_bytes(padded(batch.column("v"), dtype, width))], ["list", "id", "label", "v"])

    members = written(vectors.select("id", "label", "v").mapInArrow(put, "list int, id long, label int, v binary"), "members")
    return packed(Lists(np.zeros((1, width)), np.zeros(1), np.array([n]), dtype, width, members, members))


def packed(found: Lists) -> Lists:
    """The lists with their chunks written."""
    spark, members = found.members.sparkSession, found.members
    parts = spark.createDataFrame(list(enumerate(found.parts.tolist())), "list int, parts int")
    chunk = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("chunk")
    rows = members.join(F.broadcast(parts), "list").groupBy("list", chunk).agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
    found.chunks = written(rows.select("list", "chunk", F.col("rows.id").alias("ids"), F.col("rows.label").alias("labels"), F.col("rows.v").alias("vs")), "chunks")
    return found


Score = Callable[[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray, np.ndarray, np.ndarray], Iterable[pa.RecordBatch]]


def visits(index: Lists, calls: DataFrame, queries: int, score: Score, schema: str, purpose: str) -> DataFrame:
    """What `score` makes of each block of queries and each chunk of the list that they go to, as a written table.

    calls: (list, query long, label int, v binary, more) for each visit; more is any column. score gets the
    queries' ids, labels, vectors and `more` (a list), and the members' ids (ascending), labels and vectors.
    `queries` is the number of queries in all: a list's callers are dealt to blocks by it.
    """
    spark, dtype, width = calls.sparkSession, index.dtype, index.width
    blocks = max(1, math.ceil(queries / QUERIES))
    parts = F.broadcast(spark.createDataFrame(list(enumerate(index.parts.tolist())), "list int, parts int"))
    packed = calls.groupBy("list", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query", "label", "v", "more")).alias("q"))
    packed = packed.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "q")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = batch.column("q")[i].values
                ids = batch.column("ids")[i].values.to_numpy()
                by = np.argsort(ids, kind="stable")
                labels = batch.column("labels")[i].values.to_numpy(zero_copy_only=False)
                members = matrix(batch.column("vs")[i].values, dtype, width)
                yield from score(q.field("query").to_numpy(), q.field("label").to_numpy(zero_copy_only=False), matrix(q.field("v"), dtype, width), q.field("more").to_pylist(), ids[by], labels[by], members[by])

    with rows_a_batch(spark, 16):  # a row has a block and a chunk
        return written(packed.join(index.chunks, ["list", "chunk"]).select("q", "ids", "labels", "vs").mapInArrow(work, schema), purpose)


def best_columns(keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row of keys, largest first (all, if fewer)."""
    k = min(k, keys.shape[1])
    at = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, keys.shape[1] - k :]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(keys, at, axis=1), axis=1, kind="stable"), axis=1)
