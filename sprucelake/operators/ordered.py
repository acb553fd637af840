"""Running values, frames and joins along an order, for keys of any size.

A window function keeps a key's rows in one task. Here rows are dealt by ranges of (key, order), so that a key with a
third of all rows lies in many chunks, in order; what a chunk ends with is carried into the key's later chunks. A chunk's
edge cuts at most one key, so the carried table has at most two rows for each chunk, whatever the rows and keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from sprucelake.session import written

#: Rows of a chunk, at most about.
CHUNK_ROWS = 1_000_000
#: A key is hot if more than one of HOT_SHARE rows have it (so hot keys are fewer than HOT_SHARE), and HOT_ROWS at least.
HOT_SHARE, HOT_ROWS = 10_000, 100_000
#: How a running value goes on from the end of the chunk before: (in a chunk, over chunks, both).
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0).cast("long"))),
    "min": (F.min, F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def chunked(df: DataFrame, by: list[str], order: list[Column], rows: int = CHUNK_ROWS) -> DataFrame:
    """df with _chunk, numbered along (by, order), and what settles ties (_tie, _id), as a written table.

    There are as many chunks as shuffle partitions, or more if they would have more than `rows` rows.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))
    tied = df.withColumns({"_tie": F.xxhash64(*df.columns), "_id": F.monotonically_increasing_id()})
    return written(tied.repartitionByRange(parts, *by, *order, "_tie", "_id").withColumn("_chunk", F.spark_partition_id()), "chunks")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def running(df: DataFrame, by: list[str], order: list[Column], values: dict[str, tuple[str, Column]], rows: int = CHUNK_ROWS) -> DataFrame:
    """df with running values from a key's first row to each row: name -> (a kind of KINDS, column). Null keys are one key."""
    chunks = chunked(df, by, order, rows)
    inside = W.partitionBy("_chunk", *by).orderBy(*order, "_tie", "_id").rowsBetween(W.unboundedPreceding, 0)
    own = written(chunks.withColumns({"_at": F.row_number().over(inside)} | {n: KINDS[kind][0](c).over(inside) for n, (kind, c) in values.items()}), "running")
    ends = own.groupBy("_chunk", *by).agg(F.max_by(F.struct(*values), "_at").alias("_end"))
    over = W.partitionBy(*by)
    before = over.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumns({"_chunks": F.count("*").over(over)} | {f"_{n}": KINDS[kind][1](F.col("_end")[n]).over(before) for n, (kind, _) in values.items()})
    carried = carried.where("_chunks > 1").select(F.col("_chunk").alias("_in"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(by)], *[f"_{n}" for n in values])
    same = _all([F.col("_chunk") == F.col("_in"), *[own[k].eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(by)]])
    both = own.join(F.broadcast(carried), same, "left")  # two rows for each chunk at most
    return both.select(*df.columns, *[KINDS[kind][2](F.col(n), F.col(f"_{n}")).alias(n) for n, (kind, _) in values.items()])


def numbered_in_key(df: DataFrame, by: list[str], order: list[Column], name: str = "place", rows: int = CHUNK_ROWS) -> DataFrame:
    """df with each row's place in its key's order, from 0."""
    return running(df, by, order, {name: ("count", F.lit(1))}, rows).withColumn(name, F.col(name) - 1)


def framed(df: DataFrame, by: list[str], order: list[Column], before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], rows: int = CHUNK_ROWS) -> DataFrame:
    """df with columns made over a window of a key's rows, none of which looks farther than `before` rows back and `after` ahead.

    Rows are cut by their place into buckets of at most `rows`; the rows at a bucket's edges go to its neighbours as well.
    """
    size = max(rows, before + after, 1)
    placed = numbered_in_key(df, by, order, "_place", rows)
    bucket, inside = F.floor(F.col("_place") / size).cast("long"), F.col("_place") % size
    copies = F.array(bucket, F.when(inside >= size - before, bucket + 1), F.when((inside < after) & (bucket > 0), bucket - 1))
    each = placed.withColumn("_own", bucket).withColumn("_bucket", F.explode(F.filter(copies, lambda b: b.isNotNull())))
    made = columns(W.partitionBy(*by, "_bucket").orderBy("_place"))
    return each.withColumns(made).where("_own = _bucket").select(*df.columns, *made)


def hot_keys(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys (by) of more than hot_rows rows that more than one of HOT_SHARE rows have: fewer than HOT_SHARE, as a written table."""
    counts = written(df.groupBy(*by).agg(F.count("*").alias("_n")), "keys")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return written(counts.where((F.col("_n") > hot_rows) & (F.col("_n") * HOT_SHARE > total)).select(*by), "hot")


def below(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: dict[str, str] | None = None, strict: bool = True, sums: dict[str, str] | None = None, name: str = "n", rows: int = CHUNK_ROWS) -> DataFrame:
    """Each left row with the number of right rows whose right_on is less than its left_on (or equal, if not strict), and sums of right columns over them.

    An inequality join that is counted instead of made: both sides are sorted together, and the right rows before a left one
    are counted on the way. by: left column -> right column that must be equal. Null values and null keys are less than
    nothing and have nothing below: n is 0, sums are null.
    """
    by, sums = by or {}, sums or {}
    own = [f"k{i}" for i in range(len(by))]
    lefts = left.select(*[F.col(c).alias(k) for k, c in zip(own, by, strict=True)], F.col(left_on).alias("v"), F.lit(0 if strict else 1).alias("side"), F.struct(*left.columns).alias("l"))
    rights = right.dropna(subset=[right_on, *by.values()]).select(*[F.col(c).alias(k) for k, c in zip(own, by.values(), strict=True)], F.col(right_on).alias("v"), F.lit(1 if strict else 0).alias("side"), F.struct(F.lit(1).alias("one"), *[F.col(c).alias(n) for n, c in sums.items()]).alias("r"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    found = running(both, own, [F.asc_nulls_first("v"), F.asc("side")], {name: ("count", F.col("r.one"))} | {n: ("sum", F.col(f"r.{n}")) for n in sums}, rows)
    return found.where("l is not null").select("l.*", name, *sums)


def within(df: DataFrame, by: list[str], on: str, low: Column, name: str = "n", sums: dict[str, str] | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """df with the number of rows of its key from `low` (an expression of the row) to its own `on`, both included, and sums over them.

    A range frame for keys of any size: what is up to the row, less what is below `low`. Rows with a null in `on` or the key count as none.
    """
    sums, keys = sums or {}, {k: k for k in by}
    right = df.select(*by, on, *{*sums.values()} - {*by, on})
    less = below(df.withColumn("_low", low), right, "_low", on, keys, True, {f"_{n}": c for n, c in sums.items()}, "_n", rows)
    both = below(less, right, on, on, keys, False, {f"_all_{n}": c for n, c in sums.items()}, "_all", rows)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*df.columns, (F.col("_all") - F.col("_n")).alias(name), *[(zero(F.col(f"_all_{n}")) - zero(F.col(f"_{n}"))).alias(n) for n in sums])
