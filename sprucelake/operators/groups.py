"""Grouping, windows and ordering in reusable form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sprucelake.session import written


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered. Catalyst limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first in `order`."""
    return top_per_group(df, by, order, 1, "_rank").drop("_rank")


def two_step(df: DataFrame, by: list[str], sums: dict[str, Column], salts: int = 32) -> DataFrame:
    """Sums of groups of which some are very large and not combinable before the shuffle (after an explode or a join on the key)."""
    first = df.groupBy(*by, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("_salt")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return first.groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums])


def sessions(df: DataFrame, by: list[str], time: str, gap: str) -> DataFrame:
    """Rows with `session`, numbered from 0 in each group; a row that comes `gap` or more after the one before starts one."""
    w = W.partitionBy(*by).orderBy(time)
    start = F.when(F.col(time) < F.lag(time).over(w) + F.expr(f"interval {gap}"), 0).otherwise(1)
    return df.withColumn("_start", start).withColumn("session", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_start")


def gap_filled(df: DataFrame, by: list[str], time: str, step: str, values: list[str]) -> DataFrame:
    """A row for each step between a group's first and last time; values are carried forward over gaps."""
    span = df.groupBy(*by).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = span.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(time))
    w = W.partitionBy(*by).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    filled = grid.join(df, [*by, time], "left")
    return filled.select(*by, time, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """Rows numbered from 0 in their order: places inside a partition, offset by the counts of those before it.

    The rows are written to the shared folder, so that numbers and counts are of the same pass.
    """
    own = written(df.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    offsets, total = [], 0
    for part, n in sorted(tuple(r) for r in own.groupBy("_part").count().collect()):
        offsets.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    return own.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_at")
