"""Joins beyond the built-in ones: as-of, band, salted, and a broadcast that checks the size first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sprucelake.operators.ordered import HOT_ROWS, hot_keys, running


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], tolerance: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each left row with `values` of the latest right row of its `by` key at or before its time.

    One pass instead of a join: both sides are put together, sorted once by key and time (right
    rows before left rows of the same time), and the last right row is carried forward. Keys are counted
    before: rows of a key with a large share of them (more than hot_rows) lie in chunks of their order (operators/ordered.py), so no task
    gets such a key as a whole. Of right
    rows that tie in time the one with the largest values counts. `tolerance`: an interval string;
    older matches become null. As in a left join, left rows with a null in key or time stay and have
    null values, and right rows with one match nothing. Columns of the left side keep their names,
    whatever these are; none of `values` may be among them.
    """
    if taken := {v.lower() for v in values} & {c.lower() for c in left.columns}:
        raise ValueError(f"both sides have {sorted(taken)}: rename the right side's")
    keys = [f"k{i}" for i in range(len(by))]
    own = F.struct(F.col(right_on).alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    lefts = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(left_on).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("l"))
    rights = right.dropna(subset=[*by, right_on]).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(right_on).alias("t"), F.lit(0).alias("side"), own.alias("r"))
    order = [F.asc_nulls_first("t"), F.asc("side"), F.asc("r")]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    both = lefts.unionByName(rights, allowMissingColumns=True)
    carried = lambda rows: rows.withColumn("last", F.last("r", ignorenulls=True).over(w))
    largest = both.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > hot_rows:
        hot = F.broadcast(hot_keys(both.select(*keys), keys, hot_rows))  # fewer than HOT_SHARE keys
        same = [both[k].eqNullSafe(hot[k]) for k in keys]
        split = running(both.join(hot, same, "left_semi"), keys, order, {"last": ("last", F.col("r"))})
        both = carried(both.join(hot, same, "left_anti")).unionByName(split).where("side = 1")
    else:
        both = carried(both).where("side = 1")
    if tolerance:
        both = both.withColumn("last", F.when(F.col("last.at") >= F.col("t") - F.expr(f"interval {tolerance}"), F.col("last")))
    return both.select("l.*", *[F.col(f"last.v{i}").alias(v) for i, v in enumerate(values)])


def band_join(points: DataFrame, bands: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the bands [low, high] that hold them: an equi-join on buckets of `width` instead of a nested loop.

    A band goes to each bucket that it touches, so `width` should be about a band's length.
    """
    by = by or []
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = bands.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("_bucket", bucket(point)).join(spread, [*by, "_bucket"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_bucket")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int = 16, salt_by: Column | None = None) -> DataFrame:
    """Inner join for keys that hold a large share of `large`: its rows are dealt to `salts` parts, `small` goes to each."""
    salt_by = salt_by if salt_by is not None else F.xxhash64(*large.columns)
    dealt = large.withColumn("_salt", F.pmod(salt_by, F.lit(salts)).cast("int"))
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")


def join_small(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_rows: int = 1_000_000) -> DataFrame:
    """A broadcast join if `small` is counted to have most_rows at most, else a shuffled one."""
    return large.join(F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small, on, how)
