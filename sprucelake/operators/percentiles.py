"""Exact percentiles of groups of any size, by selection.

Small groups are left to the built-in aggregates. In a large one, each wanted rank has an interval that holds it. A round takes a sketch
of the values inside, picks two of them around the rank, counts what lies below, at, between, at and above them, and
goes on with the part that has the rank; a part that is a single value is the answer. The counts are exact, so an inexact sketch costs rounds, not
correctness. What is left when an interval has at most `most` values is sorted. A round is two passes with partial aggregation; only
intervals' values meet, never a group's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sprucelake.session import written

#: Values of a group that one task sorts at most.
MOST = 1_000_000
#: Places of the sketch's values, and its accuracy.
GRID, ACCURACY = 64, 2000


def _ranks(n: Column, fraction: float, kind: str) -> tuple[Column, Column]:
    """The lower and the upper rank (from 0) that a percentile of n values lies between."""
    if kind == "cont":
        return F.floor((n - 1) * fraction).cast("long"), F.ceil((n - 1) * fraction).cast("long")
    at = F.greatest(F.ceil(n * fraction) - 1, F.lit(0)).cast("long")
    return at, at


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, str]], most: int = MOST) -> DataFrame:
    """(by, name, ...): for each group the percentiles name -> (fraction, "cont" or "disc") of a numeric column as doubles. Nulls are left out; groups without values have nulls."""
    rows = df.select(*by, F.col(value).cast("double").alias("v"))
    sizes = written(rows.groupBy(*by).agg(F.count("v").alias("n")), "sizes")
    large = sizes.where(F.col("n") > most)
    plain = {n: F.expr(f"percentile_{kind}({f}D) WITHIN GROUP (ORDER BY v)").cast("double") for n, (f, kind) in wanted.items()}
    if not large.limit(1).count():
        return rows.groupBy(*by).agg(*[c.alias(n) for n, c in plain.items()])
    one = lambda rest, how: rows.join(F.broadcast(rest.select(*[F.col(k).alias(f"_{k}") for k in by])), [rows[k].eqNullSafe(F.col(f"_{k}")) for k in by], how)
    small = one(large, "left_anti").groupBy(*by).agg(*[c.alias(n) for n, c in plain.items()])  # of large groups there are rows / most at most
    return small.unionByName(_selected(one(large, "left_semi"), by, large, wanted, most))


def _selected(rows: DataFrame, by: list[str], sizes: DataFrame, wanted: dict[str, tuple[float, str]], most: int) -> DataFrame:
    targets = {f"{i}_{side}": _ranks(F.col("n"), f, kind)[side] for i, (f, kind) in enumerate(wanted.values()) for side in (0, 1)}
    none = F.lit(None).cast("double")
    first = {t: F.struct(none.alias("low"), none.alias("high"), rank.alias("rank"), F.col("n").alias("inside"), none.alias("answer")) for t, rank in targets.items()}
    state = written(sizes.select(*by, "n", *[s.alias(t) for t, s in first.items()]), "state")
    names = [F.col(k).alias(f"_{k}") for k in by]

    def inside(t: str) -> Column:
        s = F.col(t)
        return s["answer"].isNull() & (s["low"].isNull() | (F.col("v") > s["low"])) & (s["high"].isNull() | (F.col("v") < s["high"]))

    def joined(what: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(what.select(*names, *targets)), [rows[k].eqNullSafe(F.col(f"_{k}")) for k in by])

    while state.where(" or ".join(f"(`{t}`.answer is null and `{t}`.inside > {most})" for t in targets)).limit(1).count():
        grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
        sketch = joined(state).where("v is not null").groupBy(*by).agg(*[F.approx_percentile(F.when(inside(t), F.col("v")), grid, ACCURACY).alias(f"g{t}") for t in targets])
        seen = state.join(F.broadcast(sketch.select(*[F.col(k).alias(f"_{k}") for k in by], *[f"g{t}" for t in targets])), [state[k].eqNullSafe(F.col(f"_{k}")) for k in by], "left")
        # Two values of the sketch, one place beyond the rank's on either side.
        place = lambda t: F.floor(F.col(t)["rank"] * GRID / F.col(t)["inside"]).cast("int")
        pick = lambda t, at: F.element_at(f"g{t}", F.least(F.greatest(at, F.lit(0)), F.lit(GRID)) + 1)
        pivots = written(seen.select(*by, "n", *[F.col(t).withField("a", pick(t, place(t) - 1)).withField("b", pick(t, place(t) + 2)).alias(t) for t in targets]), "pivots")
        a, b, v = (lambda t: F.col(t)["a"]), (lambda t: F.col(t)["b"]), F.col("v")
        counts = {f"{part}{t}": F.count_if(inside(t) & c) for t in targets for part, c in (("less", v < a(t)), ("at", v == a(t)), ("mid", (v > a(t)) & (v < b(t))), ("top", (v == b(t)) & (b(t) > a(t))))}
        counted = joined(pivots).where("v is not null").groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])
        after = pivots.join(F.broadcast(counted.select(*names, *counts)), [pivots[k].eqNullSafe(F.col(f"_{k}")) for k in by])

        def narrowed(t: str) -> Column:
            s, less, at, mid, top = F.col(t), *(F.col(f"{p}{t}") for p in ("less", "at", "mid", "top"))
            rank, upto = s["rank"], [less, less + at, less + at + mid, less + at + mid + top]
            made = lambda low, high, rank, inside, answer: F.struct(low.alias("low"), high.alias("high"), rank.alias("rank"), inside.alias("inside"), answer.alias("answer"))
            done = lambda x: made(s["low"], s["high"], rank, s["inside"], x)
            return (
                F.when(s["answer"].isNotNull() | s["a"].isNull(), done(s["answer"]))
                .when(rank < upto[0], made(s["low"], s["a"], rank, less, none))
                .when(rank < upto[1], done(s["a"]))
                .when(rank < upto[2], made(s["a"], s["b"], rank - upto[1], mid, none))
                .when(rank < upto[3], done(s["b"]))
                .otherwise(made(s["b"], s["high"], rank - upto[3], s["inside"] - upto[3], none))
            )

        state = written(after.select(*by, "n", *[narrowed(t).alias(t) for t in targets]), "state")
    # What is left of each interval is sorted.
    each = joined(state).where("v is not null").select(*by, "v", F.explode(F.array(*[F.when(inside(t), F.struct(F.lit(t).alias("t"), F.col(t)["rank"].alias("rank"))) for t in targets])).alias("x")).where("x is not null")
    sorted_ = each.withColumn("at", F.row_number().over(W.partitionBy(*by, "x.t").orderBy("v")) - 1).where("at = x.rank")
    found = sorted_.groupBy(*names).agg(*[F.max(F.when(F.col("x.t") == t, F.col("v"))).alias(f"f{t}") for t in targets])
    both = state.join(found, [state[k].eqNullSafe(F.col(f"_{k}")) for k in by], "left")
    value = lambda i, side: F.coalesce(F.col(f"{i}_{side}")["answer"], F.col(f"f{i}_{side}"))

    def between(i: int, fraction: float, kind: str) -> Column:
        low, high = value(i, 0), value(i, 1)
        return low if kind == "disc" else F.when(low == high, low).otherwise(low + (high - low) * ((F.col("n") - 1) * fraction - F.floor((F.col("n") - 1) * fraction)))

    return both.select(*by, *[between(i, f, kind).alias(name) for i, (name, (f, kind)) in enumerate(wanted.items())])
