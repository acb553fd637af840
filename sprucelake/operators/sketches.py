"""Count-min sketches as tables, and heavy hitters by them. Built-in functions only.

A sketch has `depth` rows of `width` counters; a key adds to one counter of each row, chosen by a hash. It is a table of at most
depth * width rows (line, cell, n), however many rows it was made from: partial sums are made before the shuffle. The least of a key's counters is never below its count, and
above it by more than e / width of all rows with probability e ** -depth at most. Sketches of equal size are merged by adding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprucelake.session import written

DEPTH, WIDTH = 8, 1 << 16


def _cells(keys: list[Column], depth: int, width: int) -> Column:
    """The key's cell in each line."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(line), *keys), F.lit(width)).cast("int") for line in range(depth)])


def count_min(df: DataFrame, keys: list[str], weight: Column | None = None, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(line, cell, n): a sketch of how often keys occur, or of the sums of a weight that is a whole number and not negative. A null is a key."""
    each = df.select(F.posexplode(_cells([F.col(k) for k in keys], depth, width)).alias("line", "cell"), (weight if weight is not None else F.lit(1)).cast("long").alias("w"))
    return each.groupBy("line", "cell").agg(F.sum("w").alias("n")).where("n > 0")


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that the sketches, of equal depth and width, were made from."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("line", "cell").agg(F.sum("n").alias("n"))


def estimates(df: DataFrame, keys: list[str], sketch: DataFrame, depth: int = DEPTH, width: int = WIDTH, name: str = "estimate") -> DataFrame:
    """(keys, estimate) of each distinct key of df, by a sketch of this depth and width. The sketch is broadcast: it has depth * width rows at most."""
    asked = df.select(*keys).distinct()
    each = asked.select("*", F.posexplode(_cells([F.col(k) for k in keys], depth, width)).alias("line", "cell"))
    read = each.join(F.broadcast(sketch), ["line", "cell"], "left")
    return read.groupBy(*keys).agg(F.min(F.coalesce("n", F.lit(0).cast("long"))).alias(name))


def overcount(rows: int, width: int = WIDTH) -> int:
    """What an estimate may be above the count (for each key with probability 1 - e ** -depth)."""
    return math.ceil(math.e * rows / width)


def heavy_hitters(df: DataFrame, keys: list[str], share: float, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(keys, n): exactly the keys that at least `share` of all rows have. A first pass makes the sketch, a second one counts the rows of keys that it doesn't rule out."""
    sketch = written(count_min(df, keys, depth=depth, width=width), "sketch")
    rows = sketch.where("line = 0").agg(F.sum("n")).first()[0] or 0
    # A key is ruled out by any line where its cell has too little; a line has 1 / share cells with enough at most.
    rest = df.select(*keys)
    for line in range(depth):
        heavy = sketch.where((F.col("line") == line) & (F.col("n") >= share * rows)).select(F.col("cell").alias("_cell"))
        rest = rest.join(F.broadcast(heavy), _cells([F.col(k) for k in keys], depth, width)[line] == F.col("_cell"), "left_semi")
    return rest.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= share * rows)
