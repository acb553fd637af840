"""What the text operators share: words, hashes, batches, written tables, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sprucelake.session import delete_folder, shared_folder, written

__all__ = ["WordHashes", "components", "discard", "few_rows_a_batch", "fresh", "give_back", "join_groups", "lower_words", "mix", "quoted", "shared_folder", "shingles", "slices", "small", "small_batches", "tidy", "written"]

#: Keys that more than one of so many rows have are at most so many: they are broadcast in join_groups.
HOT_SHARE = 10_000
#: A worker's memo of words is emptied at this size.
MEMO_WORDS = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift and multiply rounds), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\t..\\r, after lower-casing A-Z only. Null is as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, filled as words come and emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer than k words are one shingle, none are none."""
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(out)


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to `most` at most (a larger one stands alone)."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if total or start <= i:
        yield start, i + 1


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that `column` (string) has about `most` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for a, b in slices(sizes, most):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system: a worker outlives its tasks, and what its allocators keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def tidy(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work (for mapInArrow), after whose last batch a task gives back what it no longer uses."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def few_rows_a_batch(spark: SparkSession, most: int = 1000) -> None:
    """Lower the session's rows in an Arrow batch to `most`, as texts are large.

    Spark reads the setting when a plan runs, which is after an operator returns, so it stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def fresh(taken: Iterable[str], name: str) -> str:
    """name, with marks behind it if it is among the names taken (whatever their case)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df (ids, written already) with a broadcast hint if it is counted and has `most` rows at most; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of groups (one row for each value of keys that `size` of the `total` rows have), inner or left.

    Keys that more than one of HOT_SHARE rows have are fewer than HOT_SHARE, however large the
    table: their groups are broadcast and their rows stay where they are. Rows of other keys are
    shuffled, and no task gets more than that share for one key. Keys are not null. rows and groups are read twice.
    """
    hot = F.col(size) * HOT_SHARE > total
    many, few = F.broadcast(groups.where(hot)), groups.where(~hot)
    return rows.join(many, keys).unionByName(rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti").join(few, keys, how))


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, path)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(v, component) for each end of the edges (a, b): component is the smallest vertex that can be reached.

    Each round gives every vertex the smallest label among its neighbours and then follows
    labels one more step, so the number of rounds grows with the logarithm of paths' lengths.
    Labels stay distributed; each round is a written table, of which only the last two are kept.
    Minima are combined before the shuffle, so a hub with very many edges does no harm.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), purpose)
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("component")), purpose)
    while True:
        near = both.join(labels.select(F.col("v").alias("a"), "component"), "a").groupBy(F.col("b").alias("v")).agg(F.min("component").alias("near"))
        # Labels of one component meet: a vertex also hands its new label to its old label's vertex.
        step = labels.join(near, "v").select("v", "component", F.least("component", "near").alias("low"))
        down = step.select("v", "low").union(step.select(F.col("component").alias("v"), "low")).groupBy("v").agg(F.min("low").alias("low"))
        up = down.select(F.col("v").alias("low"), F.col("low").alias("top"))
        after = written(labels.join(down, "v").join(up, "low", "left").select("v", F.col("component").alias("was"), F.least("low", F.coalesce("top", "low")).alias("component")), purpose)
        changed = after.where("was <> component").limit(1).count()
        labels, old = after.select("v", "component"), labels
        discard(old)
        if not changed:
            discard(both)
            return labels
