"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and grouping.

Method. A document's set is its distinct k-word shingles. SuperMinHash gives every shingle a
random permutation of the signature's slots and offers it value (rank, random) at each slot;
a slot keeps its least. Ranks are handed out level by level over all shingles of a batch, and
a document stops as soon as all its slots hold a value of the current level. Bands of rows of
the signature send documents to buckets.

Documents with equal sets form a class; only one document of a class goes on. In each bucket
all members are compared with its smallest member (the hub), on full sets. Links give components.

A bucket that still holds several components is left with its rest: the members outside the largest
component. If the rest is small, it is compared with all members: these are cut into blocks, each
once, and the rest goes to every block, so the rows grow with the bucket and not with its square.

A bucket with a large rest (edited copies of one page, pages with much common text) is dealt anew, in a way that
no link can cross. Shingles of it are frequent or rare. Two linked members with a rare shingle in common have one among
the first few of either (prefix filter, rare ones first) and meet in that shingle's bucket. Two without have
only frequent shingles in common, of which both must have as many as the threshold asks for their two sizes.
Few members of a group of edited copies have enough for others of their size; these meet in one bucket for their class of
sizes, with as hub the one nearest to what is common, and others only as visitors in classes of smaller sizes
for which they have enough. Visitors are not compared with each other. What is left after that with a large rest is dealt once more, by
first shingles alone, rare and frequent. All this is exact: no link between different components inside a bucket is
lost. The hub's set is copied for every BLOCK members, and what many rows have in common is joined by join_groups, so no task grows with a bucket.

Defined results: null or empty texts have an empty set and are linked with nothing; fewer than
k words are one shingle; rows that share an id are one document, linked by any of their texts,
and each comes back; rows with a null id are left out of the groups and come back with component
null and kept true. Texts of any
length are read whole. Columns besides id and text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import WordHashes, components, discard, few_rows_a_batch, join_groups, lower_words, mix, shingles, small, small_batches, tidy, written

#: Members of a block: of a bucket's members that meet one copy of its hub's set, or its rest.
BLOCK = 500
#: A shingle is frequent if more than one of so many members of a bucket have it.
FREQUENT = 20
#: A pair of documents is missed by all bands with at most this probability at the threshold.
MISS = 1e-5
LEVEL = np.uint64(32)


def bands_for(threshold: float, rows: int | None = None, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the bands that a pair at the threshold escapes with probability `miss` at most."""
    rows = rows or (4 if threshold < 0.83 else 5)
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def superminhash(elements: np.ndarray, lengths: np.ndarray, m: int) -> np.ndarray:
    """Signatures (one row of m values for each document) of documents that have elements one after another."""
    n = len(lengths)
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), lengths)
    swaps: list[np.ndarray] = []
    for level in range(m):
        if not len(elements):
            break
        r = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64))
        target = (level + (((r >> LEVEL) * np.uint64(m - level)) >> LEVEL).astype(np.int64)).astype(np.int16)
        slot = target
        for i in range(level - 1, -1, -1):  # what the swaps so far have left at that place
            slot = np.where(swaps[i] == slot, np.int16(i), slot)
        np.minimum.at(sig, doc * m + slot, (np.uint64(level) << LEVEL) | (r & np.uint64(0xFFFFFFFF)))
        swaps.append(target)
        live = (sig.reshape(n, m) >= (np.uint64(level + 1) << LEVEL)).any(axis=1)[doc]
        if not live.all():
            elements, doc, swaps = elements[live], doc[live], [s[live] for s in swaps]
    return sig.reshape(n, m)


def _sets(texts: Iterable[str | None], k: int, memo: WordHashes) -> list[np.ndarray]:
    return [shingles(memo.of(lower_words(t)), k) for t in texts]


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, key, bands) of each row of docs (doc_id, text): set size, 128-bit name of the set, band hashes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in small_batches(batches, "text", 1_000_000):
            sets = _sets(batch.column("text").to_pylist(), k, memo)
            n = np.array([len(s) for s in sets], np.int64)
            sig = superminhash(np.concatenate([*sets, np.empty(0, np.uint64)]), n, bands * rows).reshape(len(sets), bands, rows)
            band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands))
            for i in range(rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            offsets = pa.array(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(band).view(np.int64).ravel())),
                ],
                ["doc_id", "n", "key", "bands"],
            )

    return docs.mapInArrow(tidy(work), "doc_id long, n long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, s) with the sorted shingle hashes of each row of docs (doc_id, text)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in small_batches(batches, "text", 1_000_000):
            sets = _sets(batch.column("text").to_pylist(), k, memo)
            ends = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
            values = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "s"])

    return docs.mapInArrow(tidy(work), "doc_id long, s array<long>")


def _block_links(percent: int):
    """Spanning links between the members of different components in a block (side 0) and a rest (side 1).

    A member of the rest is held against the whole block at once: its shingles' posting lists give
    the sizes of all its intersections.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = pdf["side"].to_numpy()
        block, rest = pdf[sides == 0], pdf[sides == 1]
        n, ids, out = len(block), block["rep"].to_numpy(), []
        if n and len(rest):
            sizes = block["s"].map(len).to_numpy()
            names, element = np.unique(np.concatenate(block["s"].to_list()), return_inverse=True)
            owner = np.repeat(np.arange(n), sizes)[np.argsort(element, kind="stable")]
            starts = np.concatenate([[0], np.cumsum(np.bincount(element, minlength=len(names)))])
            comp = np.unique(np.concatenate([block["component"], rest["component"]]), return_inverse=True)[1]
            for k, (x, s) in enumerate(zip(rest["rep"].tolist(), rest["s"], strict=True)):
                if (comp[:n] == comp[n + k]).all():
                    continue
                at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                at = at[names[at] == s]
                both = np.bincount(np.concatenate([owner[starts[e] : starts[e + 1]] for e in at]), minlength=n) if len(at) else np.zeros(n, np.int64)
                for y in np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (comp[:n] != comp[n + k])):
                    if comp[y] != comp[n + k]:
                        out.append((ids[y], x))
                        comp[comp == comp[n + k]] = comp[y]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return work


class Linker:
    """Links between members (bucket, rep, n) that share a bucket, by their full sets (doc_id, s)."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.percent = percent
        self.one, self.two = sets.select(F.col("doc_id").alias("rep"), "s"), sets.select(F.col("doc_id").alias("hub"), F.col("s").alias("t"))

    def stars(self, inside: DataFrame) -> DataFrame:
        """Links (a, b) of the members inside buckets (bucket, rep, n, hub, hub_n, size) with the hubs."""
        chunks = F.ceil(F.col("size") / BLOCK).cast("int")
        pairs = inside.where(f"rep <> hub and least(n, hub_n) * 100 >= {self.percent} * greatest(n, hub_n)").groupBy("hub", "rep").agg(F.max(chunks).alias("chunks"))
        pairs = written(pairs, "pairs")
        hubs = pairs.select("hub", "chunks").distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(self.two, "hub")
        met = pairs.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).join(self.one, "rep").join(hubs, ["hub", "chunks", "chunk"])
        both = F.size(F.array_intersect("s", "t"))
        return written(met.where(100 * both >= self.percent * (F.size("s") + F.size("t") - both)).select(F.col("hub").alias("a"), F.col("rep").alias("b")), "links")

    def still_open(self, inside: DataFrame, found: DataFrame) -> DataFrame:
        """Members of buckets that hold several components of found, with component, main (the largest one) and how many they are.

        members: all; main_homes, rest_homes, rest_visitors: in the main component and in others; large: too many for blocks.
        """
        marked = inside.where("size > 2").select("bucket", "rep", "n", "home", "size").join(found.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        marked = written(marked, "marked")
        shares = marked.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        tops = shares.groupBy("bucket").agg(F.max(F.struct("n", "component", "homes")).alias("top"), F.sum("n").alias("members"), F.sum("homes").alias("homes"))
        tops = tops.selectExpr("bucket", "top.component as main", "members", "top.homes as main_homes", "homes - top.homes as rest_homes", "members - top.n - homes + top.homes as rest_visitors")
        tops = tops.where("rest_homes > 0 or rest_visitors > 0 and main_homes > 0")
        tops = tops.withColumn("large", (F.col("rest_homes") > BLOCK) | (F.least("rest_visitors", "main_homes") > BLOCK))
        return join_groups(marked, written(tops, "tops"), ["bucket"], "members", marked.count())

    def blocks(self, members: DataFrame) -> DataFrame:
        """Links (a, b) between the rest of each bucket and all its members, but for visitors among each other."""
        apart, home = F.col("component") != F.col("main"), F.col("home")
        deal = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
        to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        sides = []
        # Of the rest, those at home meet all members and visitors meet those at home in the main component.
        for part, (left, many, right, few) in enumerate(((F.lit(True), "members", apart & home, "rest_homes"), (~apart & home, "main_homes", apart & ~home, "rest_visitors"))):
            met = members.where(f"{many} > 0 and {few} > 0")
            many, few = (F.ceil(F.col(size) / BLOCK).cast("int") for size in (many, few))
            own = ["bucket", F.lit(part).alias("part"), "rep", "component"]
            sides.append(met.where(left).select(*own, F.lit(0).alias("side"), deal(0, many).alias("i"), to(few).alias("j")))
            sides.append(met.where(right).select(*own, F.lit(1).alias("side"), deal(1, few).alias("j"), to(many).alias("i")))
        each = reduce(DataFrame.unionByName, sides).join(self.one, "rep")
        return written(each.groupBy("bucket", "part", "i", "j").applyInPandas(_block_links(self.percent), "a long, b long"), "links")

    def dealt_anew(self, members: DataFrame, whole: bool) -> DataFrame:
        """The members (bucket, rep, n) of large buckets in new ones: (bucket, rep, n, home, rank).

        whole: by their first shingles, in the order of frequency in the bucket. Else by those of the first ones that are rare in
        the bucket, and by classes of sizes as far as they have enough frequent ones for a link.
        """
        chunks = F.ceil(F.col("members") / BLOCK).cast("int")
        own = written(members.select("bucket", "rep", "n", "members", chunks.alias("chunks"), F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk")).join(self.one, "rep"), "prefix")
        often = own.select("bucket", "chunks", "members", F.explode("s").alias("e")).groupBy("bucket", "chunks", "members", "e").agg(F.count("*").alias("c")).where(F.col("c") * FREQUENT > F.col("members"))
        often = often.groupBy("bucket", "chunks").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "e"))), lambda x: x["e"]).alias("often"))
        often = often.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = own.join(often, ["bucket", "chunks", "chunk"], "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))
        rare, usual = F.array_except("s", "often"), F.array_intersect("often", "s")
        # A link asks for (100 + percent) |x & y| >= percent (|x| + |y|); of the members, that one is nearest to what is common which has most to spare.
        some, each = self.percent, 100 + self.percent
        both = both.select("bucket", "rep", "n", rare.alias("rare"), usual.alias("usual"), (each * F.size(usual) - some * F.col("n")).alias("rank"))
        # |x & y| >= t |x| for either of two linked sets, and >= 2t / (1 + t) |y| for the smaller one.
        probe, index = (F.col("n") - F.ceil(F.col("n") * a / b) + 1 for a, b in ((some, 100), (2 * some, each)))
        first = F.slice(F.concat("rare", "usual") if whole else F.col("rare"), 1, probe.cast("int"))
        dealt = both.select("bucket", "rep", "n", "rank", index.alias("index"), F.posexplode(first).alias("at", "e"))
        dealt = dealt.select(F.xxhash64("bucket", "e").alias("bucket"), "rep", "n", (F.col("at") < F.col("index")).alias("home"), "rank")
        if not whole:
            # With frequent shingles alone in common, x reaches sizes up to `most`.
            sizes = both.select("bucket", "rep", "n", "rank", F.ceil(F.col("n") * some / 100).alias("least"), F.least("n", F.floor(F.col("rank") / some)).alias("most")).where("most >= least")
            sizes = sizes.withColumn("class", F.explode(F.sequence(size_class("least"), size_class("most"))))
            dealt = dealt.union(sizes.select(F.xxhash64("bucket", "class", F.lit("size")), "rep", "n", F.col("class") == size_class("n"), "rank"))
        dealt = written(dealt, "dealt")
        useful = dealt.groupBy("bucket").agg(F.max("home").alias("home"), F.count("*").alias("members")).where("home and members > 1")
        return join_groups(dealt, useful.select("bucket", "members"), ["bucket"], "members", dealt.count()).drop("members")


def size_class(n: str) -> Column:
    """The class of a size (a column's name): 32 classes for each doubling, in order; sizes below 64 are classes of their own."""
    shift = f"greatest(length(bin({n})) - 6, 0)"
    return F.expr(f"32 * {shift} + shiftright({n}, {shift})")


def with_hubs(members: DataFrame, total: int) -> DataFrame:
    """The members (bucket, rep, n, home, rank), `total` of them, of buckets that several share, with the bucket's size and its hub: at home, of highest rank, smallest."""
    order = F.struct((~F.col("home")).alias("away"), (-F.col("rank")).alias("rank"), "rep", "n")
    heads = members.groupBy("bucket").agg(F.min(order).alias("hub"), F.count("*").alias("size")).where("size > 1")
    heads = written(heads.select("bucket", "size", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "heads")
    return written(join_groups(members.drop("rank"), heads, ["bucket"], "size", total), "inside")


def near_groups(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs, linked at Jaccard >= threshold on k-word shingles."""
    spark, percent = docs.sparkSession, round(100 * threshold)
    few_rows_a_batch(spark)
    bands, rows = bands_for(threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, k, bands, rows), "signed")

    # One document of each class of equal sets goes on.
    classes = signed.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = written(classes, "classes")
    inside = with_hubs(classes.select("rep", "n", F.explode("bands").alias("bucket"), F.lit(True).alias("home"), F.lit(0).alias("rank")), bands * classes.count())
    wanted = written(inside.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = written(shingle_sets(docs.join(small(wanted), "doc_id", "left_semi").distinct(), k), "sets")

    linker = Linker(sets, percent)
    links = linker.stars(inside)
    first = components(links, "first")
    left = written(linker.still_open(inside, first), "left")
    links = links.union(linker.blocks(left.where("not large")))
    for whole in (False, True):
        large = left.where("large")
        if not large.limit(1).count():
            break
        dealt = written(linker.dealt_anew(large, whole), "dealt")
        again = with_hubs(dealt, dealt.count())
        links = links.union(linker.stars(again))
        left = written(linker.still_open(again, components(links, "second")), "left")
        links = links.union(linker.blocks(left if whole else left.where("not large")))
    final = components(links.distinct(), "final")
    discard(inside, wanted, sets, first)

    tops = classes.select("key", "rep", "rows").join(final.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rows", F.coalesce("component", "rep").alias("component"))
    out = join_groups(signed.select("doc_id", "n", "key"), written(tops, "tops"), ["key"], "rows", signed.count(), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
