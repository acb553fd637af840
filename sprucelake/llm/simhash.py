"""Near-duplicate documents by SimHash fingerprints, joined by Golay-code keys.

Method. A text's shingles of k words, repeats included, are hashed by XXH64; a bit of its fingerprint is 1 if more than
half of the hashes have it. Fingerprints are cut into two segments of 23 bits, A and B, and one of 18, C. The binary Golay
code is perfect: each word of 23 bits is within 3 bits of exactly one of 4096 codewords. A segment is indexed under its own codeword's
number and looked up under those of all words within one bit of it, which are one or six numbers, so segments that differ in
one bit at most meet. Of at most three errors in all, pigeonholes leave these cases, each with keys of its own (32 bits and more):

    none in C                 C as it is, and A or B by its codeword
    none in A (B likewise)    A as it is, and B by its codeword or one half of C as it is
    one in each of A, B, C    A and B by their codewords, and one half of C as it is

Equal fingerprints are one class and stand for their documents. Members that share a key are compared by their bits, so
a key only chooses candidates and no link is lost. A key's members go to one group if they are COLD at most, whose links
are a spanning forest. Larger ones are first compared with one member (the hub); where components of what has been found remain apart,
the members outside the hub's component (the rest) meet blocks of all members. If the rest is large, members are dealt
anew by their four quarters first, one of which is equal in any two at most three bits apart.

Defined results: null texts and texts without words have the fingerprint zero and are linked like any other; fewer than k
words are one shingle; a row with a null id is in no group and comes back with component null; rows that share an id are grouped each
by its own text; repeated rows come back each; of an empty table nothing comes. Columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import components, discard, few_rows_a_batch, join_groups, lower_words, quoted, small, small_batches, written

#: Fixed values of the contract: the hash's seed.
SEED = 42
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Bits in which linked fingerprints differ at most; the keys are made for it.
ERRORS = 3
#: Members of a key that one group takes, and members of a block of a larger key.
COLD, BLOCK = 1000, 4000
#: Prints of a task that makes their keys, some 80 of each.
DEALT = 20_000
#: Hashes whose bits are counted at a time.
HASHES = 100_000


def fingerprint(text: str | None, k: int = 3) -> int:
    words = lower_words(text)
    if not words:
        return 0
    joined, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, HASHES):
        bits = np.unpackbits(h[a : a + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, print) of each row of docs (doc_id, text); the print's bits as a signed long."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            prints = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.mapInArrow(work, "doc_id long, print long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and the lower 11 bits, and the error of each syndrome."""
    flips = [sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)]
    errors = np.zeros(2048, np.int64)
    errors[_syndromes(np.array(flips))] = flips
    return _syndromes(np.arange(4096) << 11), _syndromes(np.arange(2048)), errors


def codeword(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the codeword within 3 bits of each 23-bit word."""
    upper, lower, errors = _tables()
    return (words ^ errors[upper[words >> 11] ^ lower[words & 2047]]) >> 11


def nearby(words: np.ndarray) -> np.ndarray:
    """The numbers of the codewords of all words within one bit of each: six columns, -1 where there are fewer. The first is its own."""
    own = codeword(words)
    each = np.sort(np.concatenate([own[:, None], codeword(words[:, None] ^ (1 << np.arange(23)))], axis=1), axis=1)
    new = (np.diff(each, axis=1, prepend=-1) > 0) & (each != own[:, None])
    out = np.full((len(words), 6), -1)
    out[:, 0] = own
    row, col = np.nonzero(new)
    out[row, np.cumsum(new, axis=1)[row, col]] = each[row, col]
    return out


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, own) of each print (a row): what it is looked up under, -1 where there is none; own: what it is indexed under too."""
    bits = prints.view(np.uint64)
    a, b, c = (x.astype(np.int64) for x in (bits >> np.uint64(41), bits >> np.uint64(18) & np.uint64((1 << 23) - 1), bits & np.uint64((1 << 18) - 1)))
    near_a, near_b, halves = nearby(a), nearby(b), np.stack([c >> 9 | 1 << 9, c & 511], axis=1)
    first = np.arange(6) == 0
    made: list[tuple[np.ndarray, np.ndarray]] = []

    def add(case: int, value: np.ndarray, near: np.ndarray | None = None) -> None:
        there = np.ones(value.shape, bool) if near is None else np.broadcast_to(near >= 0, value.shape)
        made.append((np.where(there, value | case << 48, -1), np.broadcast_to(first if near is not None else [True], value.shape)))

    add(1, c[:, None] << 12 | near_a, near_a)
    add(2, c[:, None] << 12 | near_b, near_b)
    add(3, a[:, None] << 12 | near_b, near_b)
    add(4, b[:, None] << 12 | near_a, near_a)
    add(5, a[:, None] << 10 | halves)
    add(6, b[:, None] << 10 | halves)
    for half in range(2):
        for i in range(6):
            value = halves[:, half, None] << 24 | near_a[:, i, None] << 12 | near_b
            made.append((np.where((near_a[:, i, None] >= 0) & (near_b >= 0), value | 7 << 48, -1), np.broadcast_to(first & (i == 0), value.shape)))
    return np.concatenate([k for k, _ in made], axis=1), np.concatenate([o for _, o in made], axis=1)


def dealt(prints: DataFrame) -> DataFrame:
    """(bucket, print, own) for each key of each print (one column)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("print").to_numpy()
            k, own = keys(x)
            row, col = np.nonzero(k >= 0)
            for a in range(0, len(row), 50_000):
                r, c = row[a : a + 50_000], col[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(k[r, c]), pa.array(x[r]), pa.array(own[r, c])], ["bucket", "print", "own"])

    return prints.mapInArrow(work, "bucket long, print long, own boolean")


def forest(one: np.ndarray, two: np.ndarray, component: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links between prints of one and of two that span what is linked; component: what is linked already."""
    if component is None and len(one) * len(two) <= 4:  # most keys
        return sorted({(min(x, y), max(x, y)) for x in one.tolist() for y in two.tolist() if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= ERRORS})
    both = np.unique(np.concatenate([one, two]))
    comp = np.arange(len(both)) if component is None else np.unique([component[p] for p in both.tolist()], return_inverse=True)[1]
    at, other, out = np.searchsorted(both, one), np.searchsorted(both, two), []
    bits = two.view(np.uint64)
    for i, x in zip(at.tolist(), one.view(np.uint64), strict=True):
        for j in other[(np.bitwise_count(bits ^ x) <= ERRORS) & (comp[other] != comp[i])].tolist():
            if comp[i] != comp[j]:
                out.append((int(both[i]), int(both[j])))
                comp[comp == comp[j]] = comp[i]
    return out


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def cold_links(members: DataFrame) -> DataFrame:
    """Links (a, b) inside buckets (bucket, print, own) of COLD members at most."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int]] = set()
            own, looked = batch.column("own"), batch.column("looked")
            for i in range(batch.num_rows):
                out.update(forest(own[i].values.to_numpy(), looked[i].values.to_numpy()))
            if out:
                yield _pairs(sorted(out))

    packed = members.groupBy("bucket").agg(F.collect_list(F.when(F.col("own"), F.col("print"))).alias("own"), F.collect_list("print").alias("looked"))
    return packed.select("own", "looked").mapInArrow(work, "a long, b long")


def _rest_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of members (side 0) and a block of a rest (side 1) -> links that span."""
    sides, prints = pdf["side"].to_numpy(), pdf["print"].to_numpy()
    found = forest(prints[sides == 1], prints[sides == 0], dict(zip(prints.tolist(), pdf["component"].tolist(), strict=True)))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def hot_links(members: DataFrame) -> DataFrame:
    """Links (a, b) inside buckets (bucket, print) of any size, by hubs and then blocks."""
    links = written(members.limit(0).select(F.col("print").alias("a"), F.col("print").alias("b")), "links")
    for last in (False, True):
        heads = written(members.groupBy("bucket").agg(F.min("print").alias("hub"), F.count("*").alias("size")), "heads")
        inside = written(join_groups(members, heads, ["bucket"], "size", members.count()), "inside")
        near = F.bit_count(F.col("print").bitwiseXOR(F.col("hub"))) <= ERRORS
        links = written(links.union(inside.where(near & (F.col("print") != F.col("hub"))).select("hub", "print")).distinct(), "links")
        linked = components(links, "hot")
        marked = inside.drop("size").join(linked.withColumnRenamed("v", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
        marked = written(marked.withColumn("at_hub", F.col("print") == F.col("hub")), "marked")
        mains = marked.groupBy("bucket").agg(F.max(F.when(F.col("at_hub"), F.col("component"))).alias("main"), F.count("*").alias("size"))
        marked = written(join_groups(marked, written(mains, "mains"), ["bucket"], "size", marked.count()), "marked")
        rests = marked.groupBy("bucket").agg(F.count_if(F.col("component") != F.col("main")).alias("rest"), F.first("size").alias("size")).where("rest > 0")
        open_ = written(join_groups(marked.drop("size"), written(rests, "rests"), ["bucket"], "size", marked.count()), "open")
        now = open_ if last else open_.where(F.col("rest") <= BLOCK)
        many, few = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("rest") / BLOCK).cast("int")
        deal = lambda seed, n: F.pmod(F.xxhash64("print", F.lit(seed)), n).cast("int")
        to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        block = now.select("bucket", "print", "component", F.lit(0).alias("side"), deal(0, many).alias("i"), to(few).alias("j"))
        rest = now.where("component <> main").select("bucket", "print", "component", F.lit(1).alias("side"), deal(1, few).alias("j"), to(many).alias("i"))
        links = written(links.union(block.unionByName(rest).groupBy("bucket", "i", "j").applyInPandas(_rest_links, "a long, b long")), "links")
        large = open_.where(F.col("rest") > BLOCK)
        if last or not large.limit(1).count():
            return links
        # Of four quarters of 16 bits one is equal in any two members at most three bits apart.
        quarter = F.posexplode(F.array(*[F.shiftrightunsigned("print", 16 * i).bitwiseAND(0xFFFF) for i in range(4)])).alias("at", "quarter")
        members = written(large.select("bucket", "print", quarter).select(F.xxhash64("bucket", "at", "quarter").alias("bucket"), "print").distinct(), "quarters")
    return links


def links_of(prints: DataFrame) -> DataFrame:
    """Links (a, b) that span what is linked among prints (one column, distinct), as a written table."""
    each = dealt(prints.repartition(max(1, math.ceil(prints.count() / DEALT))))
    heads = each.groupBy("bucket").agg(F.count("*").alias("size"), F.max("own").alias("own")).where("size > 1 and own").select("bucket", "size")
    heads = written(heads, "heads")
    hot = heads.where(F.col("size") > COLD).select("bucket")  # bounded: a bucket has COLD of the prints' keys at least
    cold = written(cold_links(each.join(small(heads.where(F.col("size") <= COLD).select("bucket")), "bucket")).distinct(), "links")
    if not hot.limit(1).count():
        return cold
    return written(cold.union(hot_links(written(each.join(small(hot), "bucket").select("bucket", "print"), "hot"))).distinct(), "links")


def simhash_groups(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs, linked where fingerprints differ in at most ERRORS bits."""
    few_rows_a_batch(docs.sparkSession)
    prints = written(fingerprints(docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")), k), "prints")
    classes = written(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    links = links_of(classes.select("print"))
    linked = components(links, "prints")
    # Of a component the smallest id of all its classes counts.
    tops = classes.join(linked.withColumnRenamed("v", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    tops = written(tops, "tops")
    firsts = written(tops.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("prints")), "firsts")
    named = written(join_groups(tops, firsts, ["component"], "prints", tops.count()).select("print", "rows", "component_id"), "named")
    out = join_groups(prints.where("doc_id is not null"), named, ["print"], "rows", prints.count())
    out = out.select("doc_id", "print", "component_id").unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    discard(links, linked, classes, tops, firsts)
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
