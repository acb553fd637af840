"""Alignment of two tokenizers over whole texts, and how often their tokens are linked in the corpus.

Method. Both tokenizers' tokens cover the same bytes. The places where tokens end are marked in one packed bitset each;
the AND of the two has the shared cuts. Popcounts summed over words (rank) turn a cut into the number of tokens
of either side before it, so two neighbouring cuts (found by select) are a group: a range of tokens on each side. A group's
links are all its pairs of an A and a B token.

Texts are cut at single spaces between characters that are no white space: there both tokenizers cut too, whatever stands around
(the byte-level one begins a pre-token, no piece of the other goes over a space inside). So a worker tokenizes and aligns each such
unit once and remembers it; a text is the sequence of its units. Texts are read whole.

Counts. A text's distinct pairs are written with it. How many texts have a pair is counted in each task first, so a
pair that all texts have costs one row for each task. Pairs that more than one of MOST of all rows of pairs are (fewer than MOST,
whatever the corpus) go to the tasks that hold the texts, as sorted arrays; rows of other pairs, of which no one has more than
that share, are joined by a shuffle.

Defined results: texts that are null or empty, or whose tokens of either side don't give a space and the text back, have no
tokens: zeros and an empty digest. Strings of special tokens are plain text. Rows that repeat an id are texts of their own, and
so are repeated rows. Of an empty table nothing comes. Columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import discard, few_rows_a_batch, quoted, slices, small_batches, written

#: A space between characters that neither tokenizer takes for white space.
BOUNDARY = re.compile(r" (?<=[^\s᠎​﻿▁] )(?=[^\s᠎​﻿▁])")
#: A unit without white space at its ends, so that a space before and behind it is a boundary.
CLEAN = re.compile(r"(?=[^\s\u180e\u200b\ufeff\u2581]).*[^\s\u180e\u200b\ufeff\u2581]\Z", re.DOTALL)
#: Characters of units that are tokenized as one text.
LINE_CHARS = 20_000
#: A pair of ids is one number: A's above PAIR bits.
PAIR = 15
#: Units of more characters are not remembered; a worker starts afresh at so many units.
LONG, MEMO = 64, 500_000
#: Links of a group that are written out one by one at most; a larger group is counted by its distinct ids.
LINKS = 4096
#: Pairs that all tasks get at most.
MOST = 1_000_000
#: Distinct pairs that a task counts before it gives them on.
COUNTED = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are themselves, others come in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in (self.b.id_to_piece(i),)}
        if max(self.bytes_b) >> PAIR or max(self.bytes_a) >> (31 - PAIR):
            raise ValueError("the vocabularies are too large for one number of 31 bits")
        self.sizes_a, self.sizes_b = (np.array([len(table.get(i, b"")) for i in range(max(table) + 1)]) for table in (self.bytes_a, self.bytes_b))
        #: Each id with the mark behind it, if it isn't the last of its side of a group and if it is.
        self.marked = [f"{i}{mark}" for n, ends in ((len(self.sizes_a), ",|"), (len(self.sizes_b), ",;")) for i in range(n) for mark in ends]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text by A, and of each text by B."""
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def exact(self, texts: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """(texts whose tokens on both sides give a space and the text back, the others, ids by A and by B of the first, one after another)."""
        good, bad, a, b = [], [], [], []
        for t, x, y in zip(texts, *self.encode(texts), strict=True):
            whole = (" " + t).encode("utf-8", "surrogatepass")
            if b"".join(map(self.bytes_a.__getitem__, x)) == whole == b"".join(map(self.bytes_b.__getitem__, y)):
                good.append(t)
                a += x
                b += y
            else:
                bad.append(t)
        return good, bad, np.array(a, np.int64), np.array(b, np.int64)

    def exact_units(self, units: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """exact() for units: many that can stand side by side go to the tokenizers as one text."""
        clean, alone = [u for u in units if CLEAN.match(u)], [u for u in units if not CLEAN.match(u)]
        lines = {" ".join(clean[x:y]): clean[x:y] for x, y in slices([len(u) for u in clean], LINE_CHARS)} if clean else {}
        whole, broken, a, b = self.exact(list(lines))
        good, bad, a2, b2 = self.exact(alone + [u for line in broken for u in lines[line]])
        return [u for line in whole for u in lines[line]] + good, bad, np.r_[a, a2], np.r_[b, b2]


@lru_cache(2)
def tokenizer_pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Marks:
    """A packed bitset over byte places, with ranks."""

    def __init__(self, places: np.ndarray, size: int) -> None:
        bits = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marks at each place and before it."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto).astype(np.int64)


def shared_cuts(a: Marks, b: Marks) -> np.ndarray:
    """The places that both have, ascending."""
    return np.flatnonzero(np.unpackbits((a.words & b.words).view(np.uint8), bitorder="little"))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Aligner:
    """Units and what is remembered of them, by number."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.codes: list[str] = []
        #: For each unit: A tokens, B tokens, groups, links, and whether its bytes come back.
        self.figures = np.empty((0, 5), np.int64)
        #: Its distinct pairs stand from start to start, with the times that each is linked.
        self.start, self.pairs, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        units, bad, a, b = self.pair.exact_units(units)
        ends_a, ends_b = np.cumsum(self.pair.sizes_a[a]), np.cumsum(self.pair.sizes_b[b])
        unit_ends = np.cumsum(np.fromiter((len(u.encode("utf-8", "surrogatepass")) + 1 for u in units), np.int64, len(units)))
        size = int(unit_ends[-1]) if units else 0
        marks_a, marks_b = Marks(ends_a, size), Marks(ends_b, size)
        cuts = shared_cuts(marks_a, marks_b)
        to_a, to_b = marks_a.rank(cuts), marks_b.rank(cuts)
        from_a, from_b = np.r_[0, to_a[:-1]] if len(cuts) else to_a, np.r_[0, to_b[:-1]] if len(cuts) else to_b
        n_a, n_b = to_a - from_a, to_b - from_b
        unit = np.searchsorted(unit_ends, cuts)
        # Links of usual groups one by one: each A token with each B token of its group.
        usual = np.flatnonzero(n_a * n_b <= LINKS)
        of_a = ranges(from_a[usual], n_a[usual])
        group = np.repeat(usual, n_a[usual])
        left = np.repeat(a[of_a], n_b[group])
        right = b[ranges(from_b[group], n_b[group])]
        keys, weight = [np.repeat(unit[group], n_b[group]) << 31 | left << PAIR | right], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(n_a * n_b > LINKS).tolist():
            (x, p), (y, q) = (np.unique(t, return_counts=True) for t in (a[from_a[g] : to_a[g]], b[from_b[g] : to_b[g]]))
            keys.append((int(unit[g]) << 31 | x[:, None] << PAIR | y).ravel())
            weight.append((p[:, None] * q).ravel())
        key, times = summed(np.concatenate(keys), np.concatenate(weight))
        figures = np.zeros((len(units) + len(bad), 5), np.int64)
        for column, values in enumerate((n_a, n_b, np.ones(len(cuts), np.int64), n_a * n_b)):
            np.add.at(figures[:, column], unit, values)
        figures[: len(units), 4] = 1
        # Tokens in the order of the digest: of each group those of A, then those of B, each with the mark behind it.
        marks = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a - 1] = last_b[to_b - 1] = 1
        marks[np.arange(len(a)) + np.repeat(from_b, n_a)] = 2 * a + last_a
        marks[np.arange(len(b)) + np.repeat(to_a, n_b)] = 2 * (b + len(self.pair.sizes_a)) + last_b
        text = list(map(self.pair.marked.__getitem__, marks.tolist()))
        per_unit = np.cumsum(figures[: len(units), 0] + figures[: len(units), 1]).tolist()
        codes = ["".join(text[x:y]) for x, y in zip([0, *per_unit], per_unit, strict=False)]
        self.number.update(zip(itertools.chain(units, bad), range(len(self.codes), len(self.codes) + len(figures)), strict=True))
        self.codes += codes + [""] * len(bad)
        self.figures = np.concatenate([self.figures, figures])
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(np.bincount(key >> 31, minlength=len(figures)))]
        self.pairs, self.times = np.r_[self.pairs, key & ((1 << 31) - 1)], np.r_[self.times, times]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(figures, digests) of each text, and the (text, pair, times) of all distinct pairs of all texts, by text."""
        if len(self.codes) > MEMO or len(self.pairs) > 20 * MEMO:
            self._forget()
        parts = [BOUNDARY.split(t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        new = list(dict.fromkeys(p for p in flat if p not in self.number))
        for x, y in slices([len(p) for p in new], 1_000_000) if new else ():
            self._learn(new[x:y])
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(texts)), counts)
        figures = np.zeros((len(texts), 4), np.int64)
        for column in range(4):
            figures[:, column] = np.bincount(owner, self.figures[at, column], len(texts)).astype(np.int64) if self.figures[at, column].sum() < 2**52 else [int(self.figures[at[owner == i], column].sum()) for i in range(len(texts))]
        good = counts > 0
        good[owner[self.figures[at, 4] == 0]] = False
        figures[~good] = 0
        ends, codes, numbers = np.cumsum(counts), self.codes, at.tolist()
        digests = [hashlib.sha256("".join([codes[i] for i in numbers[e - n : e]])[:-1].encode()).hexdigest() if g else "" for e, n, g in zip(ends.tolist(), counts.tolist(), good.tolist(), strict=True)]
        kept = good[owner]
        at, owner = at[kept], owner[kept]
        sizes = self.start[at + 1] - self.start[at]
        place = ranges(self.start[at], sizes)
        key, times = summed(np.repeat(owner, sizes) << 31 | self.pairs[place], self.times[place])
        for p in new:
            if len(p) > LONG:  # not worth its room
                codes[self.number.pop(p)] = ""
        return figures, digests, key >> 31, key & ((1 << 31) - 1), times


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the weights of each."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    return key[heads], np.add.reduceat(weight[by], heads) if len(key) else weight


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """A worker's aligner, with what it remembers from its tasks before."""
    return Aligner(tokenizer_pair(path_a, path_b))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row of docs (doc_id, text)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in small_batches(batches, "text", 2_000_000):
            figures, digests, text, pairs, times = own.align(batch.column("text").to_pylist())
            offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs.astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(figures[:, i]) for i in range(4)], pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.mapInArrow(work, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many texts each pair is linked, and whether no pair of the same A id is in more."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more, times = np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True)
            key, n = summed(np.r_[key, more.astype(np.int64)], np.r_[n, times])
            if len(key) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n)], ["pair", "docs"])
                key, n = key[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n)], ["pair", "docs"])

    counts = written(texts.select("pairs").mapInArrow(work, "pair int, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    left = F.shiftright("pair", PAIR)
    most = counts.groupBy(left.alias("a")).agg(F.max("docs").alias("most"))  # a row for each A id at most
    return written(counts.withColumn("a", left).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counted")


def looked_up(texts: DataFrame, frequent: DataFrame, carry: list[str]) -> DataFrame:
    """texts with n_best and count_sum over the pairs in frequent (at most MOST rows), and the others' pairs and times."""
    found = frequent.orderBy("pair").toArrow()
    shared = texts.sparkSession.sparkContext.broadcast([found.column(c).to_numpy() for c in ("pair", "docs", "best")])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = shared.value
        for batch in batches:
            lists, n = batch.column("pairs"), batch.num_rows
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], owner[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], owner[hit], times[hit] * docs[at[hit]])
            offsets = pa.array(np.searchsorted(owner[~hit], np.arange(n + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(sums[0]), pa.array(sums[1]), *rest], [*carry, "n_best", "count_sum", "pairs", "times"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in carry)
    return texts.select(*carry, "pairs", "times").mapInArrow(work, f"{kinds}, n_best long, count_sum long, pairs array<int>, times array<long>")


def token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs. Both paths are read on the executors."""
    few_rows_a_batch(docs.sparkSession)
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    texts = written(aligned_texts(docs, path_a, path_b), "aligned")
    counts = pair_counts(texts)
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows, distinct = counts.agg(F.sum("docs"), F.count("*")).first()
    frequent = F.lit(True) if distinct <= MOST else F.col("docs") * MOST > rows
    out = looked_up(texts.withColumn("row", F.monotonically_increasing_id()), counts.where(frequent), ["row", *own])
    if distinct > MOST:
        out = written(out, "looked-up")
        each = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        rest = each.join(counts.where(~frequent), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
        zero = F.lit(0).cast("long")
        out = out.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", zero), "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero)})
        discard(texts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
