"""Benchmark passages in documents, by spaced-seed hashing.

Method. A seed is a fixed mask over WINDOW words or less; its hash leaves out the masked-off
words. The two masks in SEEDS are such that each window of WINDOW words with at most two
substituted words keeps one of them whole at some place (a test goes through all patterns), so
none is missed. Seed hashes of benchmark and documents are joined, and around each hit the
document is laid beside the item, shifted by the hit: windows of WINDOW words of which at least
80 % agree count as copied. An item of fewer than WINDOW words counts as a whole if at least 80 %
of its words agree (so one of less than five words must be there unchanged): it is cut into one piece
more than words may be substituted, so that one piece stays whole, and each piece is a seed of its
own length.

The benchmark is written to the shared folder in blocks of bounded size. One block at a time goes
to the executors, and what it finds is written before the next one goes: one pass over the
documents for each block. Documents are never shuffled, and each row is read whole.

Defined results: null and empty texts hold nothing; words are runs of letters, digits and marks by
Unicode class after lower-casing, and in scripts written without spaces each letter with its marks
is a word; repeated rows give one row for each (doc_id, item_id);
rows with a null id are kept apart from all others as id null; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import MEMO_WORDS, WordHashes, few_rows_a_batch, mix, slices, small_batches, tidy, written

#: Fixed masks: 1 takes the word at that place.
SEEDS = ("11101011", "11001111")
WINDOW, AGREE = 13, 0.8
#: UTF-8 bytes of benchmark text in a block.
BLOCK_BYTES = 8_000_000
#: Hits laid side by side at a time.
HITS = 200_000

APART = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes([32]) * 128
APART_KEEP = APART[:128] + bytes(range(128, 256))
#: Longer runs are not remembered.
MEMO_BYTES = 64
#: Code points of scripts written without spaces: Thai and Lao, Myanmar, Khmer, Tai Le to New Tai Lue, kana, Han.
UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]


def _ranges(codes: Iterable[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _words_pattern() -> re.Pattern[str]:
    alone = {c for a, b in UNSPACED for c in range(a, b + 1) if unicodedata.category(chr(c))[0] in "LN"}
    marks = [c for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M"] + list(range(0xE0100, 0xE01F0))
    others = [c for c in range(0x20000) if c not in alone and unicodedata.category(chr(c))[0] in "LN"]
    alone_class, mark_class = _ranges(sorted(alone)), _ranges(marks)
    return re.compile(f"[{alone_class}][{mark_class}]*|[{_ranges(others)}][{_ranges(sorted([*others, *marks]))}]*")


WORDS = _words_pattern()


class _Pieces(dict):
    """A run of bytes without ASCII but letters and digits -> the words in it, filled as runs come and emptied when it gets large."""

    def __missing__(self, run: bytes) -> list[bytes]:
        found = [w.encode("utf-8", "surrogatepass") for w in WORDS.findall(run.decode("utf-8", "surrogatepass"))]
        if len(run) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[run] = found
        return found


_pieces = _Pieces()


def plain_words(text: str | None) -> list[bytes]:
    if not text:
        return []
    if text.isascii():
        return text.encode().lower().translate(APART).split()
    # No word goes across ASCII other than letters and digits, so the pattern sees each run between once.
    out: list[bytes] = []
    for run in unicodedata.normalize("NFC", text).lower().encode("utf-8", "surrogatepass").translate(APART_KEEP).split():
        if run.isascii():
            out.append(run)
        else:
            out += _pieces[run]
    return out


def short_pieces(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of n < WINDOW words, one more than it may have substitutions."""
    pieces = n - math.ceil(AGREE * n) + 1
    cuts = [n * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def seed_hashes(h: np.ndarray, seed: str) -> np.ndarray:
    """The seed's hash at each place of the word hashes h where it fits."""
    n = len(h) - len(seed) + 1
    out = np.full(max(n, 0), np.uint64(int(seed, 2) * 64 + len(seed)))
    for i, c in enumerate(seed):
        if c == "1" and n > 0:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


class Block:
    """Some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str | None]], least_words: int = 1) -> None:
        memo = WordHashes()
        hashed = [(i, h) for i, h in ((i, memo.of(plain_words(t))) for i, t in items) if len(h) >= least_words]
        hashes = [h for _, h in hashed]
        self.ids = np.array([i for i, _ in hashed], np.int64)
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.words = np.concatenate([*hashes, np.empty(0, np.uint64)])
        keys, owner, place = [], [], []
        lengths: set[int] = set()
        for i, h in enumerate(hashes):
            if len(h) >= WINDOW:
                for seed in SEEDS:
                    s = seed_hashes(h, seed)
                    keys.append(s)
                    owner.append(np.full(len(s), i))
                    place.append(np.arange(len(s)))
                continue
            # A short item is seeds of its pieces.
            for start, n in short_pieces(len(h)) if len(h) else []:
                lengths.add(n)
                keys.append(seed_hashes(h[start : start + n], "1" * n))
                owner.append(np.full(1, i))
                place.append(np.full(1, start))
        self.keys = np.concatenate([*keys, np.empty(0, np.uint64)])
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = np.concatenate([*owner, np.empty(0, np.int64)])[order]
        self.place = np.concatenate([*place, np.empty(0, np.int64)])[order]
        self.seeds = [*SEEDS, *("1" * n for n in sorted(lengths))]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in h, item, place in item) of equal seeds that don't cross documents, some at a time."""
        for seed in self.seeds:
            s = seed_hashes(h, seed)
            at = np.flatnonzero(self.seen[(s >> np.uint64(44)).astype(np.int64)])
            at = at[doc[at] == doc[at + len(seed) - 1]]
            low = np.searchsorted(self.keys, s[at], "left")
            n = np.searchsorted(self.keys, s[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            for a, b in slices(n.tolist(), HITS) if len(n) else ():
                m = n[a:b]
                k = np.repeat(low[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
                yield np.repeat(at[a:b], m), self.owner[k], self.place[k]


def _short_copied(block: Block, h: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, found: dict[tuple[int, int], np.ndarray]) -> None:
    """Add the short items that lie whole in a document at their shift and agree there."""
    size = block.sizes[item]
    whole = (shift >= 0) & (shift + size <= len(h))
    item, shift, size = item[whole], shift[whole], size[whole]
    inside = doc[shift] == doc[shift + size - 1]
    item, shift, size = item[inside], shift[inside], size[inside]
    same = np.zeros(len(item), np.int64)
    for j in range(WINDOW - 1):
        on = np.flatnonzero(size > j)
        same[on] += h[shift[on] + j] == block.words[block.starts[item[on]] + j]
    good = same >= AGREE * size
    for d, i in np.unique(np.stack([doc[shift[good]], item[good]], axis=1), axis=0).tolist():
        found[d, i] = np.ones(int(block.sizes[i]), bool)


def _copied(block: Block, h: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], int]:
    """(document, item) -> words of the item that copied windows cover, for documents side by side in h."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    found: dict[tuple[int, int], np.ndarray] = {}
    tried: set[tuple[int, int]] = set()
    if not len(h) or not len(block.keys):
        return {}
    for at, item, place in block.hits(h, doc):
        short = block.sizes[item] < WINDOW
        _short_copied(block, h, doc, item[short], (at - place)[short], found)
        at, item, place = at[~short], item[~short], place[~short]
        shifts = np.unique(np.stack([item, at - place], axis=1), axis=0)
        for i, shift in shifts.tolist():
            # One shift of an item can lie in two documents: they are told apart by where it overlaps them.
            size, start = int(block.sizes[i]), int(block.starts[i])
            for d in np.unique(doc[max(shift, 0) : min(shift + size, len(h))]).tolist():
                if (i, shift * len(ends) + d) in tried:
                    continue
                tried.add((i, shift * len(ends) + d))
                a, b = max(shift, int(ends[d])), min(shift + size, int(ends[d + 1]))
                if b - a < WINDOW:
                    continue
                same = h[a:b] == block.words[start + a - shift : start + b - shift]
                sums = np.concatenate([[0], np.cumsum(same)])
                good = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= AGREE * WINDOW)
                if len(good):
                    cover = found.setdefault((d, i), np.zeros(size, bool))
                    for g in good.tolist():
                        cover[a - shift + g : a - shift + g + WINDOW] = True
    return {k: int(v.sum()) for k, v in found.items()}


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, item_words, copied_words, share): documents that hold a passage of an item of least_words or more, and how much of it."""
    spark = docs.sparkSession
    few_rows_a_batch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    items = written(items.withColumn("bytes", F.octet_length("text")), "benchmark")
    blocks = max(1, math.ceil((items.agg(F.sum("bytes")).first()[0] or 0) / BLOCK_BYTES))
    schema = "doc_id long, item_id long, item_words long, copied_words long"
    parts = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(sorted(map(tuple, own)))

        def work(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, memo = Block(shared.value, least_words), WordHashes()
            for batch in small_batches(batches, "text"):
                hashes = [memo.of(plain_words(t)) for t in batch.column("text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int64)
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], int(block.ids[i]), int(block.sizes[i]), n) for (d, i), n in _copied(block, np.concatenate(hashes), ends).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "item_words", "copied_words"])

        parts.append(docs.mapInArrow(tidy(work), schema))
        if blocks > 1:  # this block leaves the executors before the next one comes
            parts[-1] = written(parts[-1], "overlaps")
            shared.destroy()
    found = reduce(DataFrame.union, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("copied_words").alias("copied_words")).withColumn("share", F.round(F.col("copied_words") / F.col("item_words"), 6))
