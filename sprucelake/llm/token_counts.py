"""Token counts of whole texts under a byte-fallback BPE model, by rank-synchronous merging.

Method. Texts are cut into pre-tokens (a run of word marks and what follows it), across which
no piece of the model reaches; this is checked when the model is loaded. The pre-tokens of a
batch that are new to the worker stand as ragged numpy arrays of symbols: one flat array,
one row of it for each. In each round every row merges its lowest-rank pair, all rows at once; rows
without a pair that is a piece leave. A row merges all places of that pair at once (from the left,
without overlap) if the piece that it makes is in no pair of lower or equal rank, so that nothing could
come between these merges; else the leftmost place only. What survives is counted, a symbol that is no
piece as its UTF-8 bytes. A pre-token of more than LONG characters, as in scripts without spaces,
is first cut between characters that no piece has side by side, as no merge crosses these.

Defined results: null and empty texts have no tokens; special strings inside texts are ordinary
text; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import few_rows_a_batch, slices, small_batches

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Pre-tokens of more characters are cut where no piece can cross.
LONG = 64
#: Characters that a series of rounds goes over.
ROUND_CHARS = 500_000
#: A worker's memo of pre-tokens is emptied at this size.
MEMO = 400_000
NONE = np.int64(1 << 60)


class PieceModel:
    """The pieces that merges may form, with ranks (0 is merged first), as sorted pair tables.

    Symbols are the numbers of pieces; -1 stands for a character that is none.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is expected")
        pieces = [p for p in proto.pieces if p.type == 1]
        if any(p.type in (4, 5) for p in proto.pieces) or any(MARK in p.piece.lstrip(MARK) for p in pieces):
            raise ValueError("user-defined, unused or mark-crossing pieces are not supported")
        if not {c for p in pieces for c in p.piece} <= {p.piece for p in pieces}:
            raise ValueError("each character of a piece must be a piece")
        # Equal scores are one rank: the leftmost of their pairs merges first.
        levels = {s: i for i, s in enumerate(sorted({p.score for p in pieces}, reverse=True))}
        self.rank = {p.piece: levels[p.score] for p in pieces}
        self.symbols: dict[str, int] = {}
        for p in self.rank:
            self.symbols.setdefault(p, len(self.symbols))
        pairs = [(self.symbols[a], self.symbols[b], r, self.symbols[p]) for p, r in self.rank.items() for i in range(1, len(p)) if (a := p[:i]) in self.symbols and (b := p[i:]) in self.symbols]
        keys = np.array([a << 32 | b for a, b, _, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for *_, r, _ in pairs], np.int64)[order]
        self.merged = np.array([s for *_, s in pairs], np.int64)[order]
        # A piece is apart if all pairs that it is in have a higher rank than itself.
        lowest = np.full(len(self.symbols), NONE)
        for side in (0, 1):
            np.minimum.at(lowest, np.array([x[side] for x in pairs], np.int64), np.array([x[2] for x in pairs], np.int64))
        self.apart = lowest > np.array([self.rank[p] for p in self.symbols], np.int64)
        # Which characters stand side by side in some piece, by numbers of theirs (0: in no piece of several).
        letters = sorted({c for p in self.rank if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in self.rank:
            at = self.letter[[ord(c) for c in piece]]
            self.together[at[:-1], at[1:]] = True

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank NONE where it forms no piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        cut = [[w] if len(w) <= LONG else self._parts(w) for w in words]
        parts = list(dict.fromkeys(p for c in cut for p in c))
        parts.sort(key=len)  # rows of like length leave the rounds together
        tokens = {}
        for a, b in slices([len(p) for p in parts], ROUND_CHARS) if parts else ():
            tokens.update(zip(parts[a:b], self._rounds(parts[a:b]).tolist(), strict=True))
        return [sum(map(tokens.__getitem__, c)) for c in cut]

    def _parts(self, word: str) -> list[str]:
        at = self.letter[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.together[at[:-1], at[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in itertools.pairwise(cuts)]

    def _rounds(self, words: list[str]) -> np.ndarray:
        lengths = np.array([len(w) for w in words])
        extra = np.array([sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in w if c not in self.rank) for w in words])
        symbols = {c: self.symbols.get(c, -1) for c in set("".join(words))}
        flat = np.fromiter((symbols[c] for w in words for c in w), np.int64, lengths.sum())
        row = np.repeat(np.arange(len(words)), lengths)
        total = lengths + extra  # a character that is no piece costs its bytes; merges take one off each
        rank, merged = self._pairs(flat, row)
        while len(flat):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(rank, starts)
            alive = best < NONE
            if not alive.all():
                keep = np.repeat(alive, np.diff(np.r_[starts, len(row)]))
                flat, row, rank, merged = flat[keep], row[keep], rank[keep], merged[keep]
                continue
            least = np.flatnonzero(rank == np.repeat(best, np.diff(np.r_[starts, len(row)])))
            heads = np.flatnonzero(np.r_[True, row[least][1:] != row[least][:-1]])
            sizes = np.diff(np.r_[heads, len(least)])
            if len(heads) < len(least):
                # All places of a row at once if its piece is apart; of places that overlap every other one.
                first = np.zeros(len(least), bool)
                first[heads] = True
                run = np.r_[True, np.diff(least) > 1] | first
                place = np.arange(len(least)) - np.maximum.accumulate(np.where(run, np.arange(len(least)), 0))
                every = np.repeat(np.logical_and.reduceat(self.apart[merged[least]], heads), sizes)
                at = least[first | (every & (place % 2 == 0))]
            else:
                at = least
            np.subtract.at(total, row[at], 1)
            flat[at] = merged[at]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # a place loses one for each merge before it
            flat, row, rank, merged = flat[keep], row[keep], rank[keep], merged[keep]
            for near in (moved, moved[moved > 0] - 1):
                last = near + 1 >= len(flat)
                nxt = np.where(last, near, near + 1)
                rank[near], merged[near] = self._look(flat[near], flat[nxt])
                rank[near] = np.where(last | (row[nxt] != row[near]), NONE, rank[near])
        return total

    def _pairs(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(flat), NONE), np.zeros(len(flat), np.int64)
        if len(flat) > 1:
            r, m = self._look(flat[:-1], flat[1:])
            rank[:-1], merged[:-1] = np.where((row[1:] == row[:-1]) & (flat[:-1] >= 0) & (flat[1:] >= 0), r, NONE), m
        return rank, merged


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class TokenCounter(dict):
    """pre-token -> tokens, filled for a batch at a time."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def count(self, texts: list[str | None]) -> list[int]:
        found = [PRE_TOKEN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self) > MEMO:
            self.clear()
        new = list({w for words in found for w in words if w not in self})
        self.update(zip(new, self.model.counts(new), strict=True))
        get = self.__getitem__
        out = [sum(map(get, words)) for words in found]
        for w in [w for w in new if len(w) > LONG]:  # long ones are not worth their room
            del self[w]
        return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs. model_path is read on the executors."""
    few_rows_a_batch(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(piece_model(model_path))
        for batch in small_batches(batches, "text"):
            texts = batch.column("text")
            n = np.array(counter.count(texts.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
