"""SentencePiece encoding and decoding with the N best segmentations of whole texts.

Method. The pieces that match at each place of a text, with their scores in the model file, are
the edges of a lattice; a character without a piece of its own is an edge too (at the least
score minus 10) and stands for its bytes' pieces. A segmentation's score is the sum of its
edges'. Forward Viterbi gives the best score of each prefix. Backward A-star starts at the end
with those scores as heuristic; as they are exact, partial paths leave its queue in the order of
the best whole path that they are part of, and the first N that reach the start are the N best.

A lattice falls into parts between two characters that no piece has side by side, as at the start
of words: Viterbi runs over all new parts of a batch at once (numpy, place by place), forward and
backward, and gives each part's best path and by how much its second best is worse. The N best of
a text differ from its best in the N - 1 parts of least such loss only, so A-star runs over those,
and the lists are combined.

For a model file of BPE type the scores are the negative merge ranks. Their sums order the
lattice's paths but are not what BPE merging does, so the best path can differ from merging's.

Defined results: null and empty texts have no pieces and one segmentation of score 0; among
equal scores the choice is fixed but arbitrary; the mark U+2581 in a text is taken as a space, as
the library does, so only such texts don't come back whole; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sprucelake.llm.common import few_rows_a_batch, fresh, quoted, small_batches, tidy

MARK = "▁"
#: Parts of texts that a worker remembers; it starts afresh beyond.
MEMO = 100_000
#: Characters that a sweep goes over at once.
SWEEP_CHARS = 60_000
UNKNOWN_LOSS = 10.0


class Lattice:
    """The model's pieces as a trie in sorted arrays."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("a model with byte fallback, a dummy prefix and no normalisation is expected")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in proto.pieces) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("user-defined, unused or mark-crossing pieces are not supported")
        self.scores = np.array([p.score for p in proto.pieces])
        self.score_list = self.scores.tolist()
        self.unknown = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_LOSS
        self.longest = max(map(len, self.ids))
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        # Trie: state 0 is the root; an edge is (state << 21 | code point) -> state.
        states, ends, edges = {"": 0}, {}, {}
        for piece, i in self.ids.items():
            for n in range(1, len(piece) + 1):
                state = states.setdefault(piece[:n], len(states))
                edges[states[piece[: n - 1]] << 21 | ord(piece[n - 1])] = state
            ends[states[piece]] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(states), -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        # Which characters stand side by side in some piece, by numbers of theirs (0: in no piece of several).
        letters = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in self.ids:
            at = self.letter[[ord(c) for c in piece]]
            self.together[at[:-1], at[1:]] = True

    def parts(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Texts cut between characters that no piece has side by side, and the number of parts of each."""
        whole, lengths = "".join(texts), np.array([len(t) for t in texts], np.int64)
        at = self.letter[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum(lengths)
        begins = np.ones(len(at), bool)
        begins[1:] = ~self.together[at[:-1], at[1:]]
        begins[(ends - lengths)[lengths > 0]] = True
        before = np.r_[0, np.cumsum(begins)]
        cuts = [*np.flatnonzero(begins).tolist(), len(whole)]
        return [whole[a:b] for a, b in itertools.pairwise(cuts)], (before[ends] - before[ends - lengths]).tolist()

    def edges(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all edges over code points `flat`, whose segments end at `ends` (by place). Piece -1: unknown."""
        at, state, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), []
        known = np.zeros(len(flat), bool)
        for n in range(1, self.longest + 1):
            live = at + n <= ends[at]
            at, state = at[live], state[live]
            if not len(at):
                break
            key = state << 21 | flat[at + n - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, state = at[hit], self.to[place[hit]]
            piece = self.piece[state]
            whole = piece >= 0
            found.append((at[whole], np.full(whole.sum(), n), piece[whole]))
            if n == 1:
                known[at[whole]] = True
        lone = np.flatnonzero(~known)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def piece_ids(self, segment: str, path: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path of (start, length, piece)."""
        out: list[int] = []
        for start, _, piece in path:
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in segment[start].encode("utf-8", "surrogatepass")]
        return out

    def best(self, segments: list[str]) -> list[tuple[float, float, bytes]]:
        """(score, loss of the second best path, ids as int32) of each segment."""
        out: list = [None] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        a = 0
        while a < len(order):  # segments of like length, some thousands of characters at a time
            b, size = a, 0
            while b < len(order) and (b == a or size + len(segments[order[b]]) <= SWEEP_CHARS):
                size += len(segments[order[b]])
                b += 1
            part = order[a:b]
            for i, x in zip(part, self._viterbi([segments[i] for i in part]), strict=True):
                out[i] = x
            a = b
        return out

    def _viterbi(self, segments: list[str]) -> list[tuple[float, float, bytes]]:
        lengths = np.array([len(s) for s in segments])
        first = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(segments)), lengths)
        start, length, piece = self.edges(flat, first[1:][owner])
        score = np.where(piece >= 0, self.scores[piece], self.unknown)
        own = owner[start]
        source, target = start + own, start + own + length  # nodes: one more than characters in each segment
        begins = first[:-1] + np.arange(len(segments))
        n = len(flat) + len(segments)
        ahead, back = np.full(n, -np.inf), np.full(n, -np.inf)
        ahead[begins], back[begins + lengths] = 0, 0
        through = np.zeros(n, np.int64)  # the best edge into each node

        def sweep(value: np.ndarray, of: np.ndarray, into: np.ndarray, place: np.ndarray, keep: np.ndarray | None) -> None:
            by = np.argsort((place * n + into) * (self.longest + 1) - length, kind="stable")
            cuts = np.flatnonzero(np.diff(place[by], prepend=-1, append=-2))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                e = by[i:j]
                x = value[of[e]] + score[e]
                heads = np.flatnonzero(np.r_[True, into[e][1:] != into[e][:-1]])
                top = np.maximum.reduceat(x, heads)
                value[into[e][heads]] = top
                if keep is not None:
                    at = np.flatnonzero(x == np.repeat(top, np.diff(np.r_[heads, len(e)])))
                    at = at[np.r_[True, into[e][at][1:] != into[e][at][:-1]]]
                    keep[into[e][at]] = e[at]

        sweep(ahead, source, target, target - begins[own], through)
        sweep(back, target, source, (begins + lengths)[own] - source, None)
        node, paths, on = begins + lengths, [], np.zeros(len(start), bool)
        live = np.arange(len(segments))
        while len(live):
            e = through[node[live]]
            on[e] = True
            paths.append((live, e))
            node[live] = source[e]
            live = live[node[live] > begins[live]]
        total = ahead[begins + lengths]
        loss = np.full(len(segments), np.inf)
        np.minimum.at(loss, own[~on], (total[own] - ahead[source] - score - back[target])[~on])
        segment, edge = (np.concatenate(x) for x in zip(*paths, strict=True))
        by = np.lexsort((source[edge], segment))
        edge, cuts = edge[by], np.cumsum(np.bincount(segment, minlength=len(segments)))
        ids = piece[edge].astype(np.int32)
        out = []
        odd = set(segment[by][ids < 0].tolist())
        for i, (s, d, a, b) in enumerate(zip(total.tolist(), np.maximum(loss, 0).tolist(), np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True)):
            code = ids[a:b] if i not in odd else np.array(self.piece_ids(segments[i], [(int(start[e] - first[i]), 1, int(piece[e])) for e in edge[a:b]]), np.int32)
            out.append((s, d, code.tobytes()))
        return out

    def n_best(self, segment: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids) of one segment, best first: forward Viterbi, then A-star from its end."""
        size = len(segment)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            if segment[i] not in self.ids:
                into[i + 1].append((i, -1, self.unknown))
            for k in range(i + 1, min(i + self.longest, size) + 1):
                if (p := self.ids.get(segment[i:k])) is not None:
                    into[k].append((i, p, self.score_list[p]))
        ahead = [0.0] * (size + 1)
        for t in range(1, size + 1):
            ahead[t] = max(ahead[s] + w for s, _, w in into[t])
            into[t].sort(key=lambda e: (-(ahead[e[0]] + e[2]), e[0]))
        # A state is a partial path (node, score so far, rest of the path) or a place in a node's
        # sorted edges: a path's next sibling is offered when the path is taken. Nearer the start comes first.
        found: list[tuple[float, bytes]] = []
        tick = 0
        queue: list = [(-ahead[size], size, tick, 0.0, -1, size, None)]

        def offer(node: int, done: float, k: int, rest) -> None:
            nonlocal tick
            if k < len(into[node]):
                s, _, w = into[node][k]
                tick += 1
                heapq.heappush(queue, (-(ahead[s] + w + done), s, tick, done, k, node, rest))

        while queue and len(found) < n:
            low, at, _, done, k, node, rest = heapq.heappop(queue)
            if k >= 0:
                offer(node, done, k + 1, rest)
                s, p, w = into[node][k]
                rest, done = ((s, node - s, p), rest), done + w
            if at == 0:
                path, x = [], rest
                while x:
                    path.append(x[0])
                    x = x[1]
                found.append((-low, np.array(self.piece_ids(segment, path), np.int32).tobytes()))
            else:
                offer(at, done, 0, rest)
        return found


@lru_cache(2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


class Encoder:
    """Whole texts to their n best segmentations."""

    def __init__(self, model: Lattice, n: int) -> None:
        self.model, self.n = model, n
        self._forget()

    def _forget(self) -> None:
        """What is remembered of parts: number -> score and loss of its best path, whose ids stand from start to start."""
        self.number: dict[str, int] = {}
        self.score, self.loss = np.empty(0), np.empty(0)
        self.start, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)
        self.lists: dict[str, list[tuple[float, bytes]]] = {}

    def _learn(self, parts: list[str]) -> None:
        scores, losses, codes = zip(*self.model.best(parts), strict=True)
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))
        self.score, self.loss = np.r_[self.score, scores], np.r_[self.loss, losses]
        self.start = np.r_[self.start, self.start[-1] + np.cumsum([len(c) // 4 for c in codes])]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(codes), np.int32)]

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[float, bytes, list]]]:
        """For each text (score, ids as int32, changes), best first; changes (start, end, ids as int32) make it from the best, in bytes of its ids."""
        if len(self.number) > MEMO or len(self.ids) > 20 * MEMO or len(self.lists) > MEMO // 20:
            self._forget()
        parts, counts = self.model.parts([MARK + t.replace(" ", MARK) if t else "" for t in texts])
        if new := list(dict.fromkeys(p for p in parts if p not in self.number)):
            self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        sizes = self.start[at + 1] - self.start[at]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.ids[np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        scores, losses, a = self.score[at], self.loss[at], 0
        for n in counts:
            own = slice(a, a + n)
            yield self._text(parts[own], float(scores[own].sum()), losses[own], ends[a : a + n + 1] - ends[a], ids[ends[a] : ends[a + n]].tobytes())
            a += n

    def _text(self, parts: list[str], total: float, loss: np.ndarray, ends: np.ndarray, best: bytes) -> list[tuple[float, bytes, list]]:
        out: list[tuple[float, bytes, list]] = [(total, best, [])]
        if self.n < 2 or not parts:
            return out
        # The n best of all choices of loss, over the parts that lose least.
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        few = np.argsort(loss, kind="stable")[: self.n - 1] if len(loss) < 64 else np.argpartition(loss, self.n - 1)[: self.n - 1]
        for i in few[loss[few] < np.inf].tolist():
            w = parts[i]
            if w not in self.lists:
                self.lists[w] = self.model.n_best(w, self.n)
            top = self.lists[w][0][0]
            x, y = 4 * int(ends[i]), 4 * int(ends[i + 1])
            # The list's order among equal scores is its own: the best path comes first here too.
            others = [(top - s, (x, y, code)) for s, code in self.lists[w] if code != best[x:y]][: self.n - 1]
            choices = heapq.nsmallest(self.n, [*choices, *((lost + more, (*did, swap)) for lost, did in choices for more, swap in others)], key=lambda c: (c[0], len(c[1])))
        for lost, did in choices[1:]:
            made, place = [], 0
            changes = sorted(did)
            for x, y, code in changes:
                made += [best[place:x], code]
                place = y
            out.append((total - lost, b"".join([*made, best[place:]]), changes))
        return out


@lru_cache(2)
def encoder(path: str, n: int) -> Encoder:
    """A worker's encoder, with what it remembers from its tasks before."""
    return Encoder(lattice(path), n)


def decode(ids: Iterable[int], model: Lattice) -> str:
    """The text of pieces' ids; bytes that form no character become U+FFFD."""
    text = b"".join(map(model.bytes.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


RESULT = "ids array<int>, n_pieces long, score double, ids_sha256 string, n_best array<struct<score: double, n_pieces: bigint, ids_sha256: string, changes: array<struct<at: int, n: int, ids: array<int>>>>>, back boolean"


def changed(ids: Column, changes: Column) -> Column:
    """The ids of one of n_best: those of the best with its changes made."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("place"))
    done = F.aggregate(changes, start, lambda a, c: F.struct(F.concat(a["out"], F.slice(ids, a["place"] + 1, c["at"] - a["place"]), c["ids"]).alias("out"), (c["at"] + c["n"]).alias("place")))
    return F.concat(done["out"], F.slice(ids, done["place"] + 1, F.size(ids) - done["place"]))


def _lists(codes: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(c) // 4 for c in codes])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), np.int32)))


def _structs(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _nested(rows: list[list], inner: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32()), inner)


def encoded(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, ids, n_pieces, score, ids_sha256, n_best, back) for each row of docs.

    ids: the best segmentation. n_best: of each of the n best, the best first, its score, pieces,
    the digest of its ids (little-endian int32) and the changes that make it from the best: at
    place `at` of ids, `n` ids give way to `ids` (see changed()). back: decoding the best gives the text.
    With carry, all columns of docs and these in one struct `pieces` (with a mark behind its name if that is taken).
    """
    few_rows_a_batch(docs.sparkSession)
    fields = docs.schema.fields if carry else [docs.schema[id_col]]
    own = fresh([f.name for f in fields], "pieces")
    # Positions stand for names on the way, so that none can clash.
    rows = docs.select(quoted(text_col).cast("string").alias("text"), *[quoted(f.name).alias(f"c{i}") for i, f in enumerate(fields)])
    result = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)], StructField("pieces", StructType.fromDDL(RESULT))])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path)
        own_encoder = encoder(model_path, n)
        for batch in small_batches(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            found = list(own_encoder.encode(texts))
            back = [decode(np.frombuffer(f[0][1], np.int32).tolist(), model) == (text or "") for text, f in zip(texts, found, strict=True)]
            each = [x for f in found for x in f]
            changes = [c for _, _, x in each for c in x]
            scores, sizes, digests = pa.array([s for s, _, _ in each], pa.float64()), pa.array([len(c) // 4 for _, c, _ in each], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for _, c, _ in each], pa.string())
            swaps = _structs({"at": pa.array([x // 4 for x, _, _ in changes], pa.int32()), "n": pa.array([(y - x) // 4 for x, y, _ in changes], pa.int32()), "ids": _lists([c for *_, c in changes])})
            best = pa.array(np.cumsum([0] + [len(f) for f in found])[:-1], pa.int64())
            n_best = _nested(found, _structs({"score": scores, "n_pieces": sizes, "ids_sha256": digests, "changes": _nested([x for *_, x in each], swaps)}))
            pieces = {"ids": _lists([f[0][1] for f in found]), "n_pieces": sizes.take(best), "score": scores.take(best), "ids_sha256": digests.take(best), "n_best": n_best, "back": pa.array(back, pa.bool_())}
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _structs(pieces)], [f.name for f in result])

    out = rows.mapInArrow(tidy(work), result)
    if carry:
        return out.toDF(*[f.name for f in fields], own)
    return out.select(F.col("c0").alias("doc_id"), "pieces.*")
