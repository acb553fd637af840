"""Repeated strings across documents, by suffix sorting with a difference cover.

A byte is removed when a string of LENGTH bytes that covers it also starts in a document of
smaller id.

Method. The difference-cover algorithm modulo 3 sorts suffixes: suffixes at places 1 and 2 modulo
3 by triples, the triples' names again by the same algorithm, the remaining suffixes by their
first byte and the rank behind it; both are merged. Neighbours in that order whose first LENGTH
bytes are equal form runs, and in a run all windows but those of its smallest document go.

Distribution. Sorting all suffixes of a corpus at once would shuffle some twenty bytes for each
byte of text at every level of the recursion. But windows that are equal have the same minimizer,
the K-byte string of least hash inside them, at the same place. So the windows are dealt by
minimizer: those that share one meet, and each group of minimizers sorts the suffixes of its own
stretches of text. Only minimizers that occur in several documents are dealt: first every parcel
of documents sends its distinct minimizers, Golomb-coded, to owners, which answer with those that
another document has too. Of a minimizer that a parcel has often, the owner gets one entry from that
parcel, however many places it has there: these wait in a row of the parcel's own for the answer. A
minimizer at very many places (a line on every page) is dealt by whole windows, so that no group to
sort grows with what stands around it, and what repeats inside a parcel is settled there and not
sent. So what an owner or a group holds for one string grows with the parcels that have it.

Defined results: null and empty texts and texts below LENGTH bytes lose nothing; equal texts of
larger id go whole, rows that repeat an id never count against each other; rows with a null id
neither lose anything nor count for others; extra columns are ignored. Texts are UTF-8 bytes, and
what is left need not be UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import discard, few_rows_a_batch, join_groups, mix, small, small_batches, written
from sprucelake.llm.exact_dedup import golomb_decode, golomb_encode

LENGTH = 50
#: Bytes of a minimizer, bits of its name, and bits that it is chosen by: the chosen are the least, so these don't spread evenly.
K, BITS, CHOICE = 20, 48, 40
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))
#: Windows whose minimizers are found at once.
STEP = 1 << 15
#: Bytes of text in a parcel; a longer text is cut, with an overlap that keeps every window.
PARCEL = 3_000_000
#: Minimizers of one owner (of at most so many owners) and bytes of text in one group to sort, on average.
OWNER_ENTRIES, MOST_OWNERS, GROUP_BYTES = 1_000_000, 100_000, 3_000_000
#: A minimizer at so many places is dealt by windows.
HOT = 5000
#: Of a minimizer at so many places of a parcel, only the number of places is sent.
STAY = 4


def _key(*columns: np.ndarray) -> np.ndarray:
    """One number for each row of columns of whole numbers >= 0, in the rows' order."""
    out, bits = columns[0], int(columns[0].max(initial=0)).bit_length()
    for c in columns[1:]:
        more = int(c.max(initial=0)).bit_length()
        if bits + more > 63:  # names take the place of what is there so far
            out = np.unique(out, return_inverse=True)[1]
            bits = int(out.max(initial=0)).bit_length()
        out, bits = (out << more) | c, bits + more
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of s (whole numbers above 0) in their order: difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    at = np.arange(n + (n % 3 == 1))  # with the empty suffix, if the class of 1 would not end in a 0 else
    sample = np.concatenate([at[at % 3 == 1], at[at % 3 == 2]])
    triple = _key(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(triple)
    new = np.r_[True, triple[order][1:] != triple[order][:-1]]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    again = not new.all()
    del at, triple, new
    if again:
        del order  # as little as possible stays while the names are sorted
        order = suffix_array(names)  # names are the symbols of a shorter text
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    first = sample[order]
    first = first[first < n]
    # The rest: by their own symbol and the rank behind it.
    single = _key(t[:n], rank[1 : n + 1])
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(single[rest])]
    # Merged: how many suffixes of either class of the sample come before each of the rest.
    double = _key(t[:n], t[1 : n + 1], rank[2 : n + 2])
    one, two = first[first % 3 == 1], first[first % 3 == 2]
    mine = np.searchsorted(single[one], single[rest]) + np.searchsorted(double[two], double[rest]) + np.arange(len(rest))
    out = np.empty(n, np.int64)
    out[mine] = rest
    taken = np.zeros(n, bool)
    taken[mine] = True
    out[~taken] = first
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For the window starts in suffix order: whether each window equals the one before it."""
    at = order[starts[order]]
    same = np.ones(max(len(at) - 1, 0), bool)
    words = np.zeros(len(text), np.uint64)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64) & np.uint64(255)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(text)]
    for shift in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        x = words[at + shift]
        same &= x[1:] == x[:-1]
    return np.r_[False, same] if len(at) else same


def _keys(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the K-byte string at each place, and for each window its minimizer's hash (CHOICE bits) and place."""
    h = BYTE_HASH[text]
    width = 1
    while width * 2 <= K:
        h = mix(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    if width < K:
        h = mix(h[: len(h) - (K - width)] * np.uint64(0xC2B2AE3D27D4EB4F) + h[K - width :])
    key = (h >> np.uint64(64 - CHOICE) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    wide, width = LENGTH - K + 1, 1
    while width * 2 <= wide:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < wide:
        key = np.minimum(key[: len(key) - (wide - width)], key[wide - width :])
    return h, key


def runs(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimizer's place, its name) of texts side by side, where texts end at `ends`.

    Neighbouring windows with one minimizer are one run; windows that cross an end have none.
    """
    n = len(text) - LENGTH + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none
    h, key = np.empty(n + LENGTH - K, np.uint64), np.empty(n, np.uint64)
    for c in range(0, n, STEP):  # a stretch at a time stays in the processor's cache
        x, y = _keys(text[c : c + STEP + LENGTH - 1])
        h[c : c + len(x)], key[c : c + len(y)] = x, y + np.uint64(c)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(inside)
    key = key[at]
    heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else none
    tails = np.r_[heads[1:] - 1, len(at) - 1] if len(at) else none
    place = (key[heads] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return at[heads], at[tails], place, (mix(h[place]) >> np.uint64(64 - BITS)).astype(np.int64)


class Parcel:
    """Some documents side by side, in the order of their ids, and their runs."""

    def __init__(self, ids: list[int], names: list[int], texts: list[bytes]) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i], names[i]))
        doc, base, parts = [], [], []
        for k, d in enumerate(order):
            if k and (ids[d], names[d]) == (ids[order[k - 1]], names[order[k - 1]]):
                continue  # a row that is repeated
            for a in range(0, max(1, len(texts[d]) - LENGTH + 1), PARCEL):
                doc.append(d)
                base.append(a)
                parts.append(texts[d][a : a + PARCEL + LENGTH - 1])
        self.ids, self.names = np.array(ids, np.int64), np.array(names, np.int64)
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        number = np.zeros(len(ids), np.int64)
        # Parts of about PARCEL bytes at a time.
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= PARCEL):
                size += len(parts[j])
                j += 1
            text = np.frombuffer(b"".join(parts[i:j]), np.uint8)
            ends = np.cumsum([len(p) for p in parts[i:j]])
            a, b, at, h = runs(text, ends)
            part = np.searchsorted(ends, a, "right")
            begin = np.r_[0, ends[:-1]]
            owner = np.array(doc[i:j], np.int64)[part]
            shift = np.array(base[i:j], np.int64)[part] - begin[part]
            cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=j - i))]
            ordinal = np.arange(len(a)) - cuts[part] + number[owner] if len(set(doc[i:j])) == j - i else None
            if ordinal is None:  # several parts of one text
                ordinal = np.empty(len(a), np.int64)
                for p in range(j - i):
                    d = doc[i + p]
                    ordinal[cuts[p] : cuts[p + 1]] = np.arange(cuts[p + 1] - cuts[p]) + number[d]
                    number[d] += cuts[p + 1] - cuts[p]
            else:
                np.add.at(number, owner, 1)
            for x, y in zip(found, (owner, ordinal, a + shift, b + shift, at + shift, h), strict=True):
                x.append(y)
            i = j
        self.doc, self.ordinal, self.a, self.b, self.at, self.hash = (np.concatenate([*x, np.empty(0, np.int64)]) for x in found)
        self.bytes = texts
        self.number = xxhash.xxh3_64_intdigest(self.ids.tobytes() + self.names.tobytes()) >> 1


def parcels(batches: Iterable[pa.RecordBatch], needed: str | None = None) -> Iterator[tuple[pa.RecordBatch, Parcel]]:
    """Parcels of the rows whose column `needed` is not null."""
    for batch in small_batches(batches, "text", PARCEL):
        if needed:
            batch = batch.filter(pc.is_valid(batch.column(needed)))
        yield batch, Parcel(batch.column("doc_id").to_pylist(), batch.column("name").to_pylist(), [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.uint16 if x.max(initial=0) < 65536 else np.uint32).tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32).astype(np.int64)


def _announce(owners: int):
    """Parcels -> for each owner the parcel's distinct minimizers, and for the parcel itself the places of those that it has often."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, p in parcels(batches):
            order = np.argsort(p.hash)
            h, doc, ordinal = p.hash[order], p.doc[order], p.ordinal[order]
            if not len(h):
                continue
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            members = np.diff(np.r_[heads, len(h)])
            several = np.maximum.reduceat(doc, heads) != np.minimum.reduceat(doc, heads)
            stays = members >= STAY
            here = np.repeat(stays, members)
            owner = h[heads] * owners >> BITS
            cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
            rows = [(p.number, -1 - p.number, 0, int(stays.sum()), int(here.sum()), 0, h[heads[stays]].tobytes(), _narrow(members[stays]), b"", p.ids.tobytes(), p.names.tobytes(), _narrow(doc[here]), _narrow(ordinal[here]))]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                o = int(owner[i])
                base = -(-(o << BITS) // owners)
                code, low = golomb_encode(h[heads[i:j]] - base, (1 << BITS) // owners + 1)
                a, b = heads[i], heads[j] if j < len(heads) else len(h)
                sent = a + np.flatnonzero(~here[a:b])
                rows.append((p.number, o, base, j - i, len(sent), low, code, _narrow(members[i:j]), np.packbits(several[i:j][stays[i:j]]).tobytes(), b"", b"", _narrow(doc[sent]), _narrow(ordinal[sent])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ANNOUNCED.values(), strict=True)], list(ANNOUNCED))

    return work


#: owner below 0: a parcel's own row, whose code is its frequent minimizers' names as they are.
ANNOUNCED = {"parcel": pa.int64(), "owner": pa.int64(), "base": pa.int64(), "n": pa.int64(), "total": pa.int64(), "low": pa.int32(), "code": pa.binary(), "members": pa.binary(), "several": pa.binary(), "ids": pa.binary(), "names": pa.binary(), "doc": pa.binary(), "ordinal": pa.binary()}
ANNOUNCED_SQL = "parcel long, owner long, base long, n long, total long, low int, code binary, members binary, several binary, ids binary, names binary, doc binary, ordinal binary"
ANSWERED_SQL = "parcel long, own boolean, n long, total long, code binary, members binary, ids binary, names binary, doc binary, ordinal binary, hot binary"


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's lists -> to each parcel which of its minimizers another document has too, and which are hot.

    Places that were sent come back (doc, ordinal), of minimizers whose places stayed the names (code); `hot` has a
    bit for each place and then for each name. A parcel's own row goes on as it is.
    """
    if pdf["owner"].iloc[0] < 0:
        return pdf.assign(own=True, hot=b"")[ANSWERED]
    lists = [golomb_decode(c, n, low) for c, n, low in zip(pdf["code"], pdf["n"], pdf["low"], strict=True)]
    merged, group = np.unique(np.concatenate(lists), return_inverse=True)
    sent = np.bincount(group, minlength=len(merged))
    members = [_wide(m, n) for m, n in zip(pdf["members"], pdf["n"], strict=True)]
    total = np.bincount(group, np.concatenate(members), len(merged))
    rows, done = [], 0
    for r, m in zip(pdf.itertuples(), members, strict=True):
        own = group[done : done + r.n]
        done += r.n
        doc, ordinal = _wide(r.doc, r.total), _wide(r.ordinal, r.total)
        few = m < STAY
        several = np.empty(r.n, bool)
        several[~few] = np.unpackbits(np.frombuffer(r.several, np.uint8), count=int((~few).sum()))
        if few.any():
            heads = np.cumsum(m[few]) - m[few]
            several[few] = np.maximum.reduceat(doc, heads) != np.minimum.reduceat(doc, heads)
        shared, hot = (sent[own] > 1) | several, total[own] >= HOT
        if shared.any():
            places, names = np.repeat(shared[few], m[few]), shared & ~few
            bits = np.r_[np.repeat(hot[few], m[few])[places], hot[names]]
            rows.append((r.parcel, False, int(names.sum()), int(places.sum()), (merged[own[names]] + r.base).tobytes(), b"", b"", b"", _narrow(doc[places]), _narrow(ordinal[places]), np.packbits(bits).tobytes()))
    return pd.DataFrame(rows, columns=ANSWERED)


ANSWERED = [c.split()[0] for c in ANSWERED_SQL.split(", ")]


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """All answers to one parcel and its own row -> (id, name, number and ordinals of shared minimizers, those of hot ones) of its documents."""
    doc, ordinal, hot, shared, warm = ([np.empty(0, t)] for t in (np.int64, np.int64, bool, np.int64, bool))
    for r in pdf[~pdf["own"]].itertuples():
        bits = np.unpackbits(np.frombuffer(r.hot, np.uint8), count=r.total + r.n).astype(bool)
        for x, y in ((doc, _wide(r.doc, r.total)), (ordinal, _wide(r.ordinal, r.total)), (hot, bits[: r.total]), (shared, np.frombuffer(r.code, np.int64)), (warm, bits[r.total :])):
            x.append(y)
    name, first = np.unique(np.concatenate(shared), return_index=True)
    is_warm = np.concatenate(warm)[first]
    mine = pdf[pdf["own"]]
    for r in mine.itertuples():
        h = np.repeat(np.frombuffer(r.code, np.int64), _wide(r.members, r.n))
        found = np.isin(h, name)
        for x, y in ((doc, _wide(r.doc, r.total)[found]), (ordinal, _wide(r.ordinal, r.total)[found]), (hot, is_warm[np.searchsorted(name, h[found])])):
            x.append(y)
    doc, ordinal, hot = (np.concatenate(x) for x in (doc, ordinal, hot))
    ids, names = (np.frombuffer(mine[c].iloc[0], np.int64) for c in ("ids", "names"))
    order = np.lexsort((ordinal, doc))
    doc, ordinal, hot = doc[order], ordinal[order].astype(np.uint32), hot[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, np.int64)
    rows = [(ids[doc[i]], names[doc[i]], j - i, ordinal[i:j].tobytes(), ordinal[i:j][hot[i:j]].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame(rows, columns=["doc_id", "name", "n", "shared", "hot"])


def _deal(groups: int):
    """Documents with their shared ordinals -> stretches of text for each group; kind 1: windows settled inside the parcel."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in parcels(batches, "shared"):
            most = int(p.ordinal.max(initial=0)) + 1
            wanted, hot = (np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + d * most for d, lists in enumerate(batch.column(c).to_pylist()) for x in lists or ()] or [np.empty(0, np.int64)]) for c in ("shared", "hot"))
            at = np.flatnonzero(np.isin(p.doc * most + p.ordinal, wanted))
            is_hot = np.isin(p.doc[at] * most + p.ordinal[at], hot)
            group = ((mix(p.hash[at].astype(np.uint64)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).tolist()
            seen: dict[bytes, int] = {}
            to, docs, starts, parts = [], [], [], []
            settled: list[tuple[int, int, int]] = []
            doc = p.doc[at]
            for d, own, a, b, g, warm in zip(doc.tolist(), p.ids[doc].tolist(), p.a[at].tolist(), p.b[at].tolist(), group, is_hot.tolist(), strict=True):
                text = p.bytes[d]
                # A hot minimizer's windows go one by one, dealt by their bytes.
                for x, y in ((w, w) for w in range(a, b + 1)) if warm else ((a, b),):
                    part = text[x : y + LENGTH]
                    if seen.setdefault(part, own) < own:  # ids ascend
                        settled.append((d, x, y))
                    else:
                        to.append(xxhash.xxh3_64_intdigest(part) * groups >> 64 if warm else g)
                        docs.append(d)
                        starts.append(x)
                        parts.append(part)
            order = np.argsort(np.array(to, np.int64), kind="stable")
            to, docs, starts = (np.array(x, np.int64)[order] for x in (to, docs, starts))
            cuts, rows = np.flatnonzero(np.diff(to, prepend=-1, append=-1)), []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = [parts[k] for k in order[i:j].tolist()]
                rows.append((int(to[i]), 0, p.ids[docs[i:j]].tobytes(), p.names[docs[i:j]].tobytes(), starts[i:j].tobytes(), np.array([len(x) for x in own], np.int64).tobytes(), b"".join(own)))
            if settled:
                d, x, y = (np.array(c, np.int64) for c in zip(*settled, strict=True))
                rows.append((int(p.ids[0]) % groups, 1, p.ids[d].tobytes(), p.names[d].tobytes(), x.tobytes(), y.tobytes(), b""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DEALT.values(), strict=True)], list(DEALT))

    return work


DEALT = {"grp": pa.int32(), "kind": pa.int32(), "ids": pa.binary(), "names": pa.binary(), "starts": pa.binary(), "sizes": pa.binary(), "blob": pa.binary()}
DEALT_SQL = "grp int, kind int, ids binary, names binary, starts binary, sizes binary, blob binary"


def _sorted_runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window's start in its document) of each window that a smaller document has too."""
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    text[inner] = np.frombuffer(blob, np.uint8).astype(np.int64) + 1
    text[ends - 1] = 257 + np.arange(len(sizes))  # each stretch ends unlike any other
    del inner
    order = suffix_array(text)
    text = (text - 1).astype(np.uint8)
    stretch = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(text)) - (ends - sizes - 1)[stretch]
    windows = place <= (sizes - LENGTH)[stretch]
    same = equal_windows(text, windows, order)
    at = order[windows[order]]
    del order
    heads = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(ids[stretch[at]], heads), np.diff(np.r_[heads, len(at)]))
    gone = at[ids[stretch[at]] > least]
    return stretch[gone], starts[stretch[gone]] + place[gone]


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's stretches -> first and last of neighbouring windows to remove, by document."""
    ids, names, a, b = [], [], [], []
    of = lambda rows, c: np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]])
    done, rest = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 0]
    if len(done):
        ids, names, a, b = [of(done, "ids")], [of(done, "names")], [of(done, "starts")], [of(done, "sizes")]
    if len(rest):
        own, name, start, size = (of(rest, c) for c in ("ids", "names", "starts", "sizes"))
        blob, at = b"".join(rest["blob"]), np.cumsum(size) - size
        # Equal stretches: that of the smallest document is sorted, those of others go whole.
        seen: dict[bytes, int] = {}
        kept, whole, parts = [], [], []
        for i in np.argsort(own, kind="stable").tolist():
            part = blob[at[i] : at[i] + size[i]]
            if own[seen.setdefault(part, i)] < own[i]:
                whole.append(i)
            else:
                kept.append(i)
                parts.append(part)
        ids.append(own[whole])
        names.append(name[whole])
        a.append(start[whole])
        b.append(start[whole] + size[whole] - LENGTH)
        own, name, start, size = own[kept], name[kept], start[kept], size[kept]
        stretch, window = _sorted_runs(own, start, size, b"".join(parts))
        order = np.lexsort((window, stretch))
        stretch, window = stretch[order], window[order]
        if len(window):
            head = np.r_[True, (stretch[1:] != stretch[:-1]) | (window[1:] != window[:-1] + 1)]
            tail = np.r_[head[1:], True]
            ids.append(own[stretch[head]])
            names.append(name[stretch[head]])
            a.append(window[head])
            b.append(window[tail])
    join = lambda x: np.concatenate([*x, np.empty(0, np.int64)])
    return pd.DataFrame({"id": join(ids), "name": join(names), "a": join(a), "b": join(b)})


def _left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows with the windows to remove -> what is removed and left."""
    for batch in small_batches(batches, "text", PARCEL):
        rows = []
        gone = batch.column("gone")
        offsets, none = gone.offsets.to_numpy().tolist(), gone.is_null().to_numpy(zero_copy_only=False).tolist()
        a, b = (gone.values.field(i).to_numpy().tolist() for i in range(2))
        for k, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            i, j = offsets[k : k + 2]
            for x, y in sorted(zip(a[i:j], b[i:j], strict=True)) if not none[k] else ():
                if spans and x <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], y + LENGTH)
                else:
                    spans.append([x, y + LENGTH])
            left, place = hashlib.sha256(), 0
            for x, y in spans:
                left.update(raw[place:x])
                place = y
            left.update(raw[place:])
            rows.append((doc, len(raw), sum(y - x for x, y in spans), len(spans), left.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    spark = docs.sparkSession
    few_rows_a_batch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("name"))
    long = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))

    # Equal texts: only the one of smallest id goes on; the others go whole.
    print_ = F.unhex(F.sha2("text", 256))
    prints = written(long.select("doc_id", "name", print_.alias("print"), F.octet_length("text").alias("n")), "prints")
    first = written(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1"), "first")
    copies = written(join_groups(prints, first, ["print"], "rows", prints.count()).where("doc_id > first").select(F.col("doc_id").alias("id"), "name", F.lit(0).cast("long").alias("a"), (F.col("n") - LENGTH).cast("long").alias("b")).distinct(), "copies")
    once = long.join(small(copies.select(F.col("id").alias("doc_id"), "name")), ["doc_id", "name"], "left_anti")
    size = prints.agg(F.sum("n")).first()[0] or 0

    owners = min(MOST_OWNERS, int(size * 2 / (LENGTH - K + 2) / OWNER_ENTRIES) + 1)
    announced = once.mapInArrow(_announce(owners), ANNOUNCED_SQL)
    answers = announced.groupBy("owner").applyInPandas(_answer, ANSWERED_SQL)
    told = written(answers.groupBy("parcel").applyInPandas(_by_document, "doc_id long, name long, n long, shared binary, hot binary"), "told")
    by_doc = told.groupBy("doc_id", "name").agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot"))
    shared = told.agg(F.sum("n")).first()[0] or 0
    discard(prints, first)

    groups = max(1, int(shared * (LENGTH + 20) / GROUP_BYTES) + 1)
    # Both joins have all rows on their left side, so that Spark shuffles the texts once for both.
    dealt = docs.join(by_doc, ["doc_id", "name"], "left").mapInArrow(_deal(groups), DEALT_SQL)
    gone = dealt.groupBy("grp").applyInPandas(_settle, "id long, name long, a long, b long").union(copies)
    ranges = gone.groupBy(F.col("id").alias("doc_id"), "name").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    out = docs.join(ranges, ["doc_id", "name"], "left")
    return out.select("doc_id", "text", "gone").mapInArrow(_left, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
