"""Hard negatives, token alignment and SimHash groups against brute force, with odd rows everywhere."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import frame, odd_rows
from sprucelake.llm import alignment, hard_negatives, simhash
from sprucelake.llm.common import lower_words
from sprucelake.operators import inverted

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

# 11 hard negatives


def mined(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    """Brute force over (id, vector, label)."""
    usable = {}
    for i, v, y in rows:
        if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = min(usable.get(i, (y, w := [math.floor(scale * x) for x in v])), (y, w))
    score = lambda a, b: sum(x * z for x, z in zip(usable[a][1], usable[b][1]))
    out = []
    for a in (i for i in usable if i % 50 == 0):
        others = sorted((-score(a, b), b) for b in usable if b != a)
        for s, p in [(-s, b) for s, b in others if usable[b][0] == usable[a][0]][:positives]:
            fit = [(-t, b) for t, b in others if usable[b][0] != usable[a][0] and low * s <= -100 * t <= high * s][:negatives]
            out += [(a, p, r, b, s, t) for r, (t, b) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, seed=0, dims=6, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(i, [float(x) for x in np.float32(centres[rng.integers(7)] + spread * rng.normal(size=dims))], int(rng.integers(4))) for i in range(n)]


ODD_VECTORS = [(None, [1.0] * 6, 1), (1001, None, 1), (1002, [1.0] * 6, None), (1003, [1.0, None] * 3, 1), (1004, [math.nan] * 6, 1), (1005, [math.inf] * 6, 1), (1050, [0.0] * 6, 2), (1051, [0.0] * 6, 2), (1052, [0.0] * 6, 3), (1100, [1.0, 2.0], 1), (1101, [], 1), (50, [9.0] * 6, 3), (50, [1.0] * 6, 0)]


def table_of(spark, rows, parts=4):
    """The vectors beside columns whose names the operator uses itself."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "1 as id", "2 as v", "'x' as list", "3 as slot", "4 as query", "5 as score", "6 as rank").repartition(parts)


def mine(df, **more):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("id") % 50 == 0, **more).collect()))


@pytest.mark.parametrize("first, chunk, queries", [(1, 7, 3), (4, 1000, 512)])
def test_hard_negatives(spark, monkeypatch, first, chunk, queries):
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(inverted, "CHUNK", chunk)
    monkeypatch.setattr(inverted, "QUERIES", queries)
    rows = vectors(400) + [(500 + i, [1.0, 0.5, 0.25, 0.0, -0.5, 2.0], i % 2) for i in range(130)] + ODD_VECTORS
    assert mine(table_of(spark, rows)) == mined(rows) and len(mined(rows)) > 50
    assert mine(table_of(spark, rows, 1), positives=2, negatives=1, low=10, high=80, scale=16) == mined(rows, 2, 1, 10, 80, 16)


def test_hard_negatives_of_few_rows(spark):
    for rows in ([], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(51, [1.0], 1), (52, [1.0], 2)], [(0, [], 1), (1, [], 1), (2, [], 2)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2)]):
        assert mine(table_of(spark, rows)) == mined(rows)


def test_hard_negatives_of_large_numbers(spark):
    rows = [(i, [3e5 + 10 * i, -2e5 * (i % 3), 1e5], i % 2) for i in range(120)]
    assert mine(table_of(spark, rows)) == mined(rows)
    assert hard_negatives.hard_negatives(table_of(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [3e38], 2)]), F.col("id") % 50 == 0).count() == 0


def test_lists_outside_the_window_are_not_visited(spark, monkeypatch):
    """With tight lists the bounds leave out nearly all rows; the answers stay."""
    rng = np.random.default_rng(4)
    rows = []
    for i, c in enumerate(rng.integers(0, 8, 600).tolist()):
        rows.append((i, [float(x) for x in 3 * np.eye(8)[c] + 0.02 * rng.normal(size=8)], c % 3 if rng.random() < 0.8 else 5))
    df = table_of(spark, rows)
    kept = df.selectExpr("vec_id as id", "label", "transform(embedding, x -> cast(floor(256 * x) as int)) as v")
    index = inverted.build(kept, "<i4")
    anchors = index.members.where("id % 50 = 0").select(F.col("id").alias("query"), "label", "v").withColumns({"slot": F.lit(0), "low": F.lit(-(2**62)), "high": F.lit(2**62)})
    calls = []
    visits = hard_negatives.visits
    monkeypatch.setattr(hard_negatives, "visits", lambda index, c, *a: calls.append(c.count()) or visits(index, c, *a))
    hard_negatives.search(index, anchors, 12, True, 5)
    assert sum(calls) < 0.6 * 12 * len(index.centroids) and len(index.centroids) >= 8
    assert mine(df) == mined(rows)


def test_a_list_with_most_rows_lies_in_chunks(spark):
    rows = spark.range(6000).selectExpr("id", "1 as label", "if(id % 10 = 0, array(int(id), 5), array(7, 7)) as v")
    index = inverted.build(rows, "<i4", lists=40)
    sizes = [len(r["ids"]) for r in index.chunks.select("ids").collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1.3 * inverted.CHUNK and index.rows.max() > 5000


# 12 alignment


def aligned(text, pair):
    """((n_a, n_b, n_groups, n_links, digest), links) by walking over tokens."""
    nothing = (0, 0, 0, 0, ""), Counter()
    if not text:
        return nothing
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    bytes_a, bytes_b = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return nothing
    groups, links, x, y, at_a, at_b = [], Counter(), [], [], 0, 0
    i = j = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            x.append(a[i])
            at_a, i = at_a + len(bytes_a[i]), i + 1
        else:
            y.append(b[j])
            at_b, j = at_b + len(bytes_b[j]), j + 1
        if at_a == at_b:
            groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            links.update((p, q) for p in x for q in y)
            x, y = [], []
    return (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def token_rows(rows):
    pair = alignment.tokenizer_pair(*PATHS)
    each = [(i, *aligned(t, pair)) for i, t in rows]
    counts, most = Counter(p for *_, links in each for p in links), defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted((i or -1, *f[:4], sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()), f[4]) for i, f, links in each)


ODD_TEXTS = ["▁x", "a ▁ b", " a", "a ", " \n", "1" * 500, "梦" * 300, "ab " * 400, "\n" * 50, "x  y   z", "<|endoftext|> <s> <unk>", "a\x1cb \x1c c", "zero​ ​width", "“quoted” — dash", "don't we'll", "\x00 \x00"]


@pytest.mark.parametrize("most, links, line", [(1_000_000, 4096, 20_000), (300, 2, 1)])
def test_token_links(spark, sf, monkeypatch, most, links, line):
    for name, value in (("MOST", most), ("LINKS", links), ("LINE_CHARS", line)):
        monkeypatch.setattr(alignment, name, value)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(i and 10_000 + i, t) for i, t in odd_rows()] + [(20_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    out = alignment.token_links(frame(spark, rows), *PATHS)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r[0] or -1, *tuple(r)[1:]) for r in out.collect()) == token_rows(rows)
    assert alignment.token_links(frame(spark, rows).where("false"), *PATHS).count() == 0


def test_units_give_what_whole_texts_give():
    rng, pair = random.Random(3), alignment.tokenizer_pair(*PATHS)
    letters = ["a", "in", "the", "er", " ", "  ", "\n", " \n ", "\t", "é", "梦", "😀", "<s>", "<|endoftext|>", "\x00", "'s", "1234", " ", "​", "　", "\x1c", "...", "Word", "᠎", " <unk> ", "﻿"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    own = alignment.Aligner(pair)
    for k in range(0, len(texts), 100):
        figures, digests, text, pairs, times = own.align(texts[k : k + 100])
        for i, t in enumerate(texts[k : k + 100]):
            expected, links = aligned(t, pair)
            assert (*figures[i].tolist(), digests[i]) == expected
            assert dict(zip(pairs[text == i].tolist(), times[text == i].tolist(), strict=True)) == {a << alignment.PAIR | b: n for (a, b), n in links.items()}


def test_ranks_and_cuts():
    rng = np.random.default_rng(1)
    a, b = (np.flatnonzero(rng.random(1000) < p) for p in (0.3, 0.5))
    one, two = alignment.Marks(a, 1000), alignment.Marks(b, 1000)
    places = np.arange(1000)
    assert one.rank(places).tolist() == np.searchsorted(a, places, "right").tolist()
    assert alignment.shared_cuts(one, two).tolist() == np.intersect1d(a, b).tolist()


# 13 SimHash


def plain_fingerprint(text, k=3):
    words = lower_words(text)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """print -> smallest print that can be reached, by comparing all."""
    top = {p: p for p in prints}
    find = lambda p: p if top[p] == p else find(top[p])
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                a, b = find(p), find(q)
                top[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def test_golay_code_is_perfect_and_keys_meet():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 20_000)
    upper, lower, errors = simhash._tables()
    nearest = words ^ errors[upper[words >> 11] ^ lower[words & 2047]]
    assert not simhash._syndromes(nearest).any() and np.bitwise_count(words ^ nearest).max() == 3 and len(set(errors.tolist())) == 2048
    assert set(np.unique((simhash.nearby(words) >= 0).sum(axis=1)).tolist()) == {1, 6}
    # Every pair at most three bits apart has a key in common, for each way that three errors fall.
    prints = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for n in (1, 2, 3) for _ in range(400)]
    k, own = simhash.keys(prints)
    for f in flips:
        others, _ = simhash.keys((prints.view(np.uint64) ^ f).view(np.int64))
        assert all(set(x[(x >= 0) & o].tolist()) & set(y[y >= 0].tolist()) for x, o, y in zip(k[:40], own, others, strict=False))


def check_groups(spark, rows):
    out = simhash.simhash_groups(frame(spark, rows)).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    tops = grouped(sorted(set(prints.values())))
    first = {}
    for i, t in rows:
        if i is not None:
            first[tops[prints[t]]] = min(i, first.get(tops[prints[t]], i))
    expected = [(i, f"{prints[t]:016x}", None if i is None else first[tops[prints[t]]]) for i, t in rows]
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)


def similar_rows(n=250, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 300)}" for _ in range(400)]
    return [(1000 + i, " ".join(rng.choice(["x", "yy", "zzz"]) + str(i) if rng.random() < 0.004 * (i % 6) else w for w in base)) for i in range(n)]


@pytest.mark.parametrize("cold, block", [(1000, 4000), (3, 5), (3, 1000)])
def test_simhash_groups(spark, sf, monkeypatch, cold, block):
    monkeypatch.setattr(simhash, "COLD", cold)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = similar_rows(250 if cold > 3 else 60) + odd_rows()
    assert len({plain_fingerprint(t) for _, t in rows}) > 60
    check_groups(spark, rows)
    assert simhash.simhash_groups(frame(spark, rows).where("false")).count() == 0


def test_simhash_of_all_documents(spark, sf):
    check_groups(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_links_in_chains_and_balls(spark, monkeypatch):
    """Prints in chains of three bits, and all within two bits of one centre, in buckets of any kind."""
    rng = random.Random(2)
    centre, chain = rng.getrandbits(64), [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 3)))
    ball = [centre] + [centre ^ 1 << i ^ 1 << j for i in range(0, 64, 5) for j in range(1, 64, 7) if i != j]
    prints = sorted(set(chain + ball + [rng.getrandbits(64) for _ in range(50)]))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    for cold, block in ((1000, 4000), (2, 4), (2, 1000)):
        monkeypatch.setattr(simhash, "COLD", cold)
        monkeypatch.setattr(simhash, "BLOCK", block)
        links = simhash.links_of(df).collect()
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in links)
        top = {p: p for p in prints}
        find = lambda p: p if top[p] == p else find(top[p])
        for r in links:
            a, b = find(r["a"] % 2**64), find(r["b"] % 2**64)
            top[max(a, b)] = min(a, b)
        assert {p: find(p) for p in prints} == grouped(prints)
