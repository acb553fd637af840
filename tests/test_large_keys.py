"""Operators whose keys may be of any size, on small rows cut into small chunks, against plain Python."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sprucelake.operators import inverted
from sprucelake.operators.joins import asof_join
from sprucelake.operators.ordered import below, chunked, framed, hot_keys, numbered_in_key, running, within
from sprucelake.operators.percentiles import percentiles
from sprucelake.operators.sketches import count_min, estimates, heavy_hitters, merged, overcount
from sprucelake.operators.vectors import approximate_nearest, calibrated, nearest, nearest_by_products, vector_index

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def keyed(spark):
    """600 rows of which half have key 1, some no key, with ties in t and repeated rows."""
    rng = random.Random(7)
    rows = [(i, 1 if i % 2 else rng.choice([None, 2, 3, 4]), rng.randint(0, 60), rng.choice([None, 1.5, 2.0, 7.25, -3.0])) for i in range(600)]
    return rows, spark.createDataFrame(rows, "i int, k int, t int, v double").repartition(5)


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out[r[1]].append(r)
    return out


@pytest.mark.parametrize("size", [7, 50, 10_000])
def test_running(keyed, size):
    rows, df = keyed
    values = {"n": ("count", F.lit(1)), "some": ("count", F.col("v")), "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "last": ("last", F.col("v"))}
    out = {r.i: tuple(r)[4:] for r in running(df, ["k"], [F.asc("t"), F.asc("i")], values, size).collect()}
    assert len(out) == len(rows)
    for group in by_key(rows).values():
        for j, r in enumerate(group):
            seen = [x[3] for x in group[: j + 1] if x[3] is not None]
            assert out[r[0]] == (j + 1, len(seen), sum(seen) if seen else None, min(seen, default=None), max(seen, default=None), seen[-1] if seen else None)


def test_running_without_key_and_without_rows(spark, keyed):
    rows, df = keyed
    place = {r.i: r.place for r in numbered_in_key(df, [], [F.desc_nulls_last("v"), F.asc("i")], rows=40).collect()}
    order = sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
    assert [place[r[0]] for r in order] == list(range(600))
    assert running(df.where("false"), ["k"], [F.asc("t")], {"n": ("count", F.lit(1))}).count() == 0
    same = running(spark.createDataFrame([(1, 2)] * 50, "k int, t int"), ["k"], [F.asc("t")], {"n": ("count", F.lit(1))}, rows=5)
    assert sorted(r.n for r in same.collect()) == list(range(1, 51))


def test_chunks_share_a_hot_key_out(keyed):
    _, df = keyed
    sizes = [r["count"] for r in chunked(df, ["k"], [F.asc("t")], rows=30).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 60 and len(sizes) >= 15
    hot = [r.k for r in hot_keys(df.select("k"), ["k"], hot_rows=200).collect()]
    assert hot == [1]


@pytest.mark.parametrize("size", [3, 20, 10_000])
def test_frames(keyed, size):
    rows, df = keyed
    made = lambda w: {"near": F.collect_list("i").over(w.rowsBetween(-2, 1)), "before": F.lag("i", 2).over(w), "after": F.lead("i").over(w)}
    out = {r.i: r for r in framed(df, ["k"], [F.asc("t"), F.asc("i")], 2, 1, made, rows=size).collect()}
    assert len(out) == 600
    for group in by_key(rows).values():
        ids = [r[0] for r in group]
        for j, i in enumerate(ids):
            assert list(out[i].near) == ids[max(0, j - 2) : j + 2] and out[i].before == (ids[j - 2] if j > 1 else None) and out[i].after == (ids[j + 1] if j + 1 < len(ids) else None)


def test_asof_of_hot_keys_equals_the_plain_way(spark):
    rng = random.Random(3)
    pick = lambda: 1 if rng.random() < 0.5 else rng.choice([2, 3, None])
    left = spark.createDataFrame([(i, pick(), T0 + dt.timedelta(hours=rng.randint(0, 80)) if i % 17 else None) for i in range(400)], "i int, k int, t timestamp_ntz")
    right = spark.createDataFrame([(pick(), T0 + dt.timedelta(hours=rng.randint(0, 80)), j if j % 9 else None) for j in range(300)], "k int, u timestamp_ntz, v int")
    rows = lambda **more: sorted(map(tuple, asof_join(left, right, ["k"], "t", "u", ["v"], **more).select("i", "v").collect()), key=repr)
    assert rows() == rows(hot_rows=50) == rows(hot_rows=0) and rows(tolerance="3 hours") == rows(tolerance="3 hours", hot_rows=50)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("size", [9, 10_000])
def test_below_equals_a_nested_loop(spark, strict, size):
    rng = random.Random(5)
    some = lambda *x: rng.choice([*x, None])
    left = [(i, some(1, 1, 1, 2), some(*range(12)), i % 3) for i in range(150)]
    right = [(some(1, 1, 2, 3), some(*range(12)), some(1, 5, 10)) for _ in range(200)]
    a, b = spark.createDataFrame(left, "i int, k int, v int, side int"), spark.createDataFrame(right, "q int, w int, x int")
    less = (lambda w, v: w < v) if strict else (lambda w, v: w <= v)

    def expected(keyed):
        for i, k, v, _ in left:
            hit = [x for q, w, x in right if None not in (v, w) and less(w, v) and (not keyed or (q == k and q is not None))]
            seen = [x for x in hit if x is not None]
            yield i, len(hit), sum(seen) if seen else None

    for by in ({"k": "q"}, None):
        out = below(a, b, "v", "w", by, strict, {"total": "x"}, rows=size)
        assert sorted((r.i, r.n, r.total) for r in out.collect()) == sorted(expected(by))
        assert out.columns == ["i", "k", "v", "side", "n", "total"]
        assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert sorted((r.i, r.n) for r in below(a, b.where("false"), "v", "w").collect()) == [(i, 0) for i in range(150)]
    assert below(a.where("false"), b, "v", "w").count() == 0


@pytest.mark.parametrize("size", [11, 10_000])
def test_within_equals_a_nested_loop(keyed, size):
    rows, df = keyed
    out = {r.i: (r.near, r.total) for r in within(df, ["k"], "t", F.col("t") - 5, "near", {"total": "v"}, size).collect()}
    for i, k, t, _ in rows:
        hit = [v for _, q, u, v in rows if q == k and k is not None and t - 5 <= u <= t]
        assert out[i] == (len(hit), pytest.approx(sum(v for v in hit if v is not None)))


def test_percentiles_by_selection(spark):
    rng = random.Random(1)
    groups = {"even": [rng.uniform(0, 1) for _ in range(900)], "ties": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(700)], "one": [4.0] * 500, "far": [10.0 ** rng.uniform(-200, 200) * rng.choice([-1, 1]) for _ in range(600)], "few": [3.0, 1.0], None: [rng.gauss(0, 1) for _ in range(400)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None)] * 50 + [("none", None)] * 3
    wanted = {"p0": (0.0, "cont"), "mid": (0.5, "cont"), "p90": (0.9, "cont"), "p100": (1.0, "disc"), "q1": (0.25, "disc")}
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for most in (20, 150, 10_000):
        out = {r.k: r.asDict() for r in percentiles(df, ["k"], "v", wanted, most).collect()}
        assert set(out) == set(groups) | {"none"} and all(out["none"][n] is None for n in wanted)
        for k, vs in groups.items():
            for name, (f, kind) in wanted.items():
                exact = float(np.quantile(vs, f)) if kind == "cont" else sorted(vs)[max(0, math.ceil(len(vs) * f) - 1)]
                assert out[k][name] == pytest.approx(exact, rel=1e-12), (most, k, name)
    assert percentiles(df.where("false"), ["k"], "v", wanted).count() == 0


def test_count_min(spark):
    rng = random.Random(2)
    keys = [rng.choice([None, *range(30)]) if rng.random() < 0.5 else rng.randint(0, 3000) for _ in range(4000)] + [7] * 2000
    df, exact = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "k int, part int"), Counter(keys)
    whole = count_min(df, ["k"], depth=5, width=512)
    parts = merged(*[count_min(df.where(F.col("part") == p), ["k"], depth=5, width=512) for p in range(3)])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() <= 5 * 512
    found = {r.k: r.estimate for r in estimates(df, ["k"], whole, 5, 512).collect()}
    assert set(found) == set(exact) and all(found[k] >= n for k, n in exact.items())
    assert sum(found[k] > n + overcount(6000, 512) for k, n in exact.items()) <= 0.02 * len(exact)
    weighed = count_min(df, ["k"], F.col("part"), depth=5, width=512)
    assert weighed.where("line = 0").agg(F.sum("n")).first()[0] == sum(i % 3 for i in range(len(keys)))
    for share in (0.01, 0.02, 0.3, 0.5):
        assert {r.k: r.n for r in heavy_hitters(df, ["k"], share, depth=4, width=64).collect()} == {k: n for k, n in exact.items() if n >= share * 6000}
    assert count_min(df.where("false"), ["k"]).count() == 0 and heavy_hitters(df.where("false"), ["k"], 0.1).count() == 0


def clustered(spark, n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    return spark.createDataFrame([(i, [float(x) for x in centres[rng.integers(40)] + 0.25 * rng.normal(size=dims)]) for i in range(n)], "vec_id long, embedding array<double>")


def test_nearest_by_products_equals_the_plain_way(spark, monkeypatch):
    monkeypatch.setattr(inverted, "CHUNK", 30)
    monkeypatch.setattr(inverted, "QUERIES", 8)
    v = clustered(spark, 200).union(spark.createDataFrame([(900 + i, [1.0] * 16) for i in range(50)], "vec_id long, embedding array<double>"))
    rows = lambda df: sorted((r.query_id, r.vec_id, round(r.cosine, 9), r["rank"]) for r in df.collect())
    asked = v.where("vec_id % 10 = 0")
    assert rows(nearest_by_products(asked, v, 4)) == rows(nearest(asked, v, 4)) and len(rows(nearest(asked, v, 4))) == 100
    odd = v.union(spark.createDataFrame([(2000, None), (2010, [0.0] * 16), (2020, [None] * 16), (2030, [math.nan] * 16), (2040, [1.0]), (None, [1.0] * 16)], "vec_id long, embedding array<double>"))
    ids = {r.query_id for r in nearest_by_products(odd.where("vec_id % 10 = 0"), odd, 4).collect()}
    assert ids == {r.vec_id for r in asked.collect()} | {2040}
    assert nearest_by_products(asked, v.where("false"), 4).count() == 0 and nearest_by_products(asked.where("false"), v, 4).count() == 0


def test_approximate_nearest_visits_less_and_finds_most(spark, monkeypatch):
    """On vectors with structure the rows that are scored grow far less than the square."""
    shares = []
    for n in (800, 3200):
        v = clustered(spark, n)
        index = vector_index(v)
        probes = calibrated(index, 5)
        asked = v.where("vec_id % 20 = 0")
        found = {(r.query_id, r.vec_id) for r in approximate_nearest(index, asked, 5, probes).collect()}
        exact = {(r.query_id, r.vec_id) for r in nearest_by_products(asked, v, 5).collect()}
        assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
        assert int(index.rows.sum()) == n == index.members.count()
        shares.append(probes / len(index.centroids))
    assert shares[1] < 0.75 * shares[0] and shares[0] < 0.4
    everything = approximate_nearest(index, asked, 5, len(index.centroids))
    assert {(r.query_id, r.vec_id) for r in everything.collect()} == exact
