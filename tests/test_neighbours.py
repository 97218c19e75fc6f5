"""The exact nearest-neighbour join and over-sampling against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormrail.operators import joins as J
from stormrail.operators import neighbours as N
from stormrail.operators import sampling as SM


def squared(x, y):
    total = 0.0
    for a, b in zip(x, y):  # plain additions: sum() of floats is compensated
        total += (a - b) * (a - b)
    return total


def brute(q, s, k, own=False, radius=None):
    out = {}
    for i, x in q:
        d = sorted((squared(x, y), j) for j, y in s if not (own and i == j))
        out[i] = [(j, v) for v, j in d if radius is None or v <= radius ** 2][:k]
    return out


def frame(spark, rows, d, parts=3):
    schema = "id long, " + ", ".join(f"x{j} double" for j in range(d))
    return spark.createDataFrame([(i, *map(float, x)) for i, x in rows], schema).repartition(parts)


def ours(spark, q, s, k, d, **kw):
    out = {i: [] for i, _ in q}
    rows = N.k_nearest(frame(spark, q, d), frame(spark, s, d), k, [f"x{j}" for j in range(d)], "id", "id", **kw)
    for r in rows.orderBy("qid", "rank").collect():
        out[r.qid].append((r.sid, r.d2))
    return out


@pytest.mark.parametrize("shape", ["even", "city", "lattice", "copies"])
def test_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(N, "LEAF_SITES", 16)
    monkeypatch.setattr(N, "CHUNK", 50)
    rng = np.random.default_rng(4)
    x = {"even": rng.uniform(size=(600, 3)), "lattice": rng.integers(0, 6, (600, 3)).astype(float),
         "city": np.r_[rng.normal(scale=1e-3, size=(550, 3)), rng.uniform(-50, 50, (50, 3))],
         "copies": np.r_[np.tile([[1.0, 2.0, 3.0]], (400, 1)), rng.uniform(size=(200, 3))]}[shape]
    s = [(i, v.tolist()) for i, v in enumerate(x)]
    q = [(1000 + i, v.tolist()) for i, v in enumerate(rng.uniform(-2, 7, (120, 3)))] + s[:150]
    assert ours(spark, q, s, 4, 3) == brute(q, s, 4)
    assert ours(spark, q, s, 3, 3, own=True, radius=0.7) == brute(q, s, 3, True, 0.7)


def test_five_thousand_rows(spark):
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(size=(3000, 2)), rng.normal(5, 0.01, (2000, 2))]
    got = ours(spark, [(i, v.tolist()) for i, v in enumerate(x)], [(i, v.tolist()) for i, v in enumerate(x)], 5, 2, own=True)
    for i in range(0, 5000, 97):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [j for j, _ in got[i]] == np.lexsort((np.arange(5000), d))[:5].tolist()
    assert all(len(v) == 5 for v in got.values())


def test_few_sites_nulls_and_empty(spark):
    s = [(1, [0.0, 0.0]), (2, [3.0, 4.0])]
    assert ours(spark, [(7, [0.0, 0.0])], s, 5, 2) == {7: [(1, 0.0), (2, 25.0)]}
    assert ours(spark, [(7, [0.0, 0.0])], [], 5, 2) == {7: []} and ours(spark, [], s, 5, 2) == {}
    df = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (None, 1.0, 1.0), (3, 1.0, 0.0)],
                               "id long, x0 double, x1 double")
    assert [tuple(r) for r in N.k_nearest(df, df, 2, ["x0", "x1"], "id", "id").collect()] == [(3, 3, 0.0, 1)]


def test_tree_cuts_every_place_once():
    x = np.random.default_rng(0).normal(size=(4000, 2))
    tree = N.build_tree(x, 64)
    at = tree.leaf(x)
    assert tree.leaves == 64 and set(at) == set(range(64)) and np.bincount(at).max() < 200
    assert N.build_tree(np.ones((50, 2)), 8).leaves == 1


def test_nearest_sites_over_the_date_line_and_in_one_city(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_SITES", 20)
    rng = random.Random(1)
    sites = [(f"c{i}", 60.0 + rng.uniform(0, 1e-3), 179.999 + rng.uniform(0, 2e-3)) for i in range(300)]
    sites = [(n, a, o - 360 if o > 180 else o) for n, a, o in sites] + [("p", 89.9, 10.0), ("far", 0.0, 0.0)]
    points = [("a", 60.0, -179.9999), ("b", 60.0005, 180.0), ("n", 89.95, -170.0), ("x", -45.0, 3.0)]
    s = spark.createDataFrame(sites, "site string, lat double, lon double")
    p = spark.createDataFrame(points, "station string, lat double, lon double")
    got = {}
    for r in J.nearest_within(p, s, 4, 100.0).orderBy("station", "rank").collect():
        got.setdefault(r.station, []).append(r.site)

    def km(a, b):
        la, lo, lb, ob = map(np.radians, (a[1], a[2], b[1], b[2]))
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - lo) / 2) ** 2
        return 2 * 6371 * np.arcsin(min(1.0, np.sqrt(h)))

    want = {x[0]: [b[0] for b in sorted(sites, key=lambda b: (km(x, b), b[0])) if km(x, b) <= 100][:4] for x in points}
    assert got == {k: v for k, v in want.items() if v} and got["n"] == ["p"] and len(got["a"]) == 4


def test_link_counts_equal_pairs(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randint(0, 8)}", rng.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, station string, time int")
    e = spark.createDataFrame([("s0", "s1"), ("s1", "s0"), ("s2", "s2"), ("s3", "s9"), ("s4", "s5"), ("s0", "s5")],
                              "src string, dst string")
    for same in ("time", None):
        pairs = J.row_links(df, e, same_time=same).groupBy("row_a").count().collect()
        counts = J.link_counts(df, e, same_time=same).collect()
        assert {(r.row_a, r["count"]) for r in pairs} == {(r.row_id, r.n_links) for r in counts}
    plan = J.link_counts(df, e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # counts with edges, rows with sums


def test_smote(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.random(), rng.random(), "m") for i in range(400)]
    rows += [(400 + i, 1, 10 + rng.random(), rng.random(), "m") for i in range(37)] + [(900, 1, None, 0.5, "m")]
    df = spark.createDataFrame(rows, "key long, class int, a double, b double, meta string").repartition(5)
    out = SM.smote(df, ["key"], ["a", "b"], ratio=0.5)
    assert out.columns == df.columns
    made = out.where("key is null").collect()
    assert len(made) == 200 - 38 and all(r["class"] == 1 and r.meta is None for r in made)
    assert sorted(map(str, out.where("key is not null").collect())) == sorted(map(str, df.collect()))
    small = [(r[0], [r[2], r[3]]) for r in rows if r[1] == 1 and r[2] is not None]
    ends = brute(small, small, 5, own=True)
    place = dict(small)
    for r in made:
        def on(i, j):
            (p, q), (x, y) = place[i], place[j]
            t = (r.a - p) / (x - p) if x != p else 0.0
            return 0 <= t <= 1 and abs(q + t * (y - q) - r.b) < 1e-9
        assert any(on(i, j) for i in place for j, _ in ends[i])
    again = SM.smote(df.repartition(2), ["key"], ["a", "b"], ratio=0.5).where("key is null").collect()
    assert sorted(map(str, again)) == sorted(map(str, made))
    assert SM.smote(df, ["key"], ["a", "b"], ratio=0.01).count() == df.count()
    assert SM.smote(df.where("class = 0"), ["key"], ["a", "b"]).count() == 400
    assert SM.smote(df.limit(0), ["key"], ["a", "b"]).count() == 0
    assert out.where(F.col("key").isNull()).select("a", "b").distinct().count() > 150
