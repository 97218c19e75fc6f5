"""The mix: targets against brute force, taken words near them, and the rank order itself."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stormrail.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            open_.remove(s)
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(make_docs, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "src10", "src9"]
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 200]), rng.choice(names + ["a"] * 8)) for i in range(900)]
    got = mixing.mix(make_docs(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == words(rows[r.doc][1]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(101, 0.005 * want[s]), s  # half of the largest document at most
    again = mixing.mix(make_docs(rows, parts=7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_unequal_chances_follow_the_pareto_order(spark):
    """Of one group with unequal chances the sample is what sorting by rank and filling up would take."""
    rows = spark.range(3000).select(
        F.lit("g").alias("group"), F.lit(1).cast("long").alias("size"),
        F.when(F.col("id") % 3 == 0, 0.6).otherwise(0.15).alias("chance"), "id")
    rows = rows.withColumn("rank", mixing.pareto_rank(F.rand(5), F.col("chance"))).checkpoint()
    due = 0.6 * 1000 + 0.15 * 2000
    cut = mixing.pareto_sample(rows.select("group", "size", "rank"),
                               spark.createDataFrame([("g", due)], "group string, due double")).first()
    all_rows = rows.collect()
    first = {r.id for r in sorted(all_rows, key=lambda r: r["rank"])[:int(due)]}
    chosen = {r.id for r in all_rows if r["rank"] < cut.cut or r["rank"] in cut.extra}
    assert chosen == first
    share = sum(1 for i in chosen if i % 3 == 0) / 1000
    assert 0.5 < share < 0.7


def test_chances_differ_by_size_and_shares_follow_them(make_docs):
    """Over many seeds documents of each size are taken as often as their chance says, and the sum of what is taken
    over the chances estimates the number of all documents (Horvitz and Thompson). The words left at the end go to
    whatever fits, which adds a little to the shortest."""
    sizes = [20, 30, 45, 70, 100] * 60
    docs = make_docs([(i, "w " * n, "a") for i, n in enumerate(sizes)])
    spark, due = docs.sparkSession, 0.3 * sum(sizes)
    rows = spark.createDataFrame([("a", n) for n in sizes], "group string, size long")
    level = mixing.inclusion(rows, spark.createDataFrame([("a", due)], "group string, due double")).first().level
    chance = {n: min(1.0, level * n ** 0.5) for n in set(sizes)}
    assert sum(n * chance[n] for n in sizes) == pytest.approx(due) and len(set(chance.values())) >= 4
    taken, seeds = dict.fromkeys(chance, 0), range(6)
    for seed in seeds:
        for r in mixing.mix(docs, weights=(1,), share=0.3, seed=seed).collect():
            taken[r.size] += r.copies
    share = {n: taken[n] / (60 * len(seeds)) for n in chance}
    assert all(abs(share[n] - chance[n]) < 0.07 for n in chance), (share, chance)
    assert sum(taken[n] / chance[n] for n in chance) / len(seeds) == pytest.approx(len(sizes), rel=0.08)


def test_inclusion_levels_of_edge_cases(spark):
    rows = spark.createDataFrame([("a", 9), ("a", 9), ("b", 0), (None, 4), (None, 100)], "group string, size long")
    due = spark.createDataFrame([("a", 18.0), ("b", 0.0), (None, 54.0)], "group string, due double")
    got = {r.group: r.level for r in mixing.inclusion(rows, due).collect()}
    assert got == {"a": float("inf"), None: pytest.approx(54 / (4 * 2 + 100 * 10))}
    more = spark.createDataFrame([(None, 102.0)], "group string, due double")  # the long one is certain
    assert [r.level for r in mixing.inclusion(rows, more).collect()] == [pytest.approx(2 / (4 * 2))]
    assert mixing.inclusion(rows.limit(0), due).count() == 0


def test_edges(make_docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "p q r", None), (4, "z " * 50_000, "b")]
    got = {(r.doc, r.source): (r.size, r.taken) for r in mixing.mix(make_docs(rows)).collect()}
    assert got[1, "a"] == got[2, "a"] == (0, 0)
    assert got[3, "a"][0] == 2 and got[None, None][0] == 3 and got[4, "b"][0] == 50_000
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix(make_docs([(1, None, None)])).collect()] == [0]


def test_one_source_takes_all(make_docs):
    got = mixing.mix(make_docs([(i, "a b c", "only") for i in range(50)])).collect()
    assert sum(r.taken for r in got) == 150


def test_a_long_document_at_the_cut_leaves_no_words_due(make_docs):
    """What is taken is what a walk in rank order would take, each document if it still fits."""
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(200, 600), "a") for i in range(300)] + [(300, "w " * 60_000, "a")]
    rows += [(1000 + i, "w " * rng.randint(1, 9), "b") for i in range(300)]
    size = {i: words(t) for i, t, _ in rows}
    for seed in range(4):
        got = mixing.mix(make_docs(rows), weights=(1,), share=0.3, seed=seed).collect()
        for s in "ab":
            mine = [r for r in got if r.source == s]
            short = mine[0].target - sum(r.taken for r in mine)
            left = [r.size for r in mine if r.copies < mine[0].target // mine[0].source_size + 1]
            assert 0 <= short < min(left, default=1e9), (seed, s)
    groups = [(g, size[i], rng.random(), i) for i, _, g in rows]
    due = {"a": 50_000.0, "b": 700.0}
    spark = make_docs([]).sparkSession
    cut = {r.group: r for r in mixing.pareto_sample(
        spark.createDataFrame([x[:3] for x in groups], "group string, size long, rank double"),
        spark.createDataFrame(list(due.items()), "group string, due double")).collect()}
    for g, n, rank, _ in sorted(groups, key=lambda x: x[2]):
        fits = n <= due[g]
        due[g] -= n if fits else 0
        c = cut[g]
        behind = any(x.after < rank and (x.before is None or rank < x.before) and n <= x.most for x in c.extra)
        assert (rank < c.cut or behind) == fits
