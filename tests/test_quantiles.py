"""Radix selection against numpy, for values and groups of every shape."""

import random

import numpy as np
import pytest

from stormrail.operators import aggregates as A
from stormrail.operators import quantiles as Q

PROBS = [0.0, 0.05, 0.3, 0.5, 0.9, 1.0]


def ours(df, groups=("g",), **kw):
    rows = Q.exact_quantiles(df, "v", PROBS, list(groups), **kw).collect()
    return {tuple(r[g] for g in groups): tuple(r[f"q_{str(p).replace('.', '_')}"] for p in PROBS) for r in rows}


def flat(found):
    """{(group, which quantile): value}, which approx can compare."""
    return {(*g, i): v for g, q in found.items() for i, v in enumerate(q)}


def numpy_quantiles(rows):
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault((g,), []).append(v)
    out = {}
    for g, v in by.items():
        v = np.sort(np.array(v))
        pos = [(len(v) - 1) * p for p in PROBS]
        lo, hi = [v[int(np.floor(x))] for x in pos], [v[int(np.ceil(x))] for x in pos]
        out[g] = tuple(float(a) if x == np.floor(x) else float(a + (x - np.floor(x)) * (b - a))
                       for x, a, b in zip(pos, lo, hi))
    return out


@pytest.mark.parametrize("shape", ["whole", "continuous", "decades", "extreme", "constant", "tiny"])
def test_equals_numpy(spark, shape):
    rng = random.Random(3)
    draw = {"whole": lambda: float(rng.randint(-50, 50)), "continuous": lambda: rng.gauss(0, 1),
            "decades": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-30, 30), "constant": lambda: 7.25,
            "extreme": lambda: rng.choice([-1.7e308, 1.7e308, 0.0, 1.0, 5e-324]),
            "tiny": lambda: rng.choice([0.0, 5e-324, 1e-323, 1.5e-323])}[shape]
    rows = [(rng.choice(["a", "b", None]), draw()) for _ in range(900)] + [("one", 3.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    assert flat(ours(df)) == pytest.approx(flat(numpy_quantiles(rows)), nan_ok=True, abs=0.0)


def test_infinities_and_nan_are_ordered(spark):
    inf, nan = float("inf"), float("nan")
    v = [-inf, -inf, -1.0, 0.0, 2.0, inf, nan, nan, nan]
    df = spark.createDataFrame([("a", x) for x in v], "g string, v double")
    got = Q.exact_quantiles(df, "v", [0.0, 0.125, 0.25, 0.5, 0.625, 0.75, 1.0], ["g"]).first()
    assert [got[i] for i in range(1, 6)] == [-inf, -inf, -1.0, 2.0, inf] and np.isnan(got[6]) and np.isnan(got[7])


def test_weights_no_groups_and_empty(spark):
    rows = [(1.0, 3), (2.0, 1), (10.0, 6)]
    df = spark.createDataFrame(rows, "v double, w int")
    got = Q.exact_quantiles(df, "v", [0.3, 0.5], weight="w").first()
    each = np.repeat([1.0, 2.0, 10.0], [3, 1, 6])
    assert tuple(got) == pytest.approx(tuple(np.quantile(each, [0.3, 0.5])))
    assert tuple(Q.exact_quantiles(df.limit(0), "v", [0.5]).collect()[0]) == (None,)
    assert Q.exact_quantiles(df.limit(0).withColumnRenamed("w", "g"), "v", [0.5], ["g"]).collect() == []


def test_hot_group_is_spread_and_no_value_list_is_gathered(spark):
    """A third of the rows in one group: the rounds read it in even parts, and no plan holds a percentile."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", rng.random()) for i in range(30_000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    sizes, stored = [], Q.stored

    def watched(frame, name):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "collect_list" not in plan and "RepartitionByExpression" not in plan.replace(
            "Repartition 8", "")
        out = stored(frame, name)
        if name == "values":
            sizes.extend(r["count"] for r in out.groupBy(Q.F.spark_partition_id()).count().collect())
        return out

    Q.stored, before = watched, Q.stored
    try:
        got = ours(df)
    finally:
        Q.stored = before
    assert flat(got) == pytest.approx(flat(numpy_quantiles(rows)))
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_named_median_among_other_aggregates(spark):
    rows = [("s", 1, 3.0, 1.0), ("s", 1, 9.0, 5.0), ("s", 1, 4.0, None), ("t", None, 2.0, None)]
    df = spark.createDataFrame(rows, "station string, time int, median_x double, max_y double")
    out = A.aggregate_by_names(df, ["station", "time"], ["median_x", "max_y"]).orderBy("station").collect()
    assert [tuple(r) for r in out] == [("s", 1, 4.0, 5.0), ("t", None, 2.0, None)]
    only = A.aggregate_by_names(df, ["station"], ["median_x"]).orderBy("station").collect()
    assert [tuple(r) for r in only] == [("s", 4.0), ("t", 2.0)]


@pytest.mark.parametrize("cells", [1, 64, 2000])
def test_rounds_of_few_bins_and_the_last_by_value(spark, monkeypatch, cells):
    monkeypatch.setattr(Q, "CELLS", cells)
    rng = random.Random(5)
    draw = [lambda: rng.gauss(0, 1e6), lambda: float(rng.randint(0, 3)), lambda: rng.choice([0.0, -0.0, 1e300, -1e-300])]
    rows = [(g, draw[i]()) for i, g in enumerate(["a", "b", None]) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    assert flat(ours(df)) == pytest.approx(flat(numpy_quantiles(rows)), abs=0.0)


def test_higher_quantiles_equal_numpy(spark):
    rng = random.Random(6)
    v = [rng.gauss(0, 1) for _ in range(777)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = Q.exact_quantiles(df, "v", [0.5, 0.3, 0.99], higher=[0.3, 0.99]).first()
    assert tuple(got) == (np.median(v), *np.quantile(v, [0.3, 0.99], method="higher"))


def test_values_are_written_as_they_come(spark, monkeypatch):
    """No task hashes the exploded values of its part: nearly all of them differ, so that table is as large as they are."""
    plans, stored = {}, Q.stored
    monkeypatch.setattr(Q, "stored", lambda d, name: plans.setdefault(
        name, d._jdf.queryExecution().optimizedPlan().toString()) and stored(d, name))
    df = spark.range(300).selectExpr("id % 7 as time", "case when id % 3 = 0 then 'K' else 'T' end as train_type",
                                     "id / 3.0D as delay", "id * 1.0D as total_delay")
    out = A.mean_median_by_group(df).collect()
    assert len(out) == 7 * 4 and "Aggregate" not in plans["values"] and "Range" not in plans["values"]
    assert {r.time: r.median_total_delay for r in out if r.group == "all"} == {
        t: float(np.median([i for i in range(300) if i % 7 == t])) for t in range(7)}
