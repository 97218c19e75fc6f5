"""Joins, imputation, sampling, splits and metrics on literal frames."""

import datetime as dt

from pyspark.sql import functions as F

from stormrail.operators.quantiles import exact_quantiles
from stormrail.operators import joins as J
from stormrail.operators import metrics as M
from stormrail.operators import sampling as SM
from stormrail.operators.impute import impute_nearest


def ts(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_join7_interval_counts(spark):
    rows = spark.createDataFrame([("S", ts(1), "K"), ("S", ts(1), "L"), ("S", ts(3), "K")],
                                 "station string, time timestamp_ntz, train_type string")
    ev = spark.createDataFrame([("S", ts(0)), ("S", ts(1)), ("S", ts(2)), ("S", ts(5))],
                               "station string, time timestamp_ntz")
    got = {(r.time.hour, r.train_type): r.flashcount for r in J.interval_counts(rows, ev, tiebreak=["train_type"]).collect()}
    assert got == {(1, "K"): 2, (1, "L"): 0, (3, "K"): 1}
    empty = spark.createDataFrame([], "station string, time timestamp_ntz")
    assert {r.flashcount for r in J.interval_counts(rows, empty).collect()} == {0}


def test_join9_unknown(spark):
    df = spark.createDataFrame([("a",), ("z",)], "id string")
    dim = spark.createDataFrame([("a", "Alpha")], "id string, name string")
    got = {r.id: r.name for r in J.ids_to_names(df, dim, "id", "id", "name").collect()}
    assert got == {"a": "Alpha", "z": "unkown"}


def test_impute_rules(spark):
    # stations along a meridian: 1 degree of latitude is about 111 km
    rows = [("A", 60.0, 25.0, None), ("B", 61.0, 25.0, 5.0), ("C", 61.3, 25.0, None),
            ("D", 62.5, 25.0, 7.0), ("E", 64.0, 25.0, None)]
    df = spark.createDataFrame([(s, ts(0), la, lo, v) for s, la, lo, v in rows],
                               "station string, time timestamp_ntz, lat double, lon double, v double")
    got = {r.station: r.v for r in impute_nearest(df, ["v"]).collect()}
    # A <- B (111 km); C <- B (33 km, D is 133 km); E: D is 167 km away -> dropped
    assert got == {"A": 5.0, "B": 5.0, "C": 5.0, "D": 7.0}


def test_spl3_thirteen_rows(spark):
    df = spark.range(1, 14).withColumnRenamed("id", "p")
    got = {r.p: (r.test_fold, r.first_train_fold) for r in SM.time_folds(df, ["p"], 5).collect()}
    assert [got[p][0] for p in range(1, 14)] == [None, None, None, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert got[3][1] == 1 and got[4][1] == 2 and got[13][1] is None


def test_smp2_repeatable_across_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("class"))
    a = sorted(r.k for r in SM.downsample_to_smallest(df.repartition(3), ["k"]).collect())
    b = sorted(r.k for r in SM.downsample_to_smallest(df.repartition(11), ["k"]).collect())
    assert a == b and len(a) == 2 * 167


def test_smp3_ratio(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") < 10).cast("int").alias("class"))
    out = SM.ratio_downsample(df, ["k"], 2.0)
    counts = {r["class"]: r["count"] for r in out.groupBy("class").count().collect()}
    assert counts == {1: 10, 0: 20}
    few = SM.ratio_downsample(df.where((F.col("class") == 1) | (F.col("k") < 15)), ["k"], 2.0)
    counts = {r["class"]: r["count"] for r in few.groupBy("class").count().collect()}
    assert counts == {1: 2, 0: 5}


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_ties_and_one_class(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.5), (0, 0.5), (0, 0.0)]
    df = spark.createDataFrame(rows, "y int, proba double")
    r = M.auc_ap(df).first()
    assert abs(r.auc - _brute_auc(rows)) < 1e-12
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, proba double")
    assert M.auc_ap(one).first().auc is None


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    r = M.binary_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_scan_features_distinct_fact(spark):
    from stormrail.operators.filters import scan_features
    fact = spark.createDataFrame([(1, "K", "S", ts(0)), (2, "K", "S", ts(1))],
                                 "key int, train_type string, station string, time timestamp_ntz")
    codes = spark.createDataFrame([(1, "A"), (1, "B"), (1, "R"), (2, "R")], "key int, code string")
    fan = scan_features(fact, codes=codes, code_keys=["key"], codes_excluded=["R"], cols=["key"])
    assert sorted(r.key for r in fan.collect()) == [1, 1]
    once = scan_features(fact, codes=codes, code_keys=["key"], codes_excluded=["R"], cols=["key"], distinct_fact=True)
    assert [r.key for r in once.collect()] == [1]


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rows = [("a", v) for v in (5.0, 1.0, 1.0, 3.0, 10.0, 7.0)] + [("b", 4.0)] + [("c", v) for v in (2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q_0_1, r.q_0_5, r.q_0_9) for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"]).collect()}
    for g in "abc":
        vals = [v for k, v in rows if k == g]
        exp = tuple(float(np.quantile(vals, p)) for p in (0.1, 0.5, 0.9))
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[g], exp)), (g, got[g], exp)
    overall = exact_quantiles(df, "v", [0.5]).first()[0]
    assert abs(overall - float(np.quantile([v for _, v in rows], 0.5))) < 1e-12


def test_exact_quantiles_large_group_path(spark):
    import numpy as np
    rows = [("hot", float(v % 97) / 7.0) for v in range(500)] + [("cold", v) for v in (1.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q_0_25, r.q_0_5) for r in exact_quantiles(df, "v", [0.25, 0.5], ["g"]).collect()}
    for g in ("hot", "cold"):
        vals = [v for k, v in rows if k == g]
        exp = (float(np.quantile(vals, 0.25)), float(np.quantile(vals, 0.5)))
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[g], exp)), (g, got[g], exp)
    whole = exact_quantiles(df, "v", [0.5]).first()[0]
    assert abs(whole - float(np.quantile([v for _, v in rows], 0.5))) < 1e-12


def test_pca_reconstruction_over_many_columns(spark):
    """x_hat = mean + P P'(x - mean), in a plan of components x columns terms."""
    import numpy as np

    from stormrail.operators import models as MD
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 64)) + 0.01 * rng.normal(size=(80, 64))
    cols = [f"f{i}" for i in range(64)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    model, means, _ = MD.fit_pca(df, cols, 3)
    out = MD.reconstruct_pca(df, model, means, cols).toPandas()
    p, m = model.pc.toArray(), x.mean(axis=0)
    given, got = np.array(out.x.tolist()), np.array(out.x_hat.tolist())
    assert np.abs(got - (m + (given - m) @ p @ p.T)).max() < 1e-9
