"""Model operators: merged moments, chunked fits, searches, curves and the dual prediction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormrail.operators import metrics as M
from stormrail.operators import models as MD
from stormrail.operators import search as SR
from stormrail.operators.sampling import time_folds


def table(spark, n=240, seed=0, far=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + far
    y = 3.0 + 2.0 * x[:, 0] - 0.1 * x[:, 1] + 0.01 * rng.normal(size=n)
    rows = [(i, float(a), float(b), float(v), "s" if i % 3 else "t", int(v > np.median(y))) for i, ((a, b), v) in
            enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, station string, label int").repartition(4)


def stats_of(df, by=("label", "feature")):
    return {tuple(r[k] for k in by): (r["mean"], r["var"], r["prior"]) for r in df.collect()}


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_moments_of_batches_merge_to_the_whole(spark, far):
    df = table(spark, far=far)
    parts = [MD.gaussian_nb_moments(df.where(F.col("id") % 3 == k), ["a", "b"], "label") for k in range(3)]
    merged = MD.merge_moments(parts[2].union(parts[0]), ["label", "feature"]).union(parts[1])
    got, want = stats_of(MD.gaussian_nb_finish(merged, "label")), stats_of(MD.gaussian_nb_fit(df, ["a", "b"], "label"))
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_one_model_for_each_station(spark):
    df = table(spark)
    st = MD.gaussian_nb_finish(MD.gaussian_nb_moments(df, ["a", "b"], "label", ["station"]), "label", ["station"])
    got = {r.id: (r.pred, r.probability) for r in MD.gaussian_nb_predict(df, st, ["a", "b"], "label", ["id"], groups=["station"]).collect()}
    for s in "st":
        own = df.where(F.col("station") == s)
        alone = MD.gaussian_nb_predict(own, MD.gaussian_nb_fit(own, ["a", "b"], "label"), ["a", "b"], "label", ["id"])
        for r in alone.collect():
            assert got[r.id][0] == r.pred and got[r.id][1] == pytest.approx(r.probability, rel=1e-6)
            assert sum(r.probabilities.values()) == pytest.approx(1.0)
    other = df.limit(3).withColumn("station", F.lit("new"))
    lost = MD.gaussian_nb_predict(other, st, ["a", "b"], "label", ["id"], groups=["station"]).collect()
    assert len(lost) == 3 and all(r.pred is None for r in lost)


def test_chunked_fit_converges_whatever_the_order(spark):
    df = table(spark).cache()
    chunks = [df.where(F.col("id") % 3 == k) for k in range(3)]
    exact = MD.per_group_linear(df.withColumn("g", F.lit("all")), "g", ["a", "b"], "y").first()["coef"]
    for order in ((0, 1, 2), (2, 0, 1)):
        state = None
        for k in order * 6:
            state = MD.partial_fit_linear(chunks[k], ["a", "b"], "y", state)
        assert state.coefficients() == pytest.approx(exact, abs=0.01)
        again = None
        for k in order * 6:
            again = MD.partial_fit_linear(chunks[k], ["a", "b"], "y", again)
        assert again.coefficients() == pytest.approx(state.coefficients(), abs=1e-12)
    same = MD.partial_fit_linear(df.limit(0), ["a", "b"], "y", state)
    assert same.steps == state.steps


def test_search_ranks_by_the_metrics_own_direction_and_refits(spark):
    folds = time_folds(table(spark), ["id"], 3)
    for metric in ("rmse", "r2"):
        res, model, best = SR.random_search(folds, ["a", "b"], "y", "linear", {"regParam": [0.0, 50.0]}, metric=metric)
        rows = res.collect()
        assert [r["rank"] for r in rows] == [1, 2] and rows[0].params == "regParam=0.0" and best == {"regParam": 0.0}
        out = model.transform(folds).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        assert out < 0.1
    curve = SR.learning_curve(folds, ["a", "b"], "y", "linear", ["id"], regParam=0.0).collect()
    assert [r.train_percent for r in curve] == [10.0, 32.5, 55.0, 77.5, 100.0] and curve[-1].test_mean < 0.05
    with pytest.raises(ValueError):
        SR.random_search(folds.limit(0), ["a", "b"], "y", "linear", {"regParam": [0.0]})


def test_dual_prediction_uses_both_models(spark):
    df = table(spark)
    reg = MD.per_group_linear(df.withColumn("g", F.lit("all")), "g", ["a"], "y")
    st = MD.gaussian_nb_fit(df, ["a", "b"], "label")
    rows = MD.predict_dual(df, st, ["a", "b"], "label", reg, ["a"], ["id"], 0.6).collect()
    c = reg.first()["coef"]
    a = {r.id: r.a for r in df.collect()}
    assert len(rows) == 240 and {r["class"] for r in rows} == {0, 1}
    for r in rows:
        assert r.y_pred == pytest.approx(c[0] + c[1] * a[r.id]) and r["class"] == int(r.proba >= 0.6)
        assert r.dual == (r.y_pred if r["class"] else 0.0)


def test_macro_curve_equals_interpolation(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 300)
    y[y == 3] = 2  # class 3 has no curve
    p = np.round(rng.random((300, 4)) + 0.3 * np.eye(4)[y], 2)  # with ties
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "y int, p array<double>")
    curves = []
    for k in range(3):
        order = np.argsort(-p[:, k], kind="stable")
        s, hit = p[order, k], (y[order] == k)
        last = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
        curves.append((np.r_[0, np.cumsum(~hit)[last]] / (~hit).sum(), np.r_[0, np.cumsum(hit)[last]] / hit.sum()))
    x = np.unique(np.concatenate([c[0] for c in curves]))
    mean = sum(np.interp(x, *c) for c in curves) / 3
    got = M.macro_roc(df, "y", "p").orderBy("fpr").toPandas()
    assert got["fpr"].to_numpy() == pytest.approx(x) and got["tpr"].to_numpy() == pytest.approx(mean, abs=1e-9)
    area = M.curve_area(M.macro_roc(df, "y", "p")).first().auc
    assert area == pytest.approx(float(np.sum(np.diff(x) * (mean[1:] + mean[:-1]) / 2)), abs=1e-9)


def test_wide_heat_map_has_a_cell_for_every_station(spark):
    from stormrail.plans.heatmap import heatmap_wide
    long = spark.createDataFrame([("b", 1, 5.0), ("a", 1, 6.0), ("a", 2, 7.0), ("lost", 2, 1.0)],
                                 "station string, dayofyear int, scaled double")
    st = spark.createDataFrame([("a", 65.0), ("b", 60.0), ("c", 61.0)], "station string, lat double")
    columns, matrix = heatmap_wide(long, st)
    assert {r.station: r.column for r in columns.collect()} == {"b": 0, "c": 1, "a": 2}
    assert {r.dayofyear: r["values"] for r in matrix.collect()} == {1: [5.0, None, 6.0], 2: [None, None, 7.0]}
