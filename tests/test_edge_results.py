"""Results at the edges: missing values, tiny and empty inputs, badly scaled data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormrail.functions import scalar as S
from stormrail.operators.quantiles import exact_quantiles
from stormrail.operators import metrics as M
from stormrail.operators import models as MD
from stormrail.operators import ordered as O
from stormrail.operators import sampling as SM
from stormrail.sources import readers as RD
from stormrail.sources import sinks as SK


def test_rows_without_a_prediction_count_nowhere(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, None), (4.0, 3.0), (None, 9.0)], "y double, y_pred double")
    r = M.regression_metrics(df, median=True).first()
    assert (r.n, r.median_ae) == (2, 0.75)
    assert r.r2 == pytest.approx(1 - (0.25 + 1) / (2 * 2.25))


def test_null_labels_count_nowhere(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (None, 1), (1, None)], "y int, pred int")
    r = M.binary_metrics(df).first()
    assert (r.n, r.tp, r.fp, r.fn, r.pred_pos_share) == (2, 1, 1, 0, 1.0)
    assert {c.cls for c in M.per_class_report(df).collect()} == {"0", "1", "macro avg", "weighted avg"}


def test_micro_average(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 1)], "y int, pred int")
    r = M.micro_average(df).first()
    assert r.precision == r.recall == r.f1 == 0.5


def test_folds_of_fewer_rows_than_folds(spark):
    rows = SM.time_folds(spark.range(4), ["id"], 5).collect()
    assert len(rows) == 4 and all(r.test_fold is None and r.first_train_fold is None for r in rows)


def test_tanimoto_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "x array<double>, y array<double>")
    assert [r[0] for r in df.select(S.tanimoto("x", "y")).collect()] == [None, 1.0]


def test_fit_far_from_zero(spark):
    df = spark.range(200).select(F.lit("a").alias("g"), (F.col("id") + 1.7e9).alias("x"), (2.0 * F.col("id") + 3).alias("y"))
    coef = MD.per_group_linear(df, "g", ["x"], "y").first().coef
    assert coef[1] == pytest.approx(2.0, rel=1e-6) and coef[0] + coef[1] * 1.7e9 == pytest.approx(3.0, abs=1e-3)
    two = spark.range(100).select(F.lit("a").alias("g"), (F.col("id") % 7).cast("double").alias("p"),
                                  (F.col("id") % 5).cast("double").alias("q")).withColumn("y", F.expr("1 + 2 * p - q"))
    assert MD.per_group_linear(two, "g", ["p", "q"], "y").first().coef == pytest.approx([1.0, 2.0, -1.0])


def test_naive_bayes_of_constant_features(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (1, 1.0, 2), (1, 1.0, 3)], "label int, f double, id int")
    got = MD.gaussian_nb_predict(df, MD.gaussian_nb_fit(df, ["f"], "label"), ["f"], "label", ["id"]).collect()
    assert {r.pred for r in got} == {1} and got[0].probability == pytest.approx(2 / 3)


def test_two_header_lines(spark):
    path = SK.scratch_path(spark, "headers")
    spark.createDataFrame([("a;b",), ("unit;unit",), ("1;2",), ("3;4",)], "value string").coalesce(1).write.text(path)
    got = sorted((r.a, r.b) for r in RD.read_delimited(spark, path, ["a", "b"], skip_rows=2).collect())
    assert got == [(1.0, 2.0), (3.0, 4.0)]


def test_sampling_of_nothing_and_of_null_classes(spark):
    none = spark.createDataFrame([], "id long, class int")
    assert SM.ratio_downsample(none, ["id"], 2.0).count() == 0
    assert SM.downsample_to_smallest(none, ["id"]).count() == 0
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, None), (5, None)], "id long, class int")
    got = SM.downsample_to_smallest(df, ["id"]).groupBy("class").count().collect()
    assert {(r[0], r[1]) for r in got} == {(0, 2), (None, 2)}
    picked, rest = SM.pick_out(df, 2, ["id"])
    assert (picked.count(), rest.count()) == (2, 3)
    assert SM.exact_sample(df, 99, ["id"]).count() == 5


def test_samples_are_the_first_in_hash_order(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("class"))
    got = {r.id for r in SM.exact_sample(df, 700, ["id"]).collect()}
    ranked = df.select("id", SM.hash_order(["id"]).alias("h")).orderBy("h").limit(700).collect()
    assert got == {r.id for r in ranked}


def test_quantiles_keep_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), (None, 2.0), (None, 3.0), ("b", None)], "g string, v double")
    got = {r.g: r.q_0_5 for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {"a": 1.0, None: 2.5}


def test_prefix_sums_equal_a_plain_window(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(-5, 9, 500))]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    for descending in (False, True):
        got = {r.id: r.s for r in O.prefix_sums(df, ["id"], {"s": F.col("v")}, descending=descending).collect()}
        order = rows[::-1] if descending else rows
        assert got == dict(zip([i for i, _ in order], np.cumsum([v for _, v in order]).tolist()))
    assert [r.n for r in O.global_row_number(df, ["id"], "n").orderBy("id").collect()] == list(range(1, 501))


def test_missing_and_broken_models(spark):
    assert SK.load_model(SK.scratch_path(spark, "no-model")) is None
    path = SK.scratch_path(spark, "broken-model")
    spark.createDataFrame([("not json",)], "value string").write.text(f"{path}/metadata")
    with pytest.raises(Exception):
        SK.load_model(path)
