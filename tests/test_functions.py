"""FN* edge cases (FIXTURES.md section 2)."""

import math

from pyspark.sql import functions as F

from stormrail.functions import scalar as S


def _col(spark, values, typ="double"):
    if typ == "double":
        values = [None if v is None else float(v) for v in values]
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_fn1_class_limits(spark):
    df = _col(spark, [10, 10.01, 50, 100, 100.5, -3, None])
    got = [r[0] for r in df.select(S.class_by_limits("x")).collect()]
    assert got == [0, 1, 1, 2, 3, 0, 3]


def test_fn2_threshold_class(spark):
    df = _col(spark, [-1, 0, 0.1, 0.2, 0.5, 0.6, 0.9])
    assert [r[0] for r in df.select(S.threshold_class("x")).collect()] == [0, 0, 1, 1, 3, 3, 3]


def test_fn3_fn4(spark):
    df = _col(spark, [30, 20, 10, None])
    got = df.select(S.binary_class("x", 20), S.three_way("x", 20)).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, None), (0, 0), (0, None)]


def test_fn5_avg_delay(spark):
    df = spark.createDataFrame([(10.0, 0), (10.0, None), (10.0, 1), (10.0, 4)], "d double, n long")
    assert [r[0] for r in df.select(S.avg_delay("d", "n")).collect()] == [0.0, 0.0, 10.0, 2.5]


def test_fn7_fn8_text(spark):
    df = _col(spark, ["nan", "NaN", "null", "NULL", "", "-1.0", "-99", "abc"], "string")
    got = [r[0] for r in df.select(S.to_sentinel(S.text_to_double("x"))).collect()]
    assert got == [-99.0, -99.0, -99.0, -99.0, -99.0, -1.0, -99.0, -99.0]
    back = [r[0] for r in df.select(S.from_sentinel(S.to_sentinel(S.text_to_double("x")))).collect()]
    assert back[5] == -1.0 and back[6] is None


def test_fn20_pad_and_fn26_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    r = df.select(S.pad_array("a", 5), S.argmax("a")).first()
    assert list(r[0]) == [1.0, 3.0, 3.0, -99.0, -99.0] and r[1] == 1


def test_fn10_fn24_fn25(spark):
    df = spark.createDataFrame([(60.0, 25.0, 61.0, 25.0, -0.3)], "a double, b double, c double, d double, t double")
    r = df.select(S.equirect_km("a", "b", "c", "d"), S.soft_threshold("t", 0.1),
                  S.tanimoto(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))).first()
    assert abs(r[0] - 6371 * math.radians(1)) < 1e-6
    assert abs(r[1] + 0.2) < 1e-12
    assert abs(r[2] - 0.5) < 1e-12


def test_prj3_event_hour(spark):
    df = spark.createDataFrame([("2024-01-05", 7)], "d string, h int")
    r = df.select(S.event_hour("d", "h")).first()[0]
    assert str(r) == "2024-01-05 08:00:00"
