"""Edge cases listed in FIXTURES.md section 2 that other files do not cover."""

import datetime as dt

from pyspark.sql import functions as F

from stormrail.operators import aggregates as A
from stormrail.operators import filters as FL
from stormrail.operators import models as MD
from stormrail.operators import windows as W
from stormrail.operators.sequences import sliding_sequences, time_step_batches


def t(d, h=0, m=0):
    return dt.datetime(2024, 1, d, h, m)


def test_flt1_half_open(spark):
    df = spark.createDataFrame([(t(1),), (t(2),), (t(3),)], "time timestamp_ntz")
    got = [r.time for r in FL.time_range(df, "2024-01-01", "2024-01-03").collect()]
    assert sorted(got) == [t(1), t(2)]


def test_flt14_end_day_inclusive(spark):
    df = spark.createDataFrame([(t(5, 23, 59),), (t(6),)], "time timestamp_ntz")
    got = FL.tag_periods(df, [("2024-01-01", "2024-01-05")]).collect()
    assert [r.time for r in got] == [t(5, 23, 59)]


def test_agg9_band_edges(spark):
    rows = [(t(1), lat, 1.0, 10.0) for lat in (59.0, 59.01, 61.55, 61.56, 63.41, 63.42)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, y double, y_pred double")
    bands = sorted(r.band for r in A.band_quantiles(df).collect())
    # 59.0 is band 0 (not output); 61.55 -> 1; 63.41 -> 2
    assert bands == [1, 2, 3]
    counts = {r.band: r.avg_delay for r in A.band_quantiles(df).collect()}
    assert set(counts) == {1, 2, 3}


def test_agg13_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 10.0, 10.1)], "v double")
    h = {r.bin: r["count"] for r in A.fixed_histogram(df, "v", 0.0, 10.0, 11).collect()}
    assert h[0] == 1 and h[10] == 1 and sum(h.values()) == 2 and len(h) == 11


def test_win6_equal_limit_kept(spark):
    df = spark.createDataFrame([("A", t(1), 10.0), ("B", t(1), 30.0), ("A", t(2), 5.0)],
                               "station string, time timestamp_ntz, delay double")
    got = {(r.station, r.time.day): r.delay for r in W.zero_below_step_mean(df, "delay", 20.0).collect()}
    assert got == {("A", 1): 10.0, ("B", 1): 30.0, ("A", 2): 0.0}


def test_agg2_tie_first_row(spark):
    df = spark.createDataFrame([("T", "A", t(1), None), ("T", "B", t(1), None), ("T", "A", t(2), 1.0),
                                ("T", "B", t(2), 1.0)],
                               "ts string, st string, time timestamp_ntz, v double")
    got = {r.st for r in A.best_station(df, "ts", "st", ["v"], ["time", "st"]).collect()}
    assert got == {"A"}


def test_ftr1_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    st = MD.fit_standard_scaler(df, ["a", "b"])
    r = st.first()
    assert r.std_a == 1.0 and r.std_b == 1.0  # population std of (1, 3) is 1; constant -> 1
    out = sorted(tuple(x) for x in MD.apply_standard_scaler(df, st, ["a", "b"]).collect())
    assert out == [(-1.0, 0.0), (1.0, 0.0)]


def test_win10_win11_sequences(spark):
    rows = [("S", t(1, h), float(h), (None if h == 2 else float(h))) for h in range(5)]
    df = spark.createDataFrame(rows, "station string, time timestamp_ntz, x double, y double")
    s10 = sorted((r.time.hour, [v[0] for v in r.sequence]) for r in sliding_sequences(df, ["x"], "y", 3).collect())
    assert s10 == [(3, [0.0, 1.0, 2.0]), (4, [1.0, 2.0, 3.0])]
    s11 = [r.time.hour for r in sliding_sequences(df, ["x"], "y", 1, skip_missing_target=True, drop_last=True).collect()]
    # hour 0 has no predecessor, hour 2 misses its target, hour 4 is the last row
    assert sorted(s11) == [1, 3]


def test_seq1_strategies(spark):
    rows = [(t(1), "A", 1.0)] + [(t(2), s, 2.0) for s in "AB"] + [(t(3), s, 3.0) for s in "ABC"]
    df = spark.createDataFrame(rows, "time timestamp_ntz, station string, x double").withColumn("y", F.col("x"))
    pad = {r.time.day: (len(r["values"]), r.labels.count(-99.0)) for r in time_step_batches(df, ["x"], "y", "pad").collect()}
    assert pad == {1: (3, 2), 2: (3, 1), 3: (3, 0)}
    smp = {r.time.day: len(r["values"]) for r in time_step_batches(df, ["x"], "y", "sample").collect()}
    assert smp == {1: 1, 2: 1, 3: 1}
    drop = {r.time.day: len(r["values"]) for r in time_step_batches(df, ["x"], "y", "drop", quantile=0.5).collect()}
    # sizes 1, 2, 3 -> int(median) = 2: the 1-station step is dropped, the 3-station step sampled to 2
    assert drop == {2: 2, 3: 2}
