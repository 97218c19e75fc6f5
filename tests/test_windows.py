"""Windows: the bucketed plan equals a plain per-key window, also with tiny
buckets and one hot key; reference edge cases of WIN3/WIN5/WIN7."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stormrail.operators.ordered import bucketed_window, global_row_number
from stormrail.operators import windows as W
from stormrail.operators.sequences import gap_periods


def _series(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    for st, count in (("HOT", n), ("A", n // 8), ("B", n // 10)):
        t = t0
        for _ in range(count):
            t += dt.timedelta(hours=rnd.choice([1, 1, 1, 2, 5, 30, 70]))
            rows.append((st, t, rnd.choice([None, rnd.random() * 10, -1.0])))
    return spark.createDataFrame(rows, "station string, time timestamp_ntz, prec double")


def test_bucketed_rows_equals_plain(spark):
    df = _series(spark)
    def compute(w):
        return {"s3": F.sum("prec").over(w.rowsBetween(-2, 0)),
                "nxt": F.first("prec").over(w.rowsBetween(1, 1)),
                "seq": F.collect_list(F.coalesce("prec", F.lit(0.0))).over(w.rowsBetween(-3, 1))}
    got = bucketed_window(df, ["station"], ["time"], compute, k_before=3, k_after=1, bucket_days=1)
    w = Window.partitionBy("station").orderBy("time")
    exp = df.select("*", *[v.alias(k) for k, v in compute(w).items()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_bucketed_range_equals_plain(spark):
    df = _series(spark)
    span = 5 * 3600
    def compute(w):
        return {"m": F.avg("prec").over(w.rangeBetween(-span, 0))}
    got = bucketed_window(df, ["station"], ["time"], compute, range_before_s=span, bucket_days=1)
    sec = F.unix_seconds(F.col("time").cast("timestamp"))
    exp = df.withColumn("_s", sec).withColumn(
        "m", F.avg("prec").over(Window.partitionBy("station").orderBy("_s").rangeBetween(-span, 0))).drop("_s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_win3_first_rows_and_missing(spark):
    rows = [("S", dt.datetime(2024, 1, 1, h), v) for h, v in enumerate([1.0, -1.0, 2.0, 3.0, None, 1.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "station string, time timestamp_ntz, prec double")
    out = W.precip_sums_sentinel(df, "prec", names=["s3", "s6"]).orderBy("time").collect()
    assert [r.s3 for r in out] == [-99.0, -99.0, -99.0, 5.0, None, None, None, 4.0]
    assert [r.s6 for r in out][:6] == [-99.0] * 6 and out[6].s6 is None


def test_win5_hole(spark):
    hours = [0, 1, 2, 6, 7]
    df = spark.createDataFrame([("S", dt.datetime(2024, 1, 1, h), float(h)) for h in hours],
                               "station string, time timestamp_ntz, delay double")
    out = {r.time.hour: r.delay_mean3h for r in W.running_mean(df, "delay", 3).collect()}
    assert out == {0: 0.0, 1: 0.5, 2: 1.0, 6: 6.0, 7: 6.5}


def test_win7_gap_boundary(spark):
    t0 = dt.datetime(2024, 1, 1)
    ts = [t0, t0 + dt.timedelta(days=30), t0 + dt.timedelta(days=60, seconds=1)]
    df = spark.createDataFrame([("S", t) for t in ts], "station string, time timestamp_ntz")
    got = [r.period for r in gap_periods(df).orderBy("time").collect()]
    assert got == [0, 0, 1]


def test_global_row_number_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = global_row_number(df, ["k"], "rn").collect()
    assert all(r.rn == r.k + 1 for r in got)


def test_bucketed_rows_with_hour_buckets(spark):
    df = _series(spark, n=300, seed=3)
    def compute(w):
        return {"s2": F.sum("prec").over(w.rowsBetween(-2, 0)), "lag": F.lag("prec").over(w)}
    got = bucketed_window(df, ["station"], ["time"], compute, k_before=2, bucket_seconds=7200)
    w = Window.partitionBy("station").orderBy("time")
    exp = df.select("*", *[v.alias(k) for k, v in compute(w).items()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_bucketed_plan_partitions_by_key_and_bucket(spark):
    df = _series(spark, n=50)
    out = bucketed_window(df, ["station"], ["time"], lambda w: {"s": F.sum("prec").over(w.rowsBetween(-1, 0))},
                          k_before=1)
    import io
    from contextlib import redirect_stdout
    buf = io.StringIO()
    with redirect_stdout(buf):
        out.explain()
    plan = buf.getvalue()
    assert "hashpartitioning(station" in plan and "_bw_bucket" in plan


def test_precip_sums_by_time_range(spark):
    hours = [0, 1, 2, 5, 6]
    df = spark.createDataFrame([("S", dt.datetime(2024, 1, 1, h), 1.0) for h in hours],
                               "station string, time timestamp_ntz, prec double")
    rows = {r.time.hour: r.p3 for r in W.precip_sums(df, "prec", sizes=(3,), names=["p3"]).collect()}
    hrs = {r.time.hour: r.p3 for r in W.precip_sums(df, "prec", sizes=(3,), names=["p3"], by="time").collect()}
    assert rows == {0: 1.0, 1: 2.0, 2: 3.0, 5: 3.0, 6: 3.0}
    assert hrs == {0: 1.0, 1: 2.0, 2: 3.0, 5: 1.0, 6: 2.0}
