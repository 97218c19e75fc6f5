"""Segmented scans and two-level range sums against plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stormrail.operators import ordered as O
from stormrail.operators import sequences as SQ
from stormrail.operators import windows as W

START = dt.datetime(2024, 1, 1)


def series(seed, n, hot=0.5, span=2000):
    """One series with half of the rows, others, NULL keys and NULL times; (key, time, id, v)."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", None, "c"])
        time = None if rng.random() < 0.03 else START + dt.timedelta(minutes=rng.randint(0, span))
        rows.append((key, time, i, None if rng.random() < 0.1 else float(rng.randint(-9, 9))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "station string, time timestamp_ntz, id long, v double").repartition(5)


@pytest.mark.parametrize("block", [7, 64, 100_000])
@pytest.mark.parametrize("keys", [["station"], []])
def test_scan_window_equals_plain_window(spark, block, keys):
    df = frame(spark, series(1, 700))

    def compute(w):
        return {"s": F.sum("v").over(w.rowsBetween(-9, 2)), "p": F.lag("id", 3).over(w),
                "l": F.collect_list("id").over(w.rowsBetween(-4, -1)), "n": F.lead("id").over(w)}

    plain = Window.partitionBy(*keys).orderBy("time", "id")
    want = df.select("*", *[v.alias(k) for k, v in compute(plain).items()])
    got = O.scan_window(df, keys, ["time", "id"], compute, k_before=9, k_after=2, block_rows=block)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("gap", [600, "mode"])
@pytest.mark.parametrize("block", [5, 100_000])
def test_gap_periods_keep_every_row(spark, gap, block):
    rows = series(2, 400, span=40_000)
    got = SQ.gap_periods(frame(spark, rows), "station", "time", gap, ["id"], block_rows=block).collect()
    want, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for key, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or START, r[2]))
        steps = [None] + [(b[1] - a[1]).total_seconds() if a[1] and b[1] else None for a, b in zip(rs, rs[1:])]
        counts = {s: steps.count(s) for s in steps if s is not None}
        limit = min(counts, key=lambda s: (-counts[s], s)) if gap == "mode" else gap
        period = 0
        for r, s in zip(rs, steps):
            period += s is not None and s > limit
            want.append((key, r[2], period))
    assert sorted(map(str, want)) == sorted(str((r.station, r.id, r.period)) for r in got)


def test_one_long_series_is_spread_over_all_tasks(spark):
    """A million rows of one station: no task of the scan holds much more than its share of the blocks."""
    df = spark.range(1_000_000).select(F.lit("S").alias("station"), F.timestamp_add(
        "SECOND", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("time"), "id")
    out = O.scan_window(df, ["station"], ["time"], lambda w: {"p": F.lag("id").over(w)}, k_before=1, keep=True)
    facts = out.groupBy("_sw_block").agg(F.count("*").alias("n"), F.count(F.when(F.col("p") == F.col("id") - 1, 1))
                                         .alias("ok")).collect()
    assert len(facts) == 16 and max(r.n for r in facts) == O.BLOCK_ROWS and sum(r.ok for r in facts) == 999_999


@pytest.mark.parametrize("span, bucket", [(3600, 86400), (3600, 600), (3600, 3600), (5000, 700), (0, 60), (7201, 3600)])
def test_range_sums_equal_plain_window(spark, span, bucket):
    df = frame(spark, series(3, 500))
    got = O.range_sums(df, "station", "time", span, {"s": F.col("v"), "n": F.col("v").isNotNull().cast("long")}, bucket)
    rows = [tuple(r) for r in df.collect()]
    want = []
    for key, time, i, v in rows:
        near = [] if time is None else [r[3] for r in rows if r[0] == key and r[1] is not None
                                        and 0 <= (time - r[1]).total_seconds() <= span]
        held = [x for x in near if x is not None]
        want.append((key, time, i, v, sum(held) if held else None, len(held) if near else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_running_mean_wider_than_a_bucket(spark):
    rows = [("S", START + dt.timedelta(hours=h), h, float(h)) for h in range(100) if h % 7]
    got = W.running_mean(frame(spark, rows), "v", 60, bucket_days=1).collect()
    by = {h: v for _, _, h, v in rows}
    for r in got:
        held = [by[h] for h in range(r.id - 59, r.id + 1) if h in by]
        assert r.v_mean60h == pytest.approx(sum(held) / len(held))


def test_time_steps_and_sequences_keep_null_times_and_keys(spark):
    df = frame(spark, [("a", None, 1, 1.0), ("b", START, 2, 2.0), (None, START, 3, 3.0), (None, None, 4, 4.0)])
    steps = {r.id: r.step for r in SQ.time_steps(df, "time", 2).collect()}
    assert steps == {1: 1, 4: 1, 2: 2, 3: 2}
    seqs = SQ.sliding_sequences(df, ["v"], "v", 1, tiebreak=["id"], block_rows=2).collect()
    assert [(r.id, r.sequence) for r in seqs] == [(3, [[4.0]])]
