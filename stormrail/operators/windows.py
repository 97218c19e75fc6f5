"""Per-station time-series windows (WIN1-WIN6).

All per-station ordered windows go through ``bucketed_window`` or
``range_sums``, so a hot station is split over many tasks by time bucket (see
``ordered.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.functions.constants import MISSING
from stormrail.operators.ordered import bucketed_window, range_sums


def _order(time: str, tiebreak: Sequence[str]) -> list[str]:
    return [time, *tiebreak]


def precip_sums(df: DataFrame, value: str = "prec", station: str = "station", time: str = "time",
                sizes: Sequence[int] = (3, 6), names: Sequence[str] | None = None,
                tiebreak: Sequence[str] = (), nan_poisons: bool = True,
                bucket_days: int = 28, by: str = "rows") -> DataFrame:
    """WIN1 / WIN2: sum of the current and the previous ``n-1`` rows per
    station (rows, not hours: gaps stretch the frame, as in the ingest job).
    ``by="time"`` sums the last ``n`` hours instead (RANGE frame), so gaps
    shorten the frame.

    NULLs are skipped by the sum; with ``nan_poisons`` a NaN anywhere in the
    frame makes the sum NULL (the ingest job's NaN text poisons the frame).
    One shuffle serves every size (same partitioning and order).
    """
    names = list(names or [f"{value}_{n}h" for n in sizes])
    kmax = max(sizes) - 1

    if by == "time":
        for n, name in zip(sizes, names):
            v = F.col(value)
            df = range_sums(df, station, time, (n - 1) * 3600, {
                name: F.when(~F.isnan(v), v), "_sr_bad": F.isnan(v).cast("long")}, bucket_days * 86400)
            if nan_poisons:
                df = df.withColumn(name, F.when(F.coalesce("_sr_bad", F.lit(0)) == 0, F.col(name)))
            df = df.drop("_sr_bad")
        return df

    def compute(w):
        out = {}
        for n, name in zip(sizes, names):
            fr = w.rowsBetween(-(n - 1), 0)
            v = F.col(value)
            s = F.sum(F.when(~F.isnan(v), v)).over(fr)
            if nan_poisons:
                bad = F.max(F.isnan(v).cast("int")).over(fr)
                s = F.when(F.coalesce(bad, F.lit(0)) == 1, F.lit(None).cast("double")).otherwise(s)
            out[name] = s
        return out

    return bucketed_window(df, [station], _order(time, tiebreak), compute, k_before=kmax,
                           bucket_days=bucket_days)


def precip_sums_sentinel(df: DataFrame, value: str = "prec", station: str = "station",
                         time: str = "time", sizes: Sequence[int] = (3, 6),
                         names: Sequence[str] | None = None, tiebreak: Sequence[str] = (),
                         bucket_days: int = 28) -> DataFrame:
    """WIN3: scoring-path sums. Negative values count as 0; the first ``n``
    rows of a station stay -99; a frame holding a missing value is missing;
    a negative total is -99."""
    names = list(names or [f"{value}_{n}h" for n in sizes])
    kmax = max(sizes)

    def compute(w):
        v = F.when(F.col(value) < 0, F.lit(0.0)).otherwise(F.col(value))
        out = {}
        for n, name in zip(sizes, names):
            fr = w.rowsBetween(-(n - 1), 0)
            before = F.count(F.lit(1)).over(w.rowsBetween(-n, -1))
            s = F.sum(v).over(fr)
            full = F.count(v).over(fr) == n
            out[name] = (F.when(before < n, F.lit(MISSING))
                         .when(~full, F.lit(None).cast("double"))
                         .when(s < 0, F.lit(MISSING)).otherwise(s))
        return out

    return bucketed_window(df, [station], _order(time, tiebreak), compute, k_before=kmax,
                           bucket_days=bucket_days)


def drop_first_rows(df: DataFrame, n: int = 6, station: str = "station", time: str = "time",
                    tiebreak: Sequence[str] = (), bucket_days: int = 28) -> DataFrame:
    """WIN4: drop the first ``n`` rows of every station's series."""
    def compute(w):
        return {"_sr_before": F.count(F.lit(1)).over(w.rowsBetween(-n, -1))}

    out = bucketed_window(df, [station], _order(time, tiebreak), compute, k_before=n,
                          bucket_days=bucket_days)
    return out.where(F.col("_sr_before") >= n).drop("_sr_before")


def running_mean(df: DataFrame, value: str = "delay", hours: int = 6, station: str = "station",
                 time: str = "time", out: str | None = None, bucket_days: int = 28) -> DataFrame:
    """WIN5: mean of ``value`` over the last ``hours`` hours (current hour
    included) per station; missing hours are simply absent (min_periods=1).
    Expects one row per (station, time) — aggregate first otherwise."""
    out = out or f"{value}_mean{hours}h"
    summed = range_sums(df, station, time, (hours - 1) * 3600, {
        "_sr_sum": F.col(value).cast("double"), "_sr_n": F.col(value).isNotNull().cast("long")}, bucket_days * 86400)
    return summed.withColumn(out, F.col("_sr_sum") / F.nullif("_sr_n", F.lit(0))).select(*df.columns, out)


def zero_below_step_mean(df: DataFrame, value: str = "delay", limit: float = 0.0,
                         time: str = "time") -> DataFrame:
    """WIN6: keep ``value`` only where the mean of that time step >= limit,
    else 0. A per-time mean is an aggregate joined back: partial aggregation
    runs before the shuffle, and the join side is one row per time step."""
    means = df.groupBy(time).agg(F.avg(value).alias("_sr_step_mean"))
    j = df.join(means, time)
    return j.withColumn(value, F.when(F.col("_sr_step_mean") >= F.lit(float(limit)), F.col(value))
                        .otherwise(F.lit(0.0))).drop("_sr_step_mean")
