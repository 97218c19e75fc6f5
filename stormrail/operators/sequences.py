"""Series structure: gap periods (WIN7/WIN8), time-step and batch numbers
(WIN9), sliding sequences (WIN10/WIN11) and per-time-step batches (SEQ1).

Series are scanned in blocks of equally many rows with halo rows from the
neighbouring blocks (``ordered.scan_window``), so neither one long series nor
rows crowded in time make a large task. Global ranks are computed on the
distinct times only and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormrail.functions.constants import MISSING, PERIOD_GAP_SECONDS
from stormrail.operators.ordered import epoch_seconds_ntz, global_row_number, scan_window
from stormrail.operators.sampling import null_safe_join


def gap_periods(df: DataFrame, key: str = "station", time: str = "time",
                gap_seconds: int | str = PERIOD_GAP_SECONDS, tiebreak: Sequence[str] = (),
                out: str = "period", block_rows: int = 0) -> DataFrame:
    """WIN7: number the periods of each series; a new period starts where the
    step to the previous row exceeds the gap (a step equal to the gap stays
    in the period). ``gap_seconds='mode'`` uses each series' most frequent
    step (WIN8; ties -> the smallest).

    Every row stays: rows without a key are one series, and rows without a
    time come first in theirs and begin no period. A segmented scan: the step
    to the previous row needs a halo of one row for each block, the running
    count of new periods runs inside (block, series), and what a series has
    counted in earlier blocks comes from a table with one row for each block
    and series in it.
    """
    j = scan_window(df, [key], [time, *tiebreak], lambda w: {"_sr_prev": F.lag(time).over(w)}, k_before=1,
                    block_rows=block_rows, keep=True)
    j = j.withColumn("_sr_step", epoch_seconds_ntz(time) - epoch_seconds_ntz("_sr_prev")).drop("_sr_prev")
    if gap_seconds == "mode":
        steps = j.where(F.col("_sr_step").isNotNull()).groupBy(key, "_sr_step").agg(F.count(F.lit(1)).alias("_n"))
        # one row per series
        mode = steps.groupBy(key).agg(F.max_by("_sr_step", F.struct(F.col("_n"), -F.col("_sr_step"))).alias("_sr_gap"))
        j = null_safe_join(j, mode, [key], "left")
        gap = F.col("_sr_gap")
    else:
        gap = F.lit(int(gap_seconds))
    j = j.withColumn("_sr_flag", F.coalesce(F.col("_sr_step") > gap, F.lit(False)).cast("long"))
    w = Window.partitionBy("_sw_block", key).orderBy("_sw_no").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_sr_local", F.sum("_sr_flag").over(w))
    per_block = j.groupBy("_sw_block", key).agg(F.sum("_sr_flag").alias("_sr_tot"))
    earlier = Window.partitionBy(key).orderBy("_sw_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("_sw_block", key, F.sum("_sr_tot").over(earlier).alias("_sr_off")).where("_sr_off > 0")
    res = null_safe_join(j, offsets, ["_sw_block", key], "left")
    total = F.col("_sr_local") + F.coalesce("_sr_off", F.lit(0))
    return res.select(*[c for c in df.columns if c != out], total.cast("long").alias(out))


def time_steps(df: DataFrame, time: str = "time", n_timesteps: int = 24) -> DataFrame:
    """WIN9: dense rank of the time (1-based) and batch number
    floor((rank-1)/n_timesteps), ranked on the distinct times only; rows
    without a time share the first rank."""
    times = df.select(time).distinct()
    ranked = global_row_number(times, [time], "step")
    ranked = ranked.withColumn("batch", F.floor((F.col("step") - 1) / n_timesteps).cast("long"))
    return null_safe_join(df, ranked, [time])


def sliding_sequences(df: DataFrame, features: Sequence[str], target: str, length: int,
                      key: str | None = "station", time: str = "time", tiebreak: Sequence[str] = (),
                      skip_missing_target: bool = False, drop_last: bool = False, block_rows: int = 0) -> DataFrame:
    """WIN10 / WIN11: for each row, the feature vectors of the ``length``
    previous rows of its series (oldest first) and the row's target; rows
    without ``length`` predecessors are dropped. WIN11 also skips rows whose
    target is missing and the series' last row. ``key=None`` runs over the
    whole table in time order (the global form). Both are segmented scans with
    a halo of ``length`` rows; rows without a key are one series."""
    vec = F.array(*[F.col(f).cast("double") for f in features])
    base = df.withColumn("_sr_vec", vec)

    def compute(w):
        return {"_sr_seq": F.collect_list("_sr_vec").over(w.rowsBetween(-length, -1)),
                "_sr_has_next": F.count(F.lit(1)).over(w.rowsBetween(1, 1)) > 0}

    out = scan_window(base, [key] if key else [], [time, *tiebreak], compute, k_before=length, k_after=1,
                      block_rows=block_rows)
    out = out.where(F.size("_sr_seq") == length)
    if skip_missing_target:
        out = out.where(F.col(target).isNotNull())
    if drop_last:
        out = out.where(F.col("_sr_has_next"))
    return out.withColumnRenamed("_sr_seq", "sequence").drop("_sr_vec", "_sr_has_next")


def time_step_batches(df: DataFrame, features: Sequence[str], label: str, strategy: str = "pad",
                      time: str = "time", station: str = "station", quantile: float = 0.3,
                      batch_size: int | None = None, n_timesteps: int = 24,
                      sample_order: Column | None = None) -> DataFrame:
    """SEQ1: one row per time step with the stations' feature vectors and
    labels as arrays of equal size ``batch_size``:

    - ``pad``: size = largest step; smaller steps padded with -99;
    - ``sample``: size = smallest step; larger steps sampled down;
    - ``drop``: size = int(quantile of step sizes); smaller steps dropped,
      larger ones sampled down.

    Sampling keeps the first rows in ``sample_order`` (default: a hash of
    station and time, so the pick is repeatable). A step's list holds one
    row per station at that time (bounded by the station count).
    """
    sizes = df.groupBy(time).agg(F.count(F.lit(1)).alias("_sr_size"))
    if batch_size is None:
        if strategy == "pad":
            batch_size = sizes.agg(F.max("_sr_size")).scalar()
        elif strategy == "sample":
            batch_size = sizes.agg(F.min("_sr_size")).scalar()
        else:
            from stormrail.operators.quantiles import exact_quantiles
            batch_size = F.floor(exact_quantiles(sizes, "_sr_size", [quantile]).scalar())
    bs = batch_size if isinstance(batch_size, Column) else F.lit(int(batch_size))
    rows = df.join(sizes, time)
    if strategy == "drop":
        rows = rows.where(F.col("_sr_size") >= bs)
    order = sample_order if sample_order is not None else F.xxhash64(F.col(station), F.col(time).cast("string"))
    if strategy in ("sample", "drop"):
        # rank inside each time step without a per-time-step window
        from stormrail.operators.sampling import rank_within
        rows = rank_within(rows.withColumn("_sr_ord", order), [time], ["_sr_ord", station], "_sr_pick") \
            .where(F.col("_sr_pick") <= bs).drop("_sr_ord")
    item = F.struct(F.col(station).alias("station"),
                    F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
                    F.col(label).cast("double").alias("y"))
    g = rows.groupBy(time).agg(F.array_sort(F.collect_list(item)).alias("_sr_items"))
    g = g.select(time, F.transform("_sr_items", lambda r: r["x"]).alias("values"),
                 F.transform("_sr_items", lambda r: r["y"]).alias("labels"))
    if strategy == "pad":
        pad_vec = F.array_repeat(F.lit(MISSING), len(features))
        n_pad = F.greatest(F.lit(0), bs - F.size("values")).cast("int")
        g = g.select(time, F.concat("values", F.array_repeat(pad_vec, n_pad)).alias("values"),
                     F.concat("labels", F.array_repeat(F.lit(MISSING), n_pad)).alias("labels"))
    return time_steps(g, time, n_timesteps)
