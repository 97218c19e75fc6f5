"""Ordered computations that stay balanced when one key is hot.

Two building blocks used by the time-series, split and curve operators:

``bucketed_window``
    A per-key window ordered by time, with a frame of at most ``k_before``
    preceding / ``k_after`` following rows (or a time range). A plain
    ``Window.partitionBy(key)`` puts every row of a key into one task; if one
    station holds a third of the data, one task does a third of the work.
    Here the window is partitioned by ``(key, time bucket)``, so a key's rows
    spread over as many tasks as it has buckets. Only rows whose frame crosses
    a bucket edge (the first ``k_before`` / last ``k_after`` rows of each
    bucket, or the rows within the range of an edge) are recomputed exactly in
    a second pass over *edge rows only*: at most ``2(k_before + k_after)``
    rows per bucket, so
    that pass is bounded by the number of buckets (time span), not by the
    data volume.

``scan_window``
    The same for ROWS frames without any assumption about time: rows are
    numbered in (key, order), cut into blocks of equally many rows, and each
    block also gets the last rows of the block before it (its halo), as many as
    a frame reaches back. A series of any length is spread evenly, and the rows
    sent twice are ``k`` for each block.

``range_sums``
    Sums over the last so many seconds of a series, from two levels: the rows
    of the frame's two end buckets, and the sums of the whole buckets between.

``prefix_sums``
    Global running sums in a total order without a single-partition window:
    range-partition, sum locally, add the offsets of earlier partitions (one
    row for each partition).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DEFAULT_BUCKET_DAYS = 28


def epoch_seconds_ntz(ts) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ, zone-free."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return (F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400
            + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t)).cast("long"))


def _bucket(ts: str, bucket_s: int) -> Column:
    return F.floor(epoch_seconds_ntz(ts) / F.lit(bucket_s)).cast("long")


def bucketed_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[WindowSpec], dict[str, Column]],
    k_before: int = 0,
    k_after: int = 0,
    range_before_s: int | None = None,
    range_after_s: int | None = None,
    bucket_days: int = DEFAULT_BUCKET_DAYS,
    bucket_expr: Column | None = None,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Add the columns returned by ``compute(window_spec)`` to ``df``.

    ``order[0]`` must be the (TIMESTAMP_NTZ) time column; further ``order``
    entries break ties so that the order is total. ``compute`` receives a
    ``WindowSpec`` already partitioned and ordered and must only use frames
    within ``k_before``/``k_after`` rows (ROWS) or within
    ``range_before_s``/``range_after_s`` seconds of the time (RANGE; the
    spec is then ordered by whole epoch seconds, so use
    ``spec.rangeBetween(-seconds, 0)``).
    The result equals ``Window.partitionBy(*keys).orderBy(*order)``.

    ``bucket_expr`` replaces the time bucket by any expression that is
    non-decreasing in ``order`` (ROWS frames only), e.g. a latitude band.
    ``bucket_seconds`` (default ``bucket_days`` days) sets the bucket width:
    choose it so that one key's rows in one bucket fit a task (hourly data:
    weeks; per-second sensor data: minutes).
    """
    keys = list(keys)
    order = list(order)
    ts = order[0]
    cols = df.columns
    b = "_bw_bucket"
    use_range = range_before_s is not None or range_after_s is not None
    if bucket_expr is not None and use_range:
        raise ValueError("bucket_expr only supports ROWS frames")
    width = int(bucket_seconds or bucket_days * 86400)
    base = df.withColumn(b, bucket_expr if bucket_expr is not None else _bucket(ts, width))
    if use_range:
        # RANGE frames are expressed on whole epoch seconds of the time column
        base = base.withColumn("_bw_sec", epoch_seconds_ntz(ts))
        order = ["_bw_sec"] + order[1:]
        cols = cols + ["_bw_sec"]
    if use_range:
        span = max(int(range_before_s or 0), int(range_after_s or 0))
        if span > width:
            raise ValueError("range frame wider than a bucket")
        rb = int(range_before_s or 0)
        ra = int(range_after_s or 0)
        sec = F.col("_bw_sec")
        start = F.col(b) * width
        end = start + width
        # flags are plain columns below the window: no predicate on the
        # partition columns is inferred and pushed into one branch only
        base = base.withColumn("_bw_fix", (sec < start + rb) | (sec >= end - ra)) \
                   .withColumn("_bw_edge", (sec < start + rb + ra) | (sec >= end - rb - ra))
    local = Window.partitionBy(*keys, b).orderBy(*order)
    whole = Window.partitionBy(*keys, b)
    out_local = compute(local)
    base = base.select("*", *[v.alias(k) for k, v in out_local.items()])
    names = list(out_local)
    if not use_range:
        # a fixed row's frame reaches k_before + k_after rows into the bucket
        kmax = k_before + k_after
        rn = F.row_number().over(local)
        cnt = F.count(F.lit(1)).over(whole)
        base = base.withColumn("_bw_rn", rn).withColumn("_bw_n", cnt)
        base = base.withColumn("_bw_fix", (F.col("_bw_rn") <= k_before)
                               | (F.col("_bw_n") - F.col("_bw_rn") < k_after)) \
                   .withColumn("_bw_edge", (F.col("_bw_rn") <= kmax) | (F.col("_bw_n") - F.col("_bw_rn") < kmax))
    # Both branches read the same columns of ``base`` (the fixed branch
    # refers to the local values too), so their plans below the filters are
    # identical and Spark shuffles the input of the local window only once
    # (the exchange is reused).
    inner = base.where(~F.col("_bw_fix")).select(*cols, *names)
    edge = base.where(F.col("_bw_edge")).select(*cols, *names, "_bw_fix")
    wide = Window.partitionBy(*keys).orderBy(*order)
    out_edge = compute(wide)
    fixed = edge.select(*cols, "_bw_fix", *names, *[v.alias(f"_bw_w_{k}") for k, v in out_edge.items()]) \
                .where(F.col("_bw_fix")) \
                .select(*cols, *[F.when(F.col("_bw_fix"), F.col(f"_bw_w_{k}")).otherwise(F.col(k)).alias(k)
                                 for k in names])
    out = inner.unionByName(fixed)
    return out.drop("_bw_sec") if use_range else out


def _ranged(df: DataFrame, order: Sequence[Column], pid: str) -> DataFrame:
    """Rows sorted over all partitions, with the number of their partition: one range shuffle. AQE sets the number of
    partitions from the size of the shuffle."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(pid, F.spark_partition_id())


def _offsets(rows: DataFrame, pid: str, totals: dict[str, Column]) -> DataFrame:
    """(pid, offsets): for each partition the totals of those before it. One row for each partition, so the window
    runs over a few thousand rows at most."""
    sums = rows.groupBy(pid).agg(*[t.alias(k) for k, t in totals.items()])
    w = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col(pid).alias("_ps_p"), *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"_ps_o_{k}")
                                                    for k in totals])


def prefix_sums(df: DataFrame, order: Sequence, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Running (inclusive) sums of the numeric columns ``sums`` in the total order ``order``, unique per row.

    Rows are shuffled once, by range, and sorted; running sums inside a partition are carried from batch to batch as
    the sorted rows stream by, and the totals of earlier partitions are added. Range bounds come from sampling, so
    the sorted rows are checkpointed once: totals and rows then come from the same partitioning, also after a lost
    executor. Null values count as 0.
    """
    import numpy as np
    import pyarrow as pa

    from stormrail.session import cut_lineage
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    if descending:
        ocols = [o.desc() for o in ocols]
    names, pid = list(sums), "_ps_pid"
    rows = _ranged(df.select("*", *[F.coalesce(v, F.lit(0)).alias(f"_ps_l_{k}") for k, v in sums.items()]), ocols, pid)
    at = [rows.columns.index(f"_ps_l_{k}") for k in names]

    def running(batches):
        carried = [0] * len(at)
        for batch in batches:
            columns = list(batch.columns)
            for j, i in enumerate(at):
                x = np.cumsum(columns[i].to_numpy(zero_copy_only=False)) + carried[j]
                carried[j] = x[-1] if len(x) else carried[j]
                columns[i] = pa.array(x, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    # the value itself stays beside its running sum, so a partition's total does not depend on the order of rows
    rows = rows.select("*", *[F.col(f"_ps_l_{k}").alias(f"_ps_v_{k}") for k in names])
    local = cut_lineage(rows.mapInArrow(running, rows.schema))
    offsets = _offsets(local, pid, {k: F.sum(f"_ps_v_{k}") for k in names})
    joined = local.join(offsets, F.col(pid) == F.col("_ps_p"))
    return joined.select(*df.columns, *[(F.col(f"_ps_l_{k}") + F.col(f"_ps_o_{k}")).alias(k) for k in names])


def global_row_number(df: DataFrame, order: Sequence, name: str = "row_no") -> DataFrame:
    """1-based position of each row in the total order ``order``: one range shuffle, the counter of the sorting task,
    and the row counts of earlier partitions."""
    from stormrail.session import cut_lineage
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    pid, at = "_ps_pid", "_ps_at"
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = cut_lineage(_ranged(df, ocols, pid).withColumn(at, in_task))
    joined = rows.join(_offsets(rows, pid, {"n": F.count(F.lit(1))}), F.col(pid) == F.col("_ps_p"))
    return joined.select(*df.columns, (F.col(at) + F.col("_ps_o_n")).alias(name))


#: Rows of a block of ``scan_window``.
BLOCK_ROWS = 65536


def scan_window(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                compute: Callable[[WindowSpec], dict[str, Column]], k_before: int = 0, k_after: int = 0,
                block_rows: int = 0, keep: bool = False) -> DataFrame:
    """Add the columns that ``compute`` makes from a window over each series of ``keys`` in ``order`` (total within a
    series; NULLs first). NULL keys are a series. Without keys the whole table is one series.

    Frames of ``compute`` must lie within ``k_before`` / ``k_after`` rows. Rows of a series stand side by side in the
    numbering, so what a frame needs is in its row's block or in the halo that the neighbouring blocks send. ``keep``
    leaves the row's block and number in ``_sw_block`` and ``_sw_no``; rows then are partitioned by block and key, and
    sorted.
    """
    size = block_rows or BLOCK_ROWS
    keys, names = list(keys), df.columns
    at = F.col("_sw_no") - 1
    rows = global_row_number(df, [*keys, *order], "_sw_no")
    block = F.floor(at / size).cast("long")
    if k_before or k_after:
        first, final = F.floor((at - k_after) / size).cast("long"), F.floor((at + k_before) / size).cast("long")
        rows = rows.withColumn("_sw_block", F.explode(F.sequence(first, final)))
    else:
        rows = rows.withColumn("_sw_block", block)
    w = Window.partitionBy("_sw_block", *keys).orderBy("_sw_no")
    made = compute(w)
    out = rows.select(*rows.columns, *[v.alias(k) for k, v in made.items()]).where(F.col("_sw_block") == block)
    return out if keep else out.select(*names, *made)


def range_sums(df: DataFrame, key: str, time: str, span_s: int, sums: dict[str, Column],
               bucket_s: int = DEFAULT_BUCKET_DAYS * 86400) -> DataFrame:
    """Add the sums of ``sums`` (NULL where nothing is summed) over the rows of the same series whose time lies at most
    ``span_s`` whole seconds back; rows of the same time and later ones within it count like in a RANGE frame.

    A frame is the end of its first bucket, the whole buckets between, and the beginning of its last one. The last part
    is a window inside (key, bucket). For the first part the frame's lower edge goes as a row of its own to the bucket
    it falls into and picks up what lies behind it there. Whole buckets are summed from one row for each (key, bucket).
    So no window ever holds more than the rows of one series in one bucket, and ``bucket_s`` may be shorter than the
    span. NULL keys are a series; rows without a time have NULL sums.
    """
    from stormrail.operators.sampling import null_safe_join
    names, cols = list(sums), df.columns
    base = df.select("*", *[v.alias(f"_rs_v_{k}") for k, v in sums.items()], epoch_seconds_ntz(time).alias("_rs_sec"))
    base = base.withColumn("_rs_b", F.floor(F.col("_rs_sec") / bucket_s).cast("long")).withColumn(
        "_rs_b0", F.floor((F.col("_rs_sec") - span_s) / bucket_s).cast("long"))
    inside = Window.partitionBy(key, "_rs_b").orderBy("_rs_sec").rangeBetween(-span_s, 0)
    timed = F.col("_rs_sec").isNotNull()
    right = base.select("*", *[F.when(timed, F.sum(f"_rs_v_{k}").over(inside)).alias(f"_rs_r_{k}") for k in names])
    crosses = F.coalesce(F.col("_rs_b0") < F.col("_rs_b"), F.lit(False))
    whole = right.where(~crosses).select(*cols, *[F.col(f"_rs_r_{k}").alias(k) for k in names])

    values = [f"_rs_v_{k}" for k in names]
    edges = base.where(crosses).select(key, F.col("_rs_b0").alias("_rs_b"), (F.col("_rs_sec") - span_s).alias("_rs_sec")) \
                .distinct().select("*", *[F.lit(None).cast(base.schema[v].dataType).alias(v) for v in values],
                                   F.lit(True).alias("_rs_edge"))
    both = base.where(timed).select(key, "_rs_b", "_rs_sec", *values, F.lit(False).alias("_rs_edge")).union(edges)
    behind = Window.partitionBy(key, "_rs_b").orderBy(F.col("_rs_sec").desc()).rangeBetween(
        Window.unboundedPreceding, 0)
    left = both.select("*", *[F.sum(f"_rs_v_{k}").over(behind).alias(f"_rs_l_{k}") for k in names]).where("_rs_edge") \
               .select(key, (F.col("_rs_sec") + span_s).alias("_rs_sec"), *[f"_rs_l_{k}" for k in names])
    ends = null_safe_join(right.where(crosses), left, [key, "_rs_sec"], "left")
    parts = [["_rs_r_", "_rs_l_"]] * len(names)
    if span_s >= bucket_s:
        # whole buckets between: their number is one of two, as the frame's edges fall
        m = span_s // bucket_s
        buckets = base.where(timed).groupBy(key, "_rs_b").agg(*[F.sum(v).alias(v) for v in values])
        along = Window.partitionBy(key).orderBy("_rs_b")
        mids = buckets.select(key, "_rs_b", *[F.sum(f"_rs_v_{k}").over(along.rangeBetween(1 - n, -1)).alias(
            f"_rs_m{n - m}_{k}") for k in names for n in (m, m + 1) if n > 1])
        ends = null_safe_join(ends, mids, [key, "_rs_b"], "left")
        n = F.col("_rs_b") - F.col("_rs_b0")
        for k in names:
            few = F.col(f"_rs_m0_{k}") if m > 1 else F.lit(None)
            ends = ends.withColumn(f"_rs_m_{k}", F.when(n == m, few).otherwise(F.col(f"_rs_m1_{k}")))
        parts = [["_rs_r_", "_rs_m_", "_rs_l_"]] * len(names)

    def total(k, prefixes):
        found = [F.col(p + k) for p in prefixes]
        some = found[0].isNotNull()
        for f in found[1:]:
            some = some | f.isNotNull()
        return F.when(some, sum((F.coalesce(f, F.lit(0)) for f in found[1:]), F.coalesce(found[0], F.lit(0)))).alias(k)

    return whole.unionByName(ends.select(*cols, *[total(k, p) for k, p in zip(names, parts)]))
