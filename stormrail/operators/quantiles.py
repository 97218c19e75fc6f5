"""Exact quantiles by radix selection, for groups of any size.

Each round cuts the range that can still hold a wanted rank into equal bins,
counts the rows of each bin by partial aggregation, and keeps the one bin that
the rank falls into, until that bin holds a single value. A round reads only
the rows that the last one left in its ranges. There are so few bins that the
counts of all groups are at most ``CELLS`` rows, and once no more rows than that
are left they are counted by value, so what a task holds in memory does not
grow with the rows of a group. There is no sort and no shuffle of the rows; a
round hands on one row for each group and rank, and the only windows run over
the bins of one range. A group with a third of all rows is as many partial
counts as there are tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormrail.operators.sampling import null_safe_join
from stormrail.session import stored

#: Bins of a range in one round, at most and at least.
BINS, LEAST_BINS = 1024, 16
#: Bins of all ranges in one round, unless there are more ranges than that allows for; rows counted by value at the end.
CELLS = 1 << 18
_LARGEST = 1.7976931348623157e308


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Which of the bins of [lo, hi] a value falls into: non-decreasing in the value, and never the same for lo and hi. Values
    that are not finite have bins of their own, NaN the last one."""
    low, high = F.greatest(lo, F.lit(-_LARGEST)), F.least(hi, F.lit(_LARGEST))
    plain = F.greatest(F.abs(low), F.abs(high)) < 1e300
    half = F.when(plain, F.lit(1.0)).otherwise(F.lit(0.5))  # so that no difference overflows
    part = F.try_divide(v * half - low * half, high * half - low * half)
    return (F.when(F.isnan(v), F.lit(bins + 2)).when(v > _LARGEST, F.lit(bins + 1)).when(v < -_LARGEST, F.lit(-1))
            .otherwise(F.floor(F.coalesce(part, F.lit(0.0)) * bins)).cast("int"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), prefix: str = "q",
                    weight: str | None = None, higher: Sequence[float] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (as pandas and ``percentile``) per group.

    A NULL group is a group, NULL values do not count, NaN is larger than any number. ``weight``: how many rows a row
    stands for (a count of one or more). ``higher``: those of ``probs`` that are not interpolated but give the value
    at the next whole rank. Output columns ``<prefix>_<p>`` (0.5 -> q_0_5); without groups an empty input gives NULLs.
    A round narrows a range at least ``LEAST_BINS`` times unless its values are crowded at one end; the values of the
    groups are written once, and of them those that a second and later round still need.
    """
    groups = list(groups)
    by = groups or ["_q_all"]
    # -0.0 + 0.0 is 0.0
    d = df.where(F.col(value).isNotNull()).select(*(groups or [F.lit(0).alias("_q_all")]),
                                                  (F.col(value).cast("double") + F.lit(0.0)).alias("_v"),
                                                  (F.col(weight) if weight else F.lit(1)).cast("long").alias("_c"))
    values = stored(d, "values")

    def at(p):
        return (F.col("_n") - 1) * F.lit(float(p))

    ranks = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    state = values.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                    F.count(F.lit(1)).alias("_rows"))
    state = stored(state.select(*by, "_n", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_base"),
                                "_lo", "_hi", "_rows"), "ranks")
    first = True
    while True:
        left = state.where("_lo < _hi")
        cells = left.select(*by, "_base", F.col("_lo").alias("_cell"), "_hi", "_rows").distinct()
        size = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("_rows").alias("rows")).first()
        if not size["cells"]:
            break
        inside = null_safe_join(values, cells.drop("_rows"), by).where("_v >= _cell and _v <= _hi")
        if size["rows"] <= CELLS:
            place = F.col("_v")
        else:
            place = _bin(F.col("_v"), F.col("_cell"), F.col("_hi"),
                         max(LEAST_BINS, min(BINS, CELLS // size["cells"])))
            if not first:
                inside = stored(inside, "inside")
                values = inside.select(*by, "_v", "_c")
        first = False
        bins = inside.groupBy(*by, "_base", "_cell", place.alias("_bin")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.count(F.lit(1)).alias("_rows"))
        along = Window.partitionBy(*by, "_cell").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("_upto", F.col("_base") + F.sum("_c").over(along)).select(
            *by, "_cell", (F.col("_upto") - F.col("_c")).alias("_base"), "_upto", "_lo", "_hi", "_rows")
        wanted = left.select(*by, "_n", "_rank", F.col("_lo").alias("_cell"))
        found = null_safe_join(wanted, bins, [*by, "_cell"]).where("_rank >= _base and _rank < _upto")
        state = stored(state.where("not (_lo < _hi)").union(found.select(state.columns)), "ranks")

    def quantile(p):
        lower, upper = (F.max(F.when(F.col("_rank") == f(at(p)), F.col("_lo"))) for f in (F.floor, F.ceil))
        if p in higher:
            return upper.alias(f"{prefix}_{str(p).replace('.', '_')}")
        rest = F.max(at(p) - F.floor(at(p)))
        # no rest, no interpolation: the difference of infinite neighbours is not a number
        return F.when(rest == 0, lower).otherwise(lower + rest * (upper - lower)).alias(
            f"{prefix}_{str(p).replace('.', '_')}")

    aggs = [quantile(p) for p in probs]
    return state.groupBy(*groups).agg(*aggs) if groups else state.agg(*aggs)


def with_quantiles(aggregated: DataFrame, df: DataFrame, columns: dict[str, str], keys: Sequence[str],
                   probs: Sequence[float] = (0.5,)) -> DataFrame:
    """``aggregated`` (one row for each group of ``keys``) with quantiles of several columns of ``df``: ``columns`` maps
    output names to columns. With one probability the output has that name, else ``<name>_<p>``. All columns are
    selected together, in one set of rounds; a group without values has NULLs."""
    names = list(columns)
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(columns[n]).cast("double").alias("v")) for n in names])
    long = df.select(*keys, F.explode(each).alias("_e")).select(*keys, F.col("_e.name").alias("_name"),
                                                                F.col("_e.v").alias("_value"))
    q = exact_quantiles(long, "_value", probs, [*keys, "_name"], prefix="_p")
    tags = [str(p).replace(".", "_") for p in probs]
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == n, F.col(f"_p_{t}"))).alias(n if len(probs) == 1 else f"{n}_{t}")
        for n in names for t in tags])
    return null_safe_join(aggregated, wide, list(keys), "left")
