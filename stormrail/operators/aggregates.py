"""Aggregations (AGG1-AGG26).

Every aggregate here is a ``groupBy().agg()`` with partially-aggregatable
functions (count/sum/avg/min/max/min_by/var_pop), so a hot group is reduced
map-side before the shuffle. Exact medians and quantiles are selected by radix
(``quantiles.exact_quantiles``), never from a group's values in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormrail.functions.constants import AGG_PREFIXES
from stormrail.functions.scalar import hour_floor, lat_band, null_count
from stormrail.operators.quantiles import exact_quantiles, with_quantiles
from stormrail.session import stored


def _all_rows():
    """The whole of a table of one row for each class or bin."""
    return Window.partitionBy(F.lit(0))


# AGG1 -------------------------------------------------------------------------
def hourly_counts(events: DataFrame, station: str = "station", time: str = "time",
                  out: str = "count") -> DataFrame:
    """Events per station and hour (tumbling hour, labelled at its start)."""
    return events.groupBy(F.col(station).alias(station), hour_floor(time).alias(time)) \
                 .agg(F.count(F.lit(1)).cast("long").alias(out))


# AGG2 -------------------------------------------------------------------------
def best_station(obs: DataFrame, group: str, candidate: str, value_cols: Sequence[str],
                 order: Sequence[str]) -> DataFrame:
    """Per ``group`` keep only the rows of the candidate that owns the row with
    the fewest missing values (ties: first row in ``order``)."""
    nn = obs.withColumn("_sr_nnull", null_count(value_cols))
    pick = nn.groupBy(group).agg(
        F.min_by(candidate, F.struct("_sr_nnull", *order)).alias("_sr_best"))
    return nn.join(pick, group).where(F.col(candidate) == F.col("_sr_best")).drop("_sr_nnull", "_sr_best")


# AGG3 -------------------------------------------------------------------------
_AGGREGATES = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "sdev": F.stddev_pop}


def named_aggregate(col: str, sep: str = "_", prefixes: Sequence[str] = AGG_PREFIXES) -> str:
    """The aggregate that a column's name begins with (``min_temp`` -> minimum); the mean for any other name."""
    head = col.partition(sep)[0]
    return head if head in prefixes else "mean"


def _aggregated(df: DataFrame, keys: Sequence[str], hows: dict[str, str], more: Sequence[Column] = ()) -> DataFrame:
    """``df`` by ``keys`` with each column of ``hows`` under its aggregate, and the aggregates ``more`` before them."""
    plain = [_AGGREGATES[h](x).alias(x) for x, h in hows.items() if h != "median"]
    medians = {x: x for x, h in hows.items() if h == "median"}
    if not plain and not more:
        plain = [F.count(F.lit(1)).alias("_sr_n")]
    g = df.groupBy(*keys).agg(*more, *plain)
    if medians:
        g = with_quantiles(g, df, medians, keys)
    return g.select(*keys, *[c for c in g.columns if c not in keys and c not in hows and c != "_sr_n"], *hows)


def aggregate_by_names(df: DataFrame, keys: Sequence[str], cols: Sequence[str], sep: str = "_") -> DataFrame:
    return _aggregated(df, keys, {x: named_aggregate(x, sep) for x in cols})


# AGG4 -------------------------------------------------------------------------
def sum_train_types(df: DataFrame, station: str = "station", time: str = "time",
                    sum_cols: Sequence[str] = ("train_count", "delay", "total_delay"),
                    aggs: dict[str, str] | None = None,
                    max_cols: Sequence[str] = ("lat", "lon", "class")) -> DataFrame:
    """Sum the listed columns over train types per (station, time); other
    features by their aggregator; lat/lon/class by max."""
    hows = {x: "sum" for x in sum_cols if x in df.columns}
    hows.update(aggs or {})
    hows.update({x: "max" for x in max_cols if x in df.columns})
    return _aggregated(df, [station, time], hows)


# AGG5 -------------------------------------------------------------------------
def hourly_rollup(df: DataFrame, cols: Sequence[str], station: str = "station", time: str = "time",
                  sep: str = "_") -> DataFrame:
    """Sub-hourly observations rolled up over the trailing hour (t-1h, t],
    labelled with the hour's end, aggregator from the name prefix ("sdev"
    = population standard deviation)."""
    end = F.timestamp_add("HOUR", F.lit(1), hour_floor(F.timestamp_add("MICROSECOND", F.lit(-1), F.col(time))))
    return _aggregated(df.withColumn(time, end), [station, time],
                       {x: named_aggregate(x, sep, (*AGG_PREFIXES, "sdev")) for x in cols})


# AGG6 -------------------------------------------------------------------------
def two_level_mean(df: DataFrame, value: str = "delay", station: str = "station", time: str = "time",
                   by: str = "dayofyear") -> DataFrame:
    """Mean per (station, time), then mean of those per (station, hour of day
    or day of year)."""
    lvl1 = df.groupBy(station, time).agg(F.avg(value).alias("_sr_m"))
    part = F.dayofyear(time) if by == "dayofyear" else F.hour(time)
    return lvl1.groupBy(station, part.cast("int").alias(by)).agg(F.avg("_sr_m").alias(f"mean_{value}"))


# AGG7 -------------------------------------------------------------------------
def mean_median_by_group(df: DataFrame, values: Sequence[str] = ("delay", "total_delay"),
                         time: str = "time", train_type: str = "train_type",
                         passenger_types: Sequence[str] = ("K", "L")) -> DataFrame:
    """Mean and median per time for all services, passenger services and each
    train type: each row is tagged with its groups and the tags exploded (at
    most three per row). Means and medians read the columns they need from one
    written table."""
    tags = F.array_compact(F.array(
        F.lit("all"), F.col(train_type),
        F.when(F.col(train_type).isin(*passenger_types), F.lit("passenger"))))
    t = stored(df.select(time, train_type, *values), "delays").select(time, *values, F.explode(tags).alias("group"))
    means = t.groupBy(time, "group").agg(*[F.avg(v).alias(f"mean_{v}") for v in values])
    out = with_quantiles(means, t, {f"median_{v}": v for v in values}, [time, "group"])
    return out.select(time, "group", *[f"{k}_{v}" for v in values for k in ("mean", "median")])


# AGG8 -------------------------------------------------------------------------
def step_means(df: DataFrame, cols: Sequence[str], time: str = "time") -> DataFrame:
    return df.groupBy(time).agg(*[F.avg(x).alias(f"mean_{x}") for x in cols])


# AGG9 -------------------------------------------------------------------------
def band_quantiles(df: DataFrame, pred: str = "y_pred", actual: str = "y", lat: str = "lat",
                   time: str = "time") -> DataFrame:
    """Per (time, latitude band 1-3): mean actual, mean prediction and the
    0.1/0.9 and 0.05/0.95 quantiles of the prediction (linear interpolation)."""
    b = df.withColumn("band", lat_band(lat)).where(F.col("band") > 0)
    g = b.groupBy(time, "band").agg(F.avg(actual).alias("avg_delay"), F.avg(pred).alias("avg_pred_delay"))
    g = with_quantiles(g, b, {"_sr": pred}, [time, "band"], (0.1, 0.9, 0.05, 0.95))
    return g.select(time, "band", "avg_delay", "avg_pred_delay", F.col("_sr_0_1").alias("pred_low"),
                    F.col("_sr_0_9").alias("pred_high"), F.col("_sr_0_05").alias("pred_low_wide"),
                    F.col("_sr_0_95").alias("pred_high_wide"))


# AGG10 / AGG11 ----------------------------------------------------------------------
def class_distribution(df: DataFrame, label: str = "class") -> DataFrame:
    """Count and percentage per class; the total is summed over the counts (one row for each class), so the input is
    read once."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("count"))
    return g.withColumn("share", F.col("count") * 100.0 / F.sum("count").over(_all_rows()))


def min_class_size(df: DataFrame, label: str = "class") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").cast("long").alias("min_count"))


# AGG12 ------------------------------------------------------------------------
def batch_sizes(df: DataFrame, time: str = "time", quantile: float = 0.3) -> DataFrame:
    """Group sizes per time step: min, max and int(quantile)."""
    g = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(g, "n", [quantile], prefix="q").toDF("q")
    return g.agg(F.min("n").cast("long").alias("min_size"), F.max("n").cast("long").alias("max_size")).select(
        "*", F.floor(q.scalar()).cast("long").alias("q_size"))


# AGG13 / AGG14 / AGG15 --------------------------------------------------------------
def fixed_histogram(df: DataFrame, value: str, lo: float = 0.0, hi: float = 10.0, bins: int = 11) -> DataFrame:
    """Density histogram on [lo, hi] with equal bins; values equal to ``hi``
    fall in the last bin, values outside are ignored. Every bin is present."""
    width = (hi - lo) / bins
    v = F.col(value)
    inside = df.where((v >= lo) & (v <= hi))
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    j = all_bins.join(counts, "bin", "left").fillna(0, ["count"])
    n = F.sum("count").over(_all_rows())  # of the bins
    return j.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    F.col("count").cast("long").alias("count"),
                    (F.col("count") / F.when(n > 0, n * F.lit(width))).alias("density"))


def feature_histograms(df: DataFrame, cols: Sequence[str], bins: int = 50,
                       subset: Column | None = None, subset_name: str = "B") -> DataFrame:
    """Density histograms of every feature with bins over the data range, for
    all rows ("A") and optionally a subset (e.g. delay > 50). Features are
    unpivoted once; ranges come from one aggregate (a row per feature)."""
    long = df.select(*[F.col(x).cast("double").alias(x) for x in cols],
                     (subset if subset is not None else F.lit(False)).alias("_sr_sub"))
    long = long.select("_sr_sub", F.explode(F.array(*[
        F.struct(F.lit(x).alias("feature"), F.col(x).alias("value")) for x in cols])).alias("_sr_kv")) \
        .select("_sr_sub", "_sr_kv.feature", "_sr_kv.value").where(F.col("value").isNotNull())
    sets = F.array_compact(F.array(F.lit("A"), F.when(F.col("_sr_sub"), F.lit(subset_name))))
    long = long.select("feature", "value", F.explode(sets).alias("set"))
    rng = long.groupBy("set", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # one row per (set, feature): bounded by the feature list
    j = long.join(F.broadcast(rng), ["set", "feature"])
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    g = j.groupBy("set", "feature", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    n = F.sum("count").over(Window.partitionBy("set", "feature"))
    w = (F.col("hi") - F.col("lo")) / bins
    return g.select("set", "feature", "bin", F.col("count").cast("long").alias("count"),
                    F.when(w > 0, F.col("count") / (n * w)).alias("density"))


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("count"))


# AGG16 ------------------------------------------------------------------------
def daily_counts(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows per day over the data's whole date range, empty days as 0. The
    day table is generated from the range (one row per day)."""
    d = df.select(F.to_date(time).alias("day"))
    counts = d.groupBy("day").agg(F.count(F.lit(1)).cast("long").alias("count"))
    days = d.agg(F.min("day").alias("a"), F.max("day").alias("b")) \
            .select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counts, "day", "left").fillna(0, ["count"])


# AGG17 / AGG18 / AGG19 --------------------------------------------------------------
def time_range(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def station_union(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("station")).union(edges.select(F.col(dst).alias("station"))).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the first in the stated order (``dropDuplicates``
    alone would keep an arbitrary row).

    With ascending column names as the order this is ``min(struct(order,
    rest))`` per key: a partially-aggregatable aggregate (a hot key is
    reduced map-side) and deterministic also on ties. Other orders fall back
    to a ``row_number`` window.
    """
    keys = list(keys)
    if all(isinstance(o, str) for o in order):
        rest = [c for c in df.columns if c not in keys and c not in order]
        g = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_sr_first"))
        return g.select(*keys, *[F.col(f"_sr_first.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_sr_rn", F.row_number().over(w)).where(F.col("_sr_rn") == 1).drop("_sr_rn")


# AGG20 ------------------------------------------------------------------------
def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst",
              stations: DataFrame | None = None) -> DataFrame:
    """Sorted neighbour list per station; optionally only picked stations
    (on both ends). The list is one row per station: bounded by the
    station's degree, not by the data volume (edges are distinct)."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    if stations is not None:
        s = stations.select(F.col(stations.columns[0]).alias("_sr_s")).distinct()
        e = e.join(s, e.src == s._sr_s, "left_semi").join(s, e.dst == s._sr_s, "left_semi")
    return e.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


# AGG21 / AGG22 / AGG23 / AGG24 / AGG26 ----------------------------------------------
def class_weights(df: DataFrame, label: str = "class") -> DataFrame:
    """Balanced weights n / (k * count_c)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return g.select(label, (F.sum("count").over(_all_rows()) / (F.count(label).over(_all_rows()) * F.col("count"))).alias("weight"))


def class_feature_stats(df: DataFrame, cols: Sequence[str], label: str = "class") -> DataFrame:
    """Mean and population variance per class x feature."""
    long = df.select(label, F.explode(F.array(*[
        F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value")) for x in cols])).alias("_kv"))
    return long.groupBy(label, "_kv.feature").agg(
        F.avg("_kv.value").alias("mean"), F.var_pop("_kv.value").alias("var"),
        F.count("_kv.value").cast("long").alias("n"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact 25/50/75 % (linear interpolation)
    and max per column, long form (column, stat, value). Moments come from
    one aggregation pass; the quartiles from the distributed exact quantile
    (a whole-table ``percentile`` would merge every distinct value in one
    task; ``summary()`` would be approximate)."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).cast("double").alias(f"{c}|count"), F.avg(c).alias(f"{c}|mean"),
                 F.stddev_samp(c).alias(f"{c}|std"), F.min(c).cast("double").alias(f"{c}|min"),
                 F.max(c).cast("double").alias(f"{c}|max")]
    wide = df.agg(*aggs)
    items = [F.struct(F.lit(n.split("|")[0]).alias("column"), F.lit(n.split("|")[1]).alias("stat"),
                      F.col(f"`{n}`").alias("value")) for n in wide.columns]
    moments = wide.select(F.explode(F.array(*items)).alias("kv")).select("kv.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("kv")).select("kv.*")
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["column"], prefix="q")
    quart = q.select("column", F.explode(F.array(
        F.struct(F.lit("25%").alias("stat"), F.col("q_0_25").alias("value")),
        F.struct(F.lit("50%").alias("stat"), F.col("q_0_5").alias("value")),
        F.struct(F.lit("75%").alias("stat"), F.col("q_0_75").alias("value")))).alias("kv")) \
        .select("column", "kv.stat", "kv.value")
    return moments.unionByName(quart)


def share_below(df: DataFrame, value: str, limits: Sequence[float] = (10, 5, 3, 1)) -> DataFrame:
    return df.agg(*[F.avg((F.col(value) < lim).cast("double")).alias(f"share_below_{int(lim)}") for lim in limits])


def climatology(df: DataFrame, value: str = "delay") -> DataFrame:
    return df.agg(F.avg(value).alias("climatology"))


# HEAT1 helpers ----------------------------------------------------------------
def station_order(df: DataFrame, station: str = "station", lat: str = "lat", time: str = "time") -> DataFrame:
    """Stations ranked by their first appearance in (lat, time) order."""
    first = df.groupBy(station).agg(F.min(F.struct(lat, time)).alias("_sr_f"))
    return first.select(station, F.row_number().over(Window.orderBy("_sr_f", station)).alias("order"))
