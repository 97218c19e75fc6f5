"""HEAT1: station x day-of-year (or hour) heat map of mean delays, scaled to
0..255 with the min/max of the per-(station, time) means, stations ordered
by their first appearance in (latitude, time) order.

The long form (station, day, mean, scaled, order) is the stored form; the
wide matrix has one array for each day with a cell for every station of the
station table, in the order of their latitudes. So the matrix has as many
columns as there are stations without a schema that depends on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.functions.scalar import scale_0_255
from stormrail.operators.aggregates import station_order


def heatmap_long(df: DataFrame, value: str = "delay", station: str = "station", time: str = "time",
                 lat: str = "lat", by: str = "dayofyear", train_types: Sequence[str] | None = None,
                 train_type: str = "train_type") -> DataFrame:
    """Long heat map. ``train_types`` filters by letter (e.g. K, L for
    passenger services)."""
    d = df if train_types is None else df.where(F.col(train_type).isin(*train_types))
    lvl1 = d.groupBy(station, time).agg(F.avg(value).alias("_m"), F.min(lat).alias(lat))
    lo, hi = lvl1.agg(F.min("_m")).scalar(), lvl1.agg(F.max("_m")).scalar()
    part = F.dayofyear(time) if by == "dayofyear" else F.hour(time)
    lvl2 = lvl1.groupBy(station, part.cast("int").alias(by)).agg(F.avg("_m").alias("mean"))
    order = station_order(lvl1, station, lat, time)
    return lvl2.withColumn("scaled", scale_0_255("mean", lo, hi)).join(order, station)


def heatmap_wide(long: DataFrame, stations: DataFrame, station: str = "station", lat: str = "lat",
                 by: str = "dayofyear", value: str = "scaled") -> tuple[DataFrame, DataFrame]:
    """(columns, matrix): the stations with their column (from 0, by latitude and name), and for each day (or hour) the
    array of their values, NULL where a station has none. A row holds one number for each station; stations that are
    not in the table of stations have no column."""
    from stormrail.operators.ordered import global_row_number
    columns = global_row_number(stations.select(station, lat).distinct(), [lat, station], "_n") \
        .select(station, lat, (F.col("_n") - 1).alias("column"))
    cells = long.join(columns.select(station, "column"), station).groupBy(by).agg(
        F.collect_list(F.struct("column", F.col(value).alias("value"))).alias("_cells"))
    width = columns.agg(F.count(F.lit(1))).scalar()
    # columns without a cell are found as a set and all are sorted once: looking each column up in a map would take
    # the square of the number of stations for each day
    every = F.sequence(F.lit(0).cast("long"), F.col("_width") - 1)
    none = F.lit(None).cast(long.schema[value].dataType)
    blank = F.transform(F.array_except(every, F.transform("_cells", lambda c: c["column"])),
                        lambda c: F.struct(c.alias("column"), none.alias("value")))
    row = F.transform(F.array_sort(F.concat("_cells", blank)), lambda c: c["value"])
    return columns, cells.withColumn("_width", width).select(by, row.alias("values"))
