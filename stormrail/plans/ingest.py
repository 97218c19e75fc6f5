"""ING1: the feature-table build (delays x hourly weather x strike counts).

One plan: observation cleaning (FN6), precipitation window sums (WIN1/WIN2),
missing -> -99 (FN7, one projection), hourly strike counts (AGG1), weather
LEFT JOIN strikes (JOIN1), delays INNER JOIN weather (JOIN2). Catalyst
prunes columns into the scans; both windows share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.functions.scalar import no_rain_to_zero, to_sentinel
from stormrail.operators.aggregates import hourly_counts
from stormrail.operators.joins import delays_with_weather, weather_with_flashes
from stormrail.operators.windows import precip_sums


def clean_weather(obs: DataFrame, prec: str = "prec", station: str = "station", time: str = "time",
                  sizes: Sequence[int] = (3, 6)) -> DataFrame:
    """FN6 -> WIN1/WIN2 -> FN7 over the observation table."""
    w = obs.withColumn(prec, no_rain_to_zero(prec))
    names = [f"{prec}_{n}h" for n in sizes]
    w = precip_sums(w, prec, station, time, sizes, names)
    keys = {station, time}
    return w.select(*[F.col(x) if x in keys else to_sentinel(x).alias(x) for x in w.columns])


def build_features(delays: DataFrame, obs: DataFrame, strikes: DataFrame, prec: str = "prec",
                   station: str = "station", time: str = "time") -> DataFrame:
    """The joined feature table: one row per delay row that has weather."""
    weather = clean_weather(obs, prec, station, time)
    flashes = hourly_counts(strikes, station, time, out="flashcount")
    wf = weather_with_flashes(weather, flashes, (time, station))
    return delays_with_weather(delays, wf, (time, station))
