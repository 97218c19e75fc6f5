"""PRED3: forecast scoring as one batch plan.

forecast rows (one per place and hour) -> precipitation sums per place
(WIN3, partitioned by place, not across places) -> missing -> -99 (FN9)
-> model -> truncate to int (FN18) -> predictions grouped per station and
day (JOIN12) -> rows to insert, minus those already stored (SNK9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.functions.scalar import trunc_int
from stormrail.operators.joins import predictions_by_station
from stormrail.operators.models import predict_per_group
from stormrail.operators.windows import precip_sums_sentinel


def score_forecasts(forecasts: DataFrame, coefs: DataFrame, places: DataFrame, features: Sequence[str],
                    place: str = "place", time: str = "time", prec: str = "prec",
                    station_name: str = "station_name", fallback: DataFrame | None = None) -> DataFrame:
    """Predicted delay (int) per forecast row with the station's model."""
    f = precip_sums_sentinel(forecasts, prec, station=place, time=time, names=[f"{prec}_3h", f"{prec}_6h"])
    f = f.fillna(-99.0, subset=[prec, f"{prec}_3h", f"{prec}_6h"])
    f = f.join(places.select(place, station_name), place)
    p = predict_per_group(f, coefs, station_name, features, fallback=fallback, out="value")
    return p.withColumn("value", trunc_int("value"))


def nest_predictions(scored: DataFrame, places: DataFrame, place: str = "place",
                     station_name: str = "station_name", time: str = "time") -> DataFrame:
    return predictions_by_station(scored.drop(station_name), places, place, station_name,
                                  fields=(time, "value"), day=time)


def rows_to_insert(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK9: skip rows whose (station, time, analysis time) batch is stored."""
    return new.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def retention(stored: DataFrame, cutoff, analysistime: str = "analysistime", timestamp: str = "time") -> DataFrame:
    """SNK10: keep rows unless both the analysis time and the time are
    before the cutoff (the complement of the reference's DELETE)."""
    c = F.lit(str(cutoff)).cast("timestamp_ntz")
    return stored.where(~((F.col(analysistime) < c) & (F.col(timestamp) < c)))


def insert_predictions(scored: DataFrame, path: str, analysistime: str) -> int:
    """PRED3's last step: the scored rows of one analysis as one committed batch, named by the analysis. Running a job
    again, or after it died half-way, leaves each row stored once. Returns the rows of the batch."""
    from stormrail.sources.sinks import committed_append
    rows = scored.withColumn("analysistime", F.lit(analysistime).cast("timestamp_ntz"))
    return committed_append(rows, path, f"analysis {analysistime}")
