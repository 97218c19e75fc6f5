"""IMPU1 / IMPU2: geographic imputation of missing features.

A missing value is taken from the nearest station at the same time step that
has the value, searching only the two stations before and after in
(latitude, longitude) order and only within 150 km (equirectangular). Values
always come from the unimputed table, so an imputed cell never feeds
another. Rows that still miss a feature are dropped.

Plan: one window per time step ordered by (lat, lon, station) with a
frame of +-2 rows collects ``struct(lat, lon, station, f1..fk)`` once for
all features; every feature is then resolved with array functions (filter,
transform, ``array_min`` over (distance, lat, lon, station) structs, so ties
go to the lower latitude, longitude, station). The window runs per
(time, latitude band) with the band edges fixed up exactly
(``bucketed_window``), so a time step with very many stations is not one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.functions.constants import IMPUTE_MAX_KM, IMPUTE_MAX_POSITIONS
from stormrail.functions.scalar import equirect_km
from stormrail.operators.ordered import bucketed_window


def impute_nearest(df: DataFrame, features: Sequence[str], station: str = "station", time: str = "time",
                   lat: str = "lat", lon: str = "lon", span: int = IMPUTE_MAX_POSITIONS,
                   max_km: float = IMPUTE_MAX_KM, drop_incomplete: bool = True,
                   band_deg: float = 1.0) -> DataFrame:
    """Impute ``features`` from the nearest neighbour (see module doc).
    Expects one row per (station, time): aggregate duplicates first."""
    feats = list(features)

    def compute(w):
        fr = w.rowsBetween(-span, span)
        item = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(station).alias("st"),
                        *[F.col(f).alias(f) for f in feats])
        return {"_sr_nb": F.collect_list(item).over(fr)}

    band = F.floor(F.col(lat) / F.lit(band_deg)).cast("long")
    with_nb = bucketed_window(df, [time], [lat, lon, station], compute, k_before=span, k_after=span,
                              bucket_expr=band)
    out = with_nb
    for f in feats:
        out = out.withColumn(f, F.coalesce(F.col(f), _nearest_value(f, station, lat, lon, max_km)))
    out = out.drop("_sr_nb")
    if drop_incomplete:
        out = out.dropna(subset=feats)
    return out


def _nearest_value(f: str, station: str, lat: str, lon: str, max_km: float):
    """Value of ``f`` at the nearest neighbour in ``_sr_nb`` within max_km."""
    def usable(x):
        return x[f].isNotNull() & (x["st"] != F.col(station))

    def score(x):
        return F.struct(equirect_km(F.col(lat), F.col(lon), x["lat"], x["lon"]).alias("d"),
                        x["lat"].alias("lat"), x["lon"].alias("lon"), x["st"].alias("st"), x[f].alias("v"))

    scored = F.transform(F.filter("_sr_nb", usable), score)
    return F.array_min(F.filter(scored, lambda x: x["d"] <= F.lit(max_km)))["v"]
