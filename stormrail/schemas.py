"""Schemas declared once (no inference at scale)."""

from pyspark.sql import types as T

# Headerless delay file: positional fields.
DELAY_CSV = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("start_hour", T.IntegerType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("train_type", T.StringType()),
    T.StructField("sum_delay", T.DoubleType()),
    T.StructField("sum_ahead", T.DoubleType()),
    T.StructField("add_delay", T.DoubleType()),
    T.StructField("add_ahead", T.DoubleType()),
    T.StructField("train_count", T.LongType()),
])

STATION_JSON = T.StructType([
    T.StructField("stationShortCode", T.StringType()),
    T.StructField("stationName", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

STRIKE_TEXT = T.StructType([T.StructField(n, T.StringType()) for n in ("time", "peakcurrent", "trainstation")])

REASON_CODES = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("hour", T.IntegerType()),
    T.StructField("train_type", T.StringType()), T.StructField("start_station", T.StringType()),
    T.StructField("end_station", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("count", T.LongType()),
])

FORECAST_SINK = T.StructType([
    T.StructField("station_id", T.IntegerType()), T.StructField("time", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()), T.StructField("analysistime", T.TimestampNTZType()),
])


def all_strings(names):
    """Observation/forecast text: every field read as a string first."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
