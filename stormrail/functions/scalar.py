"""FN* / PRJ* scalar expressions.

Each helper accepts column names or ``Column`` objects and returns a
``Column``. NULL is the engine's missing value; the -99 sentinel only appears
at the edges (``to_sentinel`` / ``from_sentinel``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormrail.functions.constants import (
    DELAY_CLASS_LIMITS, EARTH_RADIUS_KM, LAT_BANDS, MISSING, MISSING_TEXTS,
    NO_RAIN, PROBA_THRESHOLDS, TRAIN_TYPE_CODES,
)

DEG2RAD = 0.017453292519943295

__all__ = [
    "c", "hour_floor", "class_by_limits", "threshold_class", "binary_class",
    "three_way", "avg_delay", "no_rain_to_zero", "negative_to_zero",
    "text_to_double", "to_sentinel", "from_sentinel", "equirect_km",
    "haversine_km", "lat_band", "scale_0_255", "date_hour_key", "latlon_key",
    "iso_hour", "strip_chars", "dash_to_underscore", "split_list",
    "epoch_to_ts", "trunc_int", "proba_to_class", "pad_array", "parse_time",
    "null_count", "soft_threshold", "tanimoto", "argmax", "train_type_code",
    "shift", "month_of", "dayofyear_of", "hour_of", "date_of", "event_hour", "local_to_utc", "parse_ntz",
]


def c(x) -> Column:
    """Column from a name or a Column."""
    return F.col(x) if isinstance(x, str) else x


def hour_floor(ts) -> Column:
    """Truncate a TIMESTAMP_NTZ to the hour without any session time-zone
    round trip (``date_trunc`` returns a zoned TIMESTAMP)."""
    t = c(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
                                F.lit(0), F.lit(0))


# FN1 -------------------------------------------------------------------------
def class_by_limits(x, limits: Sequence[float] = DELAY_CLASS_LIMITS) -> Column:
    """Index of the first limit >= x; len(limits) when none (also for NULL)."""
    v = c(x)
    out = None
    for i, lim in enumerate(limits):
        cond = v <= F.lit(float(lim))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out.otherwise(F.lit(len(limits))).cast("int")


# FN2 -------------------------------------------------------------------------
def threshold_class(x, thresholds: Sequence[float] = PROBA_THRESHOLDS) -> Column:
    """Index of the first threshold t with x <= t, else the last index."""
    v = c(x)
    out = None
    for i, t in enumerate(thresholds):
        cond = v <= F.lit(float(t))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out.otherwise(F.lit(len(thresholds) - 1)).cast("int")


# FN3 -------------------------------------------------------------------------
def binary_class(x, limit: float, negative: int = 0) -> Column:
    """1 when x > limit, else ``negative`` (missing counts as not above)."""
    return F.when(F.coalesce(c(x) > F.lit(float(limit)), F.lit(False)), F.lit(1)) \
        .otherwise(F.lit(negative)).cast("int")


# FN4 -------------------------------------------------------------------------
def three_way(x, limit: float) -> Column:
    """1 above the limit, 0 below, NULL when equal or missing."""
    v = c(x)
    return F.when(v > F.lit(float(limit)), F.lit(1)).when(v < F.lit(float(limit)), F.lit(0)).cast("int")


# FN5 -------------------------------------------------------------------------
def avg_delay(delay, train_count) -> Column:
    """delay / train_count; 0 when the count is below 1 or missing."""
    n = c(train_count)
    return F.when(F.coalesce(n >= 1, F.lit(False)), c(delay) / n.cast("double")).otherwise(F.lit(0.0))


# FN6 -------------------------------------------------------------------------
def no_rain_to_zero(x) -> Column:
    """The -1 "no precipitation" marker becomes 0 (ingest form, equality)."""
    v = c(x)
    return F.when(v == F.lit(NO_RAIN), F.lit(0.0)).otherwise(v)


def negative_to_zero(x) -> Column:
    """Any negative precipitation becomes 0 (scoring form)."""
    v = c(x)
    return F.when(v < 0, F.lit(0.0)).otherwise(v)


# FN7 / FN8 / FN9 -------------------------------------------------------------
def text_to_double(x) -> Column:
    """Observation text to double; the missing spellings, empty text and
    unparsable text become NULL, NaN becomes NULL."""
    s = F.trim(c(x).cast("string"))
    d = F.when(s.isin(*MISSING_TEXTS) | (s == ""), F.lit(None)).otherwise(s.try_cast("double"))
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def to_sentinel(x) -> Column:
    """NULL (or NaN) -> -99 at the output edge."""
    v = c(x).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(MISSING)).otherwise(v)


def from_sentinel(x) -> Column:
    """-99 -> NULL when reading sentinel-coded data."""
    v = c(x).cast("double")
    return F.when(v == F.lit(MISSING), F.lit(None).cast("double")).otherwise(v)


# FN10 ------------------------------------------------------------------------
def equirect_km(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular approximation of the distance in km."""
    la1, lo1, la2, lo2 = (c(v) * F.lit(DEG2RAD) for v in (lat1, lon1, lat2, lon2))
    x = (lo2 - lo1) * F.cos((la1 + la2) / 2)
    y = la2 - la1
    return F.lit(EARTH_RADIUS_KM) * F.sqrt(x * x + y * y)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    la1, lo1, la2, lo2 = (F.radians(c(v)) for v in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


# FN11 ------------------------------------------------------------------------
def lat_band(lat) -> Column:
    """Latitude band 3/2/1 above the fixed limits, 0 otherwise."""
    v = c(lat)
    (b3, l3), (b2, l2), (b1, l1) = LAT_BANDS
    return F.when(v > l3, b3).when(v > l2, b2).when(v > l1, b1).otherwise(0).cast("int")


# FN12 ------------------------------------------------------------------------
def scale_0_255(x, lo, hi) -> Column:
    """Min-max scale to 0..255 with given bounds (NULL when the range is 0)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    rng = hi_c - lo_c
    return F.when(rng != 0, F.lit(255.0) * (c(x) - lo_c) / rng)


# FN13 ------------------------------------------------------------------------
def date_hour_key(date_col, hour_col) -> Column:
    """'yyyy-MM-dd' + 'T' + hour text (the raw delay-file key)."""
    return F.concat_ws("T", c(date_col).cast("string"), c(hour_col).cast("string"))


def latlon_key(lat, lon) -> Column:
    return F.concat_ws(",", c(lat).cast("string"), c(lon).cast("string"))


def iso_hour(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def event_hour(date_col, hour_col, add_hours: int = 1) -> Column:
    """PRJ3: parse date + start hour into a NTZ timestamp, plus ``add_hours``
    (the delay of an hour is labelled at the end of that hour)."""
    d = F.try_to_date(c(date_col).cast("string"), "yyyy-MM-dd")
    ts = F.try_make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), c(hour_col).cast("int"),
                                  F.lit(0), F.lit(0))
    return F.timestamp_add("HOUR", F.lit(add_hours), ts)


def parse_ntz(x, fmt: str) -> Column:
    """Parse text to TIMESTAMP_NTZ on the wall clock (no session zone);
    text that does not parse becomes NULL (also under ANSI mode)."""
    v = c(x).cast("string")
    return F.when(F.try_to_timestamp(v, F.lit(fmt)).isNotNull(), F.to_timestamp_ntz(v, F.lit(fmt)))


# FN14 / FN15 -----------------------------------------------------------------
def strip_chars(x, chars: str = '"') -> Column:
    import re
    return F.regexp_replace(c(x), "[" + re.escape(chars) + "]", "")


def dash_to_underscore(x) -> Column:
    return F.regexp_replace(c(x), "-", "_")


def split_list(x, sep: str = ",") -> Column:
    import re
    return F.split(c(x), re.escape(sep))


# FN16 ------------------------------------------------------------------------
def month_of(ts) -> Column:
    return F.month(c(ts)).cast("int")


def dayofyear_of(ts) -> Column:
    return F.dayofyear(c(ts)).cast("int")


def hour_of(ts) -> Column:
    return F.hour(c(ts)).cast("int")


def date_of(ts) -> Column:
    return F.to_date(c(ts))


# FN17 / FN18 / FN19 ----------------------------------------------------------
def epoch_to_ts(x) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ (UTC wall clock), no zone round trip."""
    return F.timestamp_add("SECOND", c(x).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def trunc_int(x) -> Column:
    """Truncate toward zero."""
    return c(x).cast("int")


def proba_to_class(p, limit: float = 0.5, as_bool: bool = False) -> Column:
    out = F.coalesce(c(p) >= F.lit(float(limit)), F.lit(False))
    return out if as_bool else out.cast("int")


# FN20 ------------------------------------------------------------------------
def pad_array(arr, n: int, value: float = MISSING) -> Column:
    """Pad an array on the right to length ``n`` with ``value``."""
    a = c(arr)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


# FN21 ------------------------------------------------------------------------
def parse_time(x, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse a date/time option; NULL on error."""
    return parse_ntz(x, fmt)


# FN22 ------------------------------------------------------------------------
def null_count(cols: Sequence) -> Column:
    """Number of NULL values among ``cols`` in the row."""
    parts = [F.when(c(x).isNull(), 1).otherwise(0) for x in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out.cast("int")


# FN24 / FN25 / FN26 ----------------------------------------------------------
def soft_threshold(a, t) -> Column:
    t_c = t if isinstance(t, Column) else F.lit(float(t))
    return F.signum(c(a)) * F.greatest(F.abs(c(a)) - t_c, F.lit(0.0))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def tanimoto(x, y) -> Column:
    """x.y / (x.x + y.y - x.y) over two numeric arrays of equal length; NULL for two zero vectors."""
    xv, yv = c(x), c(y)
    xy = _dot(xv, yv)
    return F.try_divide(xy, _dot(xv, xv) + _dot(yv, yv) - xy)


def argmax(arr) -> Column:
    """Index (0-based) of the largest value; first wins ties."""
    a = c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# PRJ6 / PRJ8 -----------------------------------------------------------------
def train_type_code(x) -> Column:
    m = F.create_map(*[F.lit(v) for kv in TRAIN_TYPE_CODES.items() for v in kv])
    return m[c(x)].cast("int")


def shift(x, k: float = -1) -> Column:
    return c(x) + F.lit(k)


# PRJ4 -------------------------------------------------------------------------
def local_to_utc(ts, zone: str = "Europe/Helsinki") -> Column:
    """Wall-clock time in ``zone`` -> UTC wall clock (TIMESTAMP_NTZ). The
    zone is a parameter (the raw files were requested in local time). A
    wall-clock time that occurs twice (the autumn DST hour) resolves to the
    earlier instant."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c(ts).cast("timestamp_ntz"))
