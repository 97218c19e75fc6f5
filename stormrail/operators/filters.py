"""Projections and filters (PRJ*, FLT*) and the feature-table scan (SRC10).

Time predicates are written as ranges on the time column so they reach the
Parquet scan as ``PushedFilters``; month/season predicates are added on top
(they cannot be pushed) and, where the caller gives a range, the range still
prunes row groups.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormrail.functions.constants import MISSING, SUMMER_MONTHS, WINTER_MONTHS
from stormrail.operators.ordered import epoch_seconds_ntz

def _ts(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, dt.datetime):
        x = x.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(x, dt.date):
        x = x.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(x)).cast("timestamp_ntz")


# FLT1 -------------------------------------------------------------------------
def time_range(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    """Rows with start <= time < end (half-open, as the generated SQL does)."""
    return df.where((F.col(time) >= _ts(start)) & (F.col(time) < _ts(end)))


# FLT2 -------------------------------------------------------------------------
def stations_in(df: DataFrame, stations, station: str = "station") -> DataFrame:
    """Rows of the given stations: a list becomes an IN predicate (which reaches the scan), a DataFrame a semi join
    that AQE plans from its size."""
    if isinstance(stations, DataFrame):
        return df.join(stations.select(F.col(stations.columns[0]).alias(station)).distinct(), station, "left_semi")
    return df.where(F.col(station).isin(list(stations)))


# FLT3 / FLT16 -----------------------------------------------------------------
def winter_only(df: DataFrame, time: str = "time") -> DataFrame:
    return df.where(F.month(time).isin(*WINTER_MONTHS))


def summer_between(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    """Summer (June-August) rows between two dates, end day included."""
    end_excl = F.date_add(_ts(end).cast("date"), 1).cast("timestamp_ntz")
    return df.where((F.col(time) >= _ts(start)) & (F.col(time) < end_excl)
                    & F.month(time).isin(*SUMMER_MONTHS))


# FLT4 -------------------------------------------------------------------------
def where_equal(df: DataFrame, **preds) -> DataFrame:
    cond = F.lit(True)
    for k, v in preds.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def month_is(df: DataFrame, month: int, time: str = "time") -> DataFrame:
    return df.where(F.month(time) == month)


# FLT5 / FLT6 / FLT7 -----------------------------------------------------------
def codes_exclude(df: DataFrame, codes: Sequence[str], code: str = "code") -> DataFrame:
    return df.where(F.col(code).isNull() | ~F.col(code).isin(*codes))


def codes_include_labelled(df: DataFrame, codes: Sequence[str], label: str = "label",
                           code: str = "code") -> DataFrame:
    return df.where((F.col(label) == 0) | F.col(code).isin(*codes))


def codes_include(df: DataFrame, codes: Sequence[str] | None, code: str = "code") -> DataFrame:
    if not codes:
        raise ValueError("a reason-code table was given without a code list")
    return df.where(F.col(code).isin(*codes))


# FLT8 / FLT9 ------------------------------------------------------------------
def train_types_in(df: DataFrame, types: Sequence[str], train_type: str = "train_type",
                   keep_sentinel: bool = True) -> DataFrame:
    allowed = list(types) + (["-99"] if keep_sentinel else [])
    return df.where(F.col(train_type).isin(*allowed))


# FLT10 - FLT13 ----------------------------------------------------------------------
def at_latlon(df: DataFrame, latlon: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    la, lo = (float(x) for x in latlon.split(","))
    return df.where((F.col(lat) == la) & (F.col(lon) == lo))


def min_train_count(df: DataFrame, n: int, col: str = "train_count") -> DataFrame:
    return df.where(F.col(col) > n)


def delayed(df: DataFrame, limit: float = 50, col: str = "delay") -> DataFrame:
    return df.where(F.col(col) > limit)


def split_by_class(df: DataFrame, class_limit: int, col: str = "class") -> tuple[DataFrame, DataFrame]:
    """(normal rows: class < limit, delayed rows: class >= limit)."""
    return df.where(F.col(col) < class_limit), df.where(F.col(col) >= class_limit)


# FLT14 ------------------------------------------------------------------------
def tag_periods(df: DataFrame, periods: Sequence[tuple[str, str]], time: str = "time",
                add_whole: bool = True) -> DataFrame:
    """Tag rows with every test period (start day, end day inclusive) they
    fall in; periods may overlap (a row then appears once per period). With
    several periods the whole span (first start .. last end) is one more
    period. The periods are a parameter list, so this is a projection + explode,
    no join."""
    ps = list(periods)
    if add_whole and len(ps) > 1:
        ps.append((ps[0][0], ps[-1][-1]))
    arr = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("period"), _ts(a).alias("s"),
                             F.date_add(_ts(b).cast("date"), 1).cast("timestamp_ntz").alias("e"))
                    for a, b in ps])
    hit = F.filter(arr, lambda p: (F.col(time) >= p["s"]) & (F.col(time) < p["e"]))
    return df.select("*", F.explode(F.transform(hit, lambda p: p["period"])).alias("period"))


# FLT15 ------------------------------------------------------------------------
def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(cols) if cols else None)


# FLT17 / FLT18 ----------------------------------------------------------------------
def assign_chunks(df: DataFrame, start, end, days: int = 1, hours: int = 0, time: str = "time",
                  out: str = "chunk") -> DataFrame:
    """Chunk id of every row for consecutive chunks of ``days``/``hours``
    starting at ``start``: chunk i covers (start + i*len, start + (i+1)*len];
    a trailing partial chunk (past the last full chunk before ``end``) is
    dropped. One job over all chunks replaces the backfill loop."""
    length = (days * 24 + hours) * 3600
    s, e = _ts(start), _ts(end)
    secs = epoch_seconds_ntz(F.col(time)) - epoch_seconds_ntz(s)
    span = epoch_seconds_ntz(e) - epoch_seconds_ntz(s)
    n_full = F.floor(span / length)
    chunk = (F.ceil(secs / F.lit(length)) - 1).cast("long")
    return df.withColumn(out, chunk).where((secs > 0) & (F.col(out) < n_full))


def chunk_table(df_spark_session, start, end, days: int = 1, hours: int = 0,
                timestep_min: int = 60) -> DataFrame:
    """The chunk list (chunk, first stamp, last stamp): first stamp is the
    chunk start shifted by one time step; trailing partial chunk dropped."""
    length = dt.timedelta(days=days, hours=hours)
    s = dt.datetime.fromisoformat(str(start))
    e = dt.datetime.fromisoformat(str(end))
    n = int((e - s) / length)
    spark = df_spark_session
    ids = spark.range(n)
    return ids.select(
        F.col("id").alias("chunk"),
        F.timestamp_add("MINUTE", F.col("id") * int(length.total_seconds() // 60) + timestep_min,
                        _ts(s)).alias("first_time"),
        F.timestamp_add("MINUTE", (F.col("id") + 1) * int(length.total_seconds() // 60), _ts(s)).alias("last_time"))


# PRJ* -------------------------------------------------------------------------
def add_month(df: DataFrame, time: str = "time", out: str = "month") -> DataFrame:
    return df.withColumn(out, F.month(time).cast("int"))


def add_tag(df: DataFrame, value, out: str = "source") -> DataFrame:
    return df.withColumn(out, F.lit(value))


def fill_missing(df: DataFrame, cols: Iterable[str] | None = None, value: float = MISSING) -> DataFrame:
    return df.fillna(value, subset=list(cols) if cols else None)


# SRC10 ------------------------------------------------------------------------
def scan_features(df: DataFrame, start=None, end=None, cols: Sequence[str] | None = None,
                  stations=None, winter: bool = False, where: dict | None = None,
                  month: int | None = None, codes: DataFrame | None = None,
                  code_keys: Sequence[str] = ("train_type", "station", "time"),
                  codes_excluded: Sequence[str] | None = None,
                  codes_included: Sequence[str] | None = None, label: str | None = None,
                  distinct_fact: bool = False,
                  order: Sequence[str] | None = None, limit: int | None = None,
                  offset: int = 0, time: str = "time", station: str = "station") -> DataFrame:
    """The feature-table read with every option of the generated SQL:
    projection, [start, end), station list, winter months, equality
    predicates, reason-code join and filters, order, page. The code join
    fans out (one row per matching code) unless ``distinct_fact``."""
    out = df
    if start is not None and end is not None:
        out = time_range(out, start, end, time)
    if stations is not None:
        out = stations_in(out, stations, station)
    if winter:
        out = winter_only(out, time)
    if month is not None:
        out = month_is(out, month, time)
    if where:
        out = where_equal(out, **where)
    if codes is not None:
        out = out.join(codes, list(code_keys), "left")
        if codes_excluded:
            out = codes_exclude(out, codes_excluded)
        elif codes_included and label:
            out = codes_include_labelled(out, codes_included, label)
        else:
            out = codes_include(out, codes_included)
    if cols:
        extra = ["code"] if codes is not None and "code" not in cols and not distinct_fact else []
        out = out.select(*cols, *extra)
    if codes is not None and distinct_fact:
        # a fact row kept through several codes appears once (T5 option)
        fact_cols = [c for c in (cols or df.columns) if c in df.columns]
        out = out.select(*fact_cols).distinct()
    if order:
        out = out.orderBy(*order)
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
    elif limit is not None or offset:
        raise ValueError("paging needs an order")
    return out
