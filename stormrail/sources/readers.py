"""Readers (SRC1-SRC16). Schemas are declared, never inferred; text values
are parsed with ``try_cast`` so bad values become NULL instead of errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormrail import schemas
from stormrail.functions.scalar import event_hour, local_to_utc, parse_ntz, strip_chars, text_to_double
from stormrail.operators.ordered import global_row_number


# SRC1 / SRC2 ------------------------------------------------------------------
def read_stations(spark: SparkSession, path: str, key: str = "short") -> DataFrame:
    """Station dimension from JSON, keyed by short code or by long name."""
    s = spark.read.schema(schemas.STATION_JSON).json(path)
    out = s.select(F.col("stationShortCode").alias("station"), F.col("stationName").alias("station_name"),
                   F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return out if key == "short" else out.select("station_name", "station", "lat", "lon")


# SRC3 / SRC13 / PRJ2 / PRJ3 ----------------------------------------------------------
def read_delays_csv(spark: SparkSession, path: str, skip_header: bool = False, zone: str | None = None) -> DataFrame:
    """Headerless delay file -> (time, station, train_type, train_count,
    total_delay, delay). Time = date + start hour + 1 hour (the label is at
    the end of the hour), converted from ``zone`` to UTC when given. Station
    is the destination (field 4); delay is field 6 and total_delay field 8,
    as in the ingest job."""
    d = spark.read.schema(schemas.DELAY_CSV).option("header", skip_header).csv(path)
    t = event_hour("date", "start_hour", 1)
    if zone:
        t = local_to_utc(t, zone)
    return d.select(t.alias("time"), F.col("dst").alias("station"), "train_type", "train_count",
                    F.col("add_delay").alias("total_delay"), F.col("sum_delay").alias("delay"))


# SRC4 -------------------------------------------------------------------------
def read_delimited(spark: SparkSession, path: str, names: Sequence[str], sep: str = ";", skip_rows: int = 1,
                   skip_cols: int = 0, remove: str = '"', cast: str = "double") -> DataFrame:
    """Delimited text without the first ``skip_rows`` lines of each file and the first ``skip_cols`` columns,
    ``remove`` characters stripped, values cast. One header line is the reader's own; for more, lines are numbered by
    their place in the file (rows of one split come in order, and a header lies in a file's first split)."""
    schema = schemas.all_strings([f"_c{i}" for i in range(skip_cols + len(names))])
    if skip_rows <= 1:
        raw = spark.read.option("sep", sep).option("header", skip_rows == 1).schema(schema).csv(path)
    else:
        lines = spark.read.text(path).select(
            "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("at"))
        heads = lines.where(F.col("b") == 0).groupBy("f").agg(F.min("at").alias("first"))
        body = lines.join(heads, "f").where((F.col("b") != 0) | (F.col("at") >= F.col("first") + skip_rows))
        ddl = ", ".join(f"{c.name} string" for c in schema)
        raw = body.where(F.trim("value") != "").select(F.from_csv("value", ddl, {"sep": sep}).alias("r")).select("r.*")
    cols = raw.columns[skip_cols:]
    return raw.select(*[strip_chars(c, remove).try_cast(cast).alias(n) for c, n in zip(cols, names)])


# SRC5 / SRC6 / SRC7 / SRC8 ------------------------------------------------------------
def read_observation_text(spark: SparkSession, path: str, names: Sequence[str], sep: str = ",",
                          keys: Sequence[str] = ("time", "place", "trainstation"),
                          time_format: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    """Observation text: all fields as strings, then measures to double
    (missing spellings -> NULL) and the time parsed."""
    raw = spark.read.schema(schemas.all_strings(names)).option("sep", sep).csv(path)
    return raw.select(*[parse_ntz(n, time_format).alias(n)
                        if n == "time" else (F.col(n) if n in keys else text_to_double(n).alias(n))
                        for n in names])


def read_strike_text(spark: SparkSession, path: str, time_format: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    raw = spark.read.schema(schemas.STRIKE_TEXT).csv(path)
    return raw.select(parse_ntz("time", time_format).alias("time"),
                      text_to_double("peakcurrent").alias("peakcurrent"), "trainstation")


def read_forecast_text(spark: SparkSession, path: str, names: Sequence[str], sep: str = ";") -> DataFrame:
    """Forecast text with a header made of the parameter names; epoch times."""
    raw = spark.read.schema(schemas.all_strings(names)).option("sep", sep).csv(path)
    from stormrail.functions.scalar import epoch_to_ts
    out = []
    for n in names:
        if n in ("time", "origintime"):
            out.append(epoch_to_ts(F.col(n).try_cast("long")).alias(n))
        elif n == "place":
            out.append(F.col(n))
        else:
            out.append(text_to_double(n).alias(n))
    return raw.select(*out)


def read_renamed_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return spark.read.schema(schemas.all_strings(names)).csv(path).toDF(*names)


# SRC9 -------------------------------------------------------------------------
def read_parameters(spark: SparkSession, path: str, drop: int = 0) -> tuple[list[str], list[str]]:
    """Parameter spec ``param;name`` lines -> (params, names), the first
    ``drop`` entries removed. A few dozen lines: read on the driver."""
    rows = spark.read.text(path).select(F.split("value", ";").alias("p")).where(F.size("p") >= 2).collect()
    params = [r.p[0] for r in rows][drop:]
    names = [r.p[1] for r in rows][drop:]
    return params, names


# SRC11 / SRC16 -----------------------------------------------------------------------
def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def dataset_window(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    from stormrail.operators.filters import time_range
    return time_range(df, start, end, time)


# SRC12 ------------------------------------------------------------------------
def list_files(spark: SparkSession, path: str, suffix: str = "csv") -> DataFrame:
    """Files under ``path`` ending in ``.suffix`` (contents are not read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}") \
        .option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


# SRC14 / SRC15 -----------------------------------------------------------------------
def read_adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``SRC:DST,DST,...`` -> edges (src, dst)."""
    t = spark.read.text(path).select(F.split("value", ":").alias("p")).where(F.size("p") == 2)
    return t.select(F.trim(F.col("p")[0]).alias("src"), F.explode(F.split(F.col("p")[1], ",")).alias("dst")) \
            .select("src", F.trim("dst").alias("dst")).where(F.col("dst") != "")


def _columns(batches):
    """(i, j) of each place of a line, from rows (_line, _gaps, _pos, _x) in order: _x is the place itself or, with _gaps,
    the number of zeros in front of it."""
    import numpy as np
    import pyarrow as pa
    upto, base = 0, 0  # what the rows so far sum up to, and what those of earlier lines do
    for batch in batches:
        line, gaps, pos, x = (np.asarray(batch.column(c)) for c in range(4))
        sums = np.cumsum(x.astype(np.int64) + 1) + upto
        bases = np.maximum.accumulate(np.where(pos == 0, sums - x - 1, base))
        yield pa.RecordBatch.from_arrays([pa.array(line - 1), pa.array(np.where(gaps, sums - bases - 1, x).astype(np.int64))],
                                         names=["i", "j"])
        if len(x):
            upto, base = sums[-1], bases[-1]


def read_adjacency_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A square 0/1 matrix, one row per line, in one file or in several that
    follow each other by name -> edges (i, j) with value > 0. Line numbers come
    from the place of a line (file, split, line in the split), ranked with a
    distributed row number.

    A line of single 0 and 1 is cut at its ones, and what lies between them says
    how many zeros there are: it is such a line if the same text can be made from
    these numbers. Any other line is cut into its cells."""
    from stormrail.session import stored
    from stormrail.sources.sinks import matrix_line
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col(
        "_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    found = F.array_compact(F.transform(F.split("value", sep), lambda v, j: F.when(F.trim(v).try_cast("double") > 0, j)))
    if sep in (",", ";", " ", "\t"):
        between = F.transform(F.split("value", "1"), lambda x: F.octet_length(x))
        t = t.withColumn("_between", between)
        zeros = F.when(F.size("_between") > 1, F.transform("_between", lambda x: (x / 2).cast("int"))).otherwise(
            F.transform("_between", lambda x: ((x + 1) / 2).cast("int")))
        t = t.withColumn("_zeros", zeros)
        t = t.withColumn("_gaps", matrix_line(F.col("_zeros"), sep) == F.col("value"))
        t = t.withColumn("_xs", F.when(F.col("_gaps"), F.slice("_zeros", 1, F.size("_zeros") - 1)).otherwise(found))
    else:
        t = t.withColumn("_gaps", F.lit(False)).withColumn("_xs", found)
    # the text is read once: lines are ranked with the places of their edges, not with their cells
    t = stored(t.select("_file", "_block", "_id", "_gaps", "_xs"), "matrix-lines")
    t = global_row_number(t, ["_file", "_block", "_id"], "_line")
    places = t.select("_line", "_gaps", F.posexplode("_xs").alias("_pos", "_x"))
    return places.mapInArrow(_columns, "i long, j long")
