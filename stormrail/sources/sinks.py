"""Writers (SNK1-SNK17). Every write is a distributed DataFrame write;
nothing is collected to the driver."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormrail.functions.constants import SERVING_ROWS_PER_FILE
from stormrail.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stormrail-io/{name}-{uuid.uuid4().hex}"


# SNK1 / SNK2 / SNK3 / SNK5 ----------------------------------------------------------
def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


# SNK4 -------------------------------------------------------------------------
def glue_blocks(blocks: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Column blocks side by side, joined on a key (never by position);
    '-' in names becomes '_'."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, list(key))
    return out.toDF(*[c.replace("-", "_") for c in out.columns])


# SNK6 -------------------------------------------------------------------------
def write_station_csv(df: DataFrame, path: str, station: str = "station", mode: str = "overwrite") -> None:
    """';'-separated CSV with a quoted header, one folder per station.

    Rows are dealt out by ranges of station, and of a hash of the row inside one, before they are written: a station's
    rows lie in one file, those of a large one in a few, and the number of files is that of stations and tasks. Written
    as they come, each task would open a file for nearly every station."""
    rows = df.repartitionByRange(station, F.xxhash64(*df.columns))
    rows.write.mode(mode).partitionBy(station).option("sep", ";").option("header", True) \
        .option("quoteAll", True).csv(path)


# SNK7 -------------------------------------------------------------------------
def write_metrics_row(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A one-row metrics frame as one CSV (with header) or JSON file."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))


# SNK8 -------------------------------------------------------------------------
def serving_lines(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One JSON document per row: {"X": [values...]}."""
    return df.select(F.to_json(F.struct(F.array(*[F.col(c).cast("double") for c in cols]).alias("X"))).alias("value"))


def serving_documents(df: DataFrame, cols: Sequence[str], order: Sequence[str],
                      rows_per_doc: int = SERVING_ROWS_PER_FILE) -> DataFrame:
    """Single-document form {"instances": [{"X": [...]}, ...]}, one valid
    JSON document per chunk of ``rows_per_doc`` rows in ``order`` (a
    whole-table document would pass every row through one task)."""
    from stormrail.operators.ordered import global_row_number
    r = global_row_number(df, order, "_sr_rn").withColumn("doc", F.floor((F.col("_sr_rn") - 1) / rows_per_doc))
    inst = F.struct(F.col("_sr_rn"), F.struct(F.array(*[F.col(c).cast("double") for c in cols]).alias("X")).alias("i"))
    g = r.groupBy("doc").agg(F.array_sort(F.collect_list(inst)).alias("_l"))
    return g.select(F.col("doc").cast("long").alias("doc"),
                    F.to_json(F.struct(F.transform("_l", lambda x: x["i"]).alias("instances"))).alias("value"))


def write_serving_files(df: DataFrame, cols: Sequence[str], path: str,
                        rows_per_file: int = SERVING_ROWS_PER_FILE) -> None:
    serving_lines(df, cols).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


# SNK11 / SNK12 / SNK13 / SNK14 / SNK15 / SNK16 -------------------------------------------
def append_stations(df: DataFrame, path: str) -> None:
    df.select("station", "station_name", F.struct("lat", "lon").alias("location")).write.mode("append").parquet(path)


def append_counted(df: DataFrame, path: str) -> int:
    """Append all rows (no off-by-one) as one batch folder ``batch=<id>``
    and return how many were written, counted from that folder's Parquet
    metadata (no second pass over the input). ``observe`` is not used: in
    Spark 4.1 it leaves a non-serialisable manager on the session that
    breaks later ML fits."""
    sub = f"{path.rstrip('/')}/batch={uuid.uuid4().hex}"
    df.write.mode("append").parquet(sub)
    return int(df.sparkSession.read.parquet(sub).count())


def committed_append(df: DataFrame, path: str, batch: str) -> int:
    """Append ``df`` as the batch named ``batch``; how many rows it has.

    The rows go into a staged folder first. A row in the manifest then names the folder; that row is one small file,
    which appears as a whole or not at all. Readers (:func:`read_committed`) see folders that the manifest names, so a
    job that dies before leaves nothing behind that anybody reads. Of a batch that is appended again the first folder
    counts and the later one is ignored: repeating a batch changes nothing. A batch without rows is a batch.
    """
    spark, base, staged = df.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    df.write.parquet(f"{base}/rows/staged={staged}")
    n = spark.read.schema(df.schema).parquet(f"{base}/rows/staged={staged}").count()
    _commit(spark, base, batch, staged, n)
    return n


_MANIFEST = "batch string, staged string, n_rows long, at timestamp"


def _commit(spark: SparkSession, base: str, batch: str, staged: str, n: int) -> None:
    row = spark.createDataFrame([(batch, staged, n)], "batch string, staged string, n_rows long")
    row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{base}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, staged, n_rows): the folder that counts of each committed batch."""
    m = spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    first = F.min(F.struct("at", "staged", "n_rows")).alias("f")
    return m.groupBy("batch").agg(first).select("batch", "f.staged", "f.n_rows")


def read_committed(spark: SparkSession, path: str, batch_col: str | None = None) -> DataFrame:
    """The rows of all committed batches, each batch once. Folders are a partition column, so the join with the
    manifest (a row for each batch) prunes those that it does not name. ``batch_col``: keep the batch's name."""
    rows = spark.read.option("basePath", f"{path.rstrip('/')}/rows").parquet(f"{path.rstrip('/')}/rows")
    named = manifest(spark, path).select(F.col("staged").alias("_staged"), F.col("batch").alias("_batch"))
    joined = rows.join(named, rows.staged.cast("string") == F.col("_staged"))
    keep = [c for c in rows.columns if c != "staged"]
    return joined.select(*keep, *([F.col("_batch").alias(batch_col)] if batch_col else []))


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_splits(train: DataFrame, test: DataFrame, path: str, location: str) -> None:
    for name, part in (("train", train), ("test", test)):
        part.withColumn("location", F.lit(location)).withColumn("split", F.lit(name)) \
            .write.mode("append").partitionBy("split").parquet(path)


def extract_period(df: DataFrame, start, end, path: str, time: str = "time") -> None:
    """SNK15 / SNK16: one filtered append instead of a day-by-day loop."""
    from stormrail.operators.filters import time_range
    time_range(df, start, end, time).write.mode("append").parquet(path)


# SNK17 ------------------------------------------------------------------------
def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    """A saved ``PipelineModel``; None when nothing is stored there. Any other failure is raised."""
    from pyspark.errors import AnalysisException
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession
    try:
        SparkSession.getActiveSession().read.format("binaryFile").load(f"{path}/metadata").limit(1)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return PipelineModel.load(path)


# SRC15's counterpart --------------------------------------------------------------------
def matrix_line(gaps: Column, sep: str) -> Column:
    """A line of a 0/1 matrix from the numbers of zeros before its first one, between its ones and after the last (for a
    line of zeros: their number alone). Zeros are repeated as a whole, so a line costs little more than its bytes."""
    zeros = lambda text, k: F.repeat(F.lit(text), k.cast("int"))
    ones = F.transform(F.slice(gaps, 2, F.size(gaps) - 1), lambda k: F.concat(F.lit("1"), zeros(sep + "0", k)))
    return F.when(F.size(gaps) > 1, F.concat(zeros("0" + sep, F.get(gaps, F.lit(0))), F.array_join(ones, sep))).otherwise(
        F.concat(F.lit("0"), zeros(sep + "0", F.get(gaps, F.lit(0)) - 1)))


def write_adjacency_matrix(edges: DataFrame, n: int, path: str, sep: str = ",", block: int = 256) -> None:
    """Edges (i, j), numbered from 0, as an ``n`` x ``n`` 0/1 matrix: one line for each i, ``block`` lines for each task
    and file, the files following each other by name. A line is made from the row's own edges only. The text has n x n
    cells, nearly all of them 0, so the files are compressed: they grow with the edges more than with the cells. LZ4
    (Hadoop's framing) packs and unpacks runs of zeros several times faster than gzip."""
    spark = edges.sparkSession
    rows = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).groupBy("i").agg(
        F.array_sort(F.collect_set("j")).alias("js"))  # at most n of them
    full = spark.range(n).select(F.col("id").alias("i")).join(rows, "i", "left").repartitionByRange(
        max(1, -(-n // block)), "i").sortWithinPartitions("i")
    ends = F.concat(F.array(F.lit(-1).cast("long")), F.coalesce("js", F.array().cast("array<long>")), F.array(F.lit(n).cast("long")))
    full = full.select(ends.alias("ends"))
    inside = (F.get("ends", F.lit(1)) >= 0) & (F.get("ends", F.size("ends") - 2) < n)
    gaps = F.transform(F.slice("ends", 2, F.size("ends") - 1), lambda j, k: j - F.get("ends", k) - 1)
    checked = F.when(inside, gaps).otherwise(F.raise_error(F.lit(f"a column outside of the {n} of the matrix")).cast("array<long>"))
    full.select(checked.alias("gaps")).select(matrix_line(F.col("gaps"), sep).alias("value")).write.mode(
        "overwrite").option("compression", "lz4").text(path)
