"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormrail.session import ensure_checkpoint_dir

#: Bytes of text that a task works on at once (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20

#: A word: a run of code points other than space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Lost executors cost only the tasks that ran on them, and the size of the files tells Catalyst whether the
    table is small enough to be sent to every task. ``slim``: rows of a few numbers, whose last step runs in two
    tasks for each core of the cluster rather than in one for each shuffle partition.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if slim else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uniform(*cols) -> F.Column:
    """A repeatable draw from (0, 1) for each row: 52 bits of a hash of ``cols``."""
    return ((F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") + 0.5) / float(1 << 52)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for i, n in enumerate(sizes):
            if i > first and total + n > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += int(n)
        if first < batch.num_rows:
            yield batch.slice(first)


def numbered(df: DataFrame, order: list, number: str, name: str = "numbered") -> DataFrame:
    """``df``, written, with the position of each row (from 0) in the order of the given columns.

    One range shuffle; positions inside a partition come from the row counter of its task, and the only table that
    is summed in one place has a row for each partition.
    """
    part, at = f"__part_{number}", f"__at_{number}"
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(part).alias("p"), F.coalesce(before, F.lit(0)).alias("start"))
    return rows.join(starts, F.col(part) == F.col("p")).withColumn(number, F.col("start") + F.col(at)).drop(
        part, at, "p", "start")
