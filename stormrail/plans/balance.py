"""BAL1: the balance-dataset job as one plan.

FLT8 (train types) -> FN5 (average delay) -> FN1 (4 classes) -> class
distribution (AGG10) -> SMP2 (every class cut to the smallest) -> output.
``balance=False`` is the classify-only mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from stormrail.functions.scalar import avg_delay, class_by_limits
from stormrail.operators.aggregates import class_distribution
from stormrail.operators.filters import train_types_in
from stormrail.operators.sampling import downsample_to_smallest


def balance_dataset(df: DataFrame, train_types: Sequence[str], keys: Sequence[str] = ("station", "time", "train_type"),
                    balance: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(balanced rows, class distribution before balancing)."""
    d = train_types_in(df, train_types)
    d = d.withColumn("delay", avg_delay("delay", "train_count")).withColumn("class", class_by_limits("delay"))
    dist = class_distribution(d, "class")
    out = downsample_to_smallest(d, list(keys), "class", seed) if balance else d
    return out, dist
