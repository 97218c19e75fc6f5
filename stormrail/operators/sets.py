"""Set operations (SET1-SET4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def concat_all(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """SET1: union by column name (missing columns as NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def union_times(frames: Sequence[DataFrame], time: str = "time") -> DataFrame:
    """SET2: the distinct times of several frames."""
    return concat_all([f.select(time) for f in frames]).distinct()


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET3: rows of ``left`` whose keys are not in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")
