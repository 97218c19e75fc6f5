"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormrail import roles
from stormrail.roles import read_table, with_roles  # noqa: F401


def r6(x, places: int = 6) -> Column:
    """Round a double for comparison as floor(x * 10^p + 0.5) / 10^p: the
    same IEEE operations in Spark and in the SQL oracle give bit-identical
    results (``round`` differs between engines on values such as
    67.0921875, whose shortest decimal form ends in 5)."""
    col = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** places)
    return (F.floor(col.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)) + F.lit(0.0)


def sql_r6(expr: str, places: int = 6) -> str:
    scale = f"{float(10 ** places)!r}"
    return f"(floor(cast({expr} as double) * {scale} + 0.5) / {scale} + 0.0)"


def rounded(df: DataFrame, cols, places: int = 6) -> DataFrame:
    cols = set(cols)
    return df.select(*[r6(x, places).alias(x) if x in cols else F.col(x) for x in df.columns])


R = roles
