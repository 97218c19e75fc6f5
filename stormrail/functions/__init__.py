"""Scalar column expressions (FN*, PRJ*). All return ``Column`` objects built
from ``pyspark.sql.functions`` so they run inside whole-stage codegen."""

from stormrail.functions.scalar import *  # noqa: F401,F403
from stormrail.functions.constants import *  # noqa: F401,F403
