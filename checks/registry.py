"""Collects queries with their oracle statements."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ByteType, FloatType, IntegerType, ShortType

from .oracle_base import sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, single floats as DOUBLE, so both engines report the same types."""
    casts = {f.name: F.col(f.name).cast("bigint") for f in df.schema if isinstance(f.dataType, (ByteType, ShortType, IntegerType))}
    casts |= {f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, FloatType)}
    return df.withColumns(casts) if casts else df


def query(oracle: str | None = None):
    """Register a function (spark, sf) -> DataFrame under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf: flat(fn(spark, sf))
        if oracle is not None:
            ORACLES[fn.__name__] = sql(oracle)
        return fn

    return add
