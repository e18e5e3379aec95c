"""Keeping expensive columns from being computed twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it; also inside lambdas.

    A fold over nothing only finishes: unlike a one-element transform it does not copy the value.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def pin(df: DataFrame, cols: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add (or replace) columns such that later filters read them as they are.

    The optimizer pushes a filter through a projection by copying the projected
    expression into it; with a chain of parsed columns that copies whole parsers, several
    times over. A one-element explode stops the copy: filters on its output stay above it.
    It neither shuffles nor leaves code generation.
    """
    keep = [c for c in df.columns if c not in cols and c not in drop]
    row = F.struct(*[c.alias(name) for name, c in cols.items()])
    return df.select(*keep, F.explode(F.array(row)).alias("__pin")).select(
        *keep, *[F.col(f"__pin.{name}").alias(name) for name in cols]
    )
