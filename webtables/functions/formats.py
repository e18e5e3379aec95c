"""Small formatting columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units in steps of 1024.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(size: Column) -> Column:
    """'0 B', '1.5 KB', ...: one decimal, ties to even."""
    value = size.cast("double")
    text = F.when(value == 0, "0 B")
    for power, unit in enumerate(SIZE_UNITS):
        scaled = F.format_string("%.1f " + unit, F.bround(value / float(1024**power), 1))
        text = text.otherwise(scaled) if unit == SIZE_UNITS[-1] else text.when(value < float(1024 ** (power + 1)), scaled)
    return text
