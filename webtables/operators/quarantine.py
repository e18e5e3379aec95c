"""Malformed JSON apart from the good rows: one pass, two outputs, and a share of bad rows above which a job fails.

``judge`` parses a JSON column once and says what is wrong with each row:

missing      NULL or blank
unreadable   no JSON, cut off, or no object
wrong type   an object whose fields have other types than the schema
incomplete   an object without the field that must be there

``sort_out`` stores the judged rows once and returns the good ones with what was parsed, and the bad ones as they came, with their
problem. The rows are counted on the way (observed metrics), so the check of the share costs no pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from webtables.functions.stages import pin
from webtables.session import cut_lineage

PROBLEMS = ("missing", "unreadable", "wrong type", "incomplete")
_CORRUPT = "__corrupt"


class TooManyBadRows(ValueError):
    """More rows of an input are malformed than the job allows."""


def _filled(value: Column, is_text: bool) -> Column:
    return value.isNotNull() & (value != "") if is_text else value.isNotNull()


def judge(raw: DataFrame, schema: str, parsed: str, needed: str | None = None, col: str = "json") -> DataFrame:
    """Add ``parsed``, the struct of ``schema``, and ``problem``, NULL for good rows. ``needed`` is a field that must be there."""
    whole = F.from_json(col, f"{schema}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT})
    seen = pin(raw, {parsed: whole})
    fields = seen.schema[parsed].dataType
    corrupt = F.col(f"{parsed}.{_CORRUPT}").isNotNull()
    names = [f.name for f in fields if f.name != _CORRUPT]
    # Of an object with a field of another type the other fields are still read; of what is no object none is.
    some = F.greatest(*[F.col(f"{parsed}.{n}").isNotNull().cast("int") for n in names], F.lit(0)) == 1
    has = _filled(F.col(f"{parsed}.{needed}"), fields[needed].dataType.simpleString() == "string") if needed else F.lit(True)
    problem = (
        F.when(F.col(col).isNull() | (F.trim(F.regexp_replace(col, r"\s+", " ")) == ""), "missing")
        .when(corrupt & some, "wrong type")
        .when(corrupt, "unreadable")
        .when(~has, "incomplete")
    )
    plain = F.struct(*[F.col(f"{parsed}.{n}").alias(n) for n in names])
    return pin(seen, {parsed: plain, "problem": problem})


def sort_out(judged: DataFrame, parsed: str, most: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``parsed``, bad rows with ``problem``) of judged rows.

    Raises TooManyBadRows if more than the share ``most`` of all rows is bad. An empty input has no bad rows.
    """
    seen = Observation()
    counted = judged.observe(seen, F.count(F.lit(1)).alias("n"), F.count("problem").alias("bad"))
    stored = cut_lineage(counted)
    n, bad = seen.get["n"], seen.get["bad"]
    if bad > most * n:
        raise TooManyBadRows(f"{bad} of {n} rows are malformed, {most:.2%} are allowed")
    return stored.where("problem IS NULL").drop("problem"), stored.where("problem IS NOT NULL").drop(parsed)
