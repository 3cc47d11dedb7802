"""The marker struct and its constructors."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions.text import clamp

MARKER_TYPE = (
    "array<struct<category:string,name:string,severity:string,description:string,"
    "evidence:string,score:double,page_number:int>>"
)


#: Set while columns are built whose descriptions and evidence nobody reads.
_wordless = False


@contextmanager
def wordless_markers():
    global _wordless
    before, _wordless = _wordless, True
    try:
        yield
    finally:
        _wordless = before


def as_column(value: Column | str | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def marker(category, name, severity, description, evidence, score, page_number=1) -> Column:
    """One marker; the score is held inside [0, 1]."""
    if _wordless:
        description = evidence = F.lit(None).cast("string")
    return F.struct(
        as_column(category).alias("category"),
        as_column(name).alias("name"),
        as_column(severity).alias("severity"),
        as_column(description).alias("description"),
        as_column(evidence).alias("evidence"),
        clamp(as_column(score).cast("double"), 0.0, 1.0).alias("score"),
        as_column(page_number).cast("int").alias("page_number"),
    )


def none() -> Column:
    return F.array().cast(MARKER_TYPE)


def emit(condition: Column, found: Column) -> Column:
    """``[found]`` when the condition holds, else an empty array."""
    return F.when(condition, F.array(found)).otherwise(none())


def emit_many(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(none())


def join(values: Column, separator: str = ", ") -> Column:
    return F.array_join(values, separator)
