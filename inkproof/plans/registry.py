"""Named queries: each name maps to a Spark query and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"query {name} registered twice")
    ENTRIES[name] = Entry(run, sql)


def query(name: str, sql: str | None = None):
    def wrap(run: Query) -> Query:
        register(name, run, sql)
        return run

    return wrap


def load() -> dict[str, Entry]:
    """Import every catalog module and return all entries."""
    from inkproof.plans.catalog import (  # noqa: F401
        comparison, features, learning, markers, scoring, sources, storage, streams, warehouse,
    )

    return ENTRIES
