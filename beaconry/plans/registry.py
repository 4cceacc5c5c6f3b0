"""Registry of named queries, each with its operator IDs and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ops: tuple[str, ...]
    run: Query
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def query(ops: str, oracle: str | None = None, name: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in ENTRIES:
            raise ValueError(f"query {key} is registered twice")
        ENTRIES[key] = Entry(key, tuple(ops.split()), fn, oracle)
        return fn

    return register
