"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with its SQL where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _module in ("text", "search", "chunks", "aggregates", "lint", "chat", "pages", "more", "indexes", "deep", "varied", "pdf"):
    importlib.import_module(f"docengine.queries.{_module}")
