"""All registered queries. A plan module lists ``(name, build, check)``: ``build`` maps Tables to a DataFrame,
``check`` is DuckDB SQL over the same views, or None where SQL cannot say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, oracle

AREAS = ["core", "governance", "repositories", "graphs", "streams"]


def _entries():
    for area in AREAS:
        yield from importlib.import_module(f".{area}", __package__).PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(check) for name, _, check in _entries() if check}
