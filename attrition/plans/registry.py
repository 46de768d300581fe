"""Registry of named queries: a Spark plan builder plus, where SQL can express it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from .inputs import Inputs


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    ops: str


_REGISTRY: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` (with its oracle SQL, if any)."""

    def deco(fn: Callable[[Inputs], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, ops)
        return fn

    return deco


def registered() -> dict[str, Query]:
    from . import catalogue, catalogue_explore, catalogue_models, catalogue_profile  # noqa: F401,E501

    return dict(_REGISTRY)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = registered()[name]

    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return q.build(Inputs(spark, data_dir))

    run.__name__ = name
    return run
