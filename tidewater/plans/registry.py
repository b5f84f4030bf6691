"""Named queries: a plan over the driver's tables, the operators it shows and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    plan: Callable[[Tables], DataFrame]
    operators: tuple[str, ...]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        if plan.__name__ in QUERIES:
            raise ValueError(f"two queries {plan.__name__}")
        QUERIES[plan.__name__] = Query(plan, tuple(operators.split()), sql)
        return plan

    return register
