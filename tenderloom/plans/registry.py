"""Registered queries: a Spark job and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderloom.plans.domain import Domain

JOBS: dict[str, Callable[[Domain], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def job(name: str, check: str | None = None):
    def register(f: Callable[[Domain], DataFrame]):
        JOBS[name] = f
        if check is not None:
            CHECKS[name] = check
        return f

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    f = JOBS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(Domain(spark, folder))

    run.__name__ = name
    run.__doc__ = f.__doc__
    return run
