"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.plans.views import sql_with, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(views: str = "", sql: str = ""):
    """Register a query (spark, sf_dir, *views) with its SQL over the same views."""

    def register(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf: f(*(view(spark, sf, v) for v in views.split()))
        if sql:
            SQL[f.__name__] = sql_with(views, sql)
        return f

    return register


def six(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)
