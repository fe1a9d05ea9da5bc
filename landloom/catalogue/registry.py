"""Where queries register."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.catalogue import views as V
from landloom.session import measured_broadcasts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query and, if it can be said in SQL, its counterpart."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            measured_broadcasts(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if views:
                with_views = ", ".join(V.SQL[v] for v in views)
                head = next((h for h in ("WITH RECURSIVE ", "WITH ") if text.upper().startswith(h)), "")
                text = f"{head}{with_views}, {text[len(head) :]}" if head else f"WITH {with_views} {text}"
            ORACLES[name] = text
        return fn

    return add


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)
