"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, text: str, num: str, cnt: str) -> DataFrame:
    """The listed columns: text as it is, doubles rounded to 6 places, counts as BIGINT."""
    return df.select(
        *[F.col(c) for c in text.split()],
        *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in num.split()],
        *[F.col(c).cast("long").alias(c) for c in cnt.split()],
    )


def select_sql(ctes: list[str], frm: str, text: str, num: str, cnt: str) -> str:
    columns = text.split()
    columns += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in num.split()]
    columns += [f"CAST({c} AS BIGINT) AS {c}" for c in cnt.split()]
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {', '.join(columns)} FROM {frm}"


def query(name: str, text: str = "", num: str = "", cnt: str = "", ctes: list[str] | None = None, frm: str = ""):
    """Register a query; with ``frm`` also its SQL, reading the named relation."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), text, num, cnt)
        if frm:
            ORACLES[name] = select_sql(ctes or [], frm, text, num, cnt)
        return fn

    return add
