"""Registration of queries: result columns, the Spark side, and the DuckDB side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_DUCK = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _shaped(df: DataFrame, columns: list[list[str]]) -> DataFrame:
    out = []
    for name, kind in columns:
        c = F.col(name).cast(kind)
        out.append((F.round(c, 6) + F.lit(0.0) if kind == "double" else c).alias(name))
    return df.select(*out)


def query(columns: str, sql: str | None = None):
    """Registers f(b) under its name; columns lists `name type`, cast alike on both sides, doubles to 6 places."""
    parts = [c.split() for c in columns.split(",")]

    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: _shaped(f(Tables(spark, sf_dir)), parts)
        if sql is not None:
            shown = ", ".join(f"round(CAST(q.{c} AS DOUBLE), 6) + 0.0 AS {c}" if k == "double" else f"CAST(q.{c} AS {_DUCK[k]}) AS {c}" for c, k in parts)
            full = with_views(sql)
            ORACLE_SQL[name] = f"SELECT {shown} FROM ({full}) q".replace("AS STRING)", "AS VARCHAR)")
        return f

    return add
