"""Registered queries and their SQL twins.

A query is a function ``(spark, sf_dir) -> DataFrame``. Its twin is SQL text over the raw tables; common
table expressions named in ``CTES`` are added on demand. Doubles are rounded on both sides so that the
order of floating point sums does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seismark.session import ensure_utc

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
_RECURSIVE: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cte(name: str, sql: str, recursive: bool = False) -> None:
    CTES[name] = sql.strip()
    if recursive:
        _RECURSIVE.add(name)


def _needed(sql: str, seen: list[str], own: str = "") -> list[str]:
    """Names of the table expressions read by ``sql``, dependencies first."""
    for name in CTES:
        if name != own and name not in seen and re.search(rf"\b(?:from|join)\s+{name}\b(?!\s*\()", sql):
            _needed(CTES[name], seen, name)
            if name not in seen:
                seen.append(name)
    return seen


def with_ctes(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql
    word = "with recursive" if any(n in _RECURSIVE for n in names) else "with"
    parts = [f"{n} as {'' if n in _RECURSIVE else 'materialized '}({CTES[n]})" for n in names]
    return f"{word} " + ",\n".join(parts) + "\n" + sql


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column; integers become bigint so both engines agree on the type."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("bigint").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, rnd: str = "", digits: int = DIGITS) -> Callable:
    """Register ``fn`` under ``name``; ``rnd`` names the double columns of the SQL twin.

    ``digits`` differs where results are short decimals that would end exactly between two rounded values.
    """

    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return rounded(fn(spark, sf_dir), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if rnd:
                rep = ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in rnd.split())
                body = f"select * replace ({rep}) from ({body}) final_rows"
            else:
                body = f"select * from ({body}) final_rows"
            ORACLES[name] = with_ctes(body)
        return fn

    return deco
