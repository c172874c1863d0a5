"""Query registry and the small helpers both sides share.

``cols`` names the result columns with their type letter: b bigint, d double
(rounded to six digits), s string, o boolean.  Spark results and oracle SQL are
brought to these types, so both sides are compared like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_SPARK = {"b": "bigint", "d": "double", "s": "string", "o": "boolean"}
_DUCK = {"b": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "o": "BOOLEAN"}
DIGITS = 6


def _parse(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(":")) for c in cols.split(",")]


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as ``name`` and its oracle SQL, both cast to ``cols``."""
    spec = _parse(cols)

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = []
            for column, kind in spec:
                value = F.col(column).cast(_SPARK[kind])
                out.append((F.round(value, DIGITS) if kind == "d" else value).alias(column))
            return fn(spark, sf_dir).select(*out)

        QUERIES[name] = run
        if sql is not None:
            casts = [
                f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" if k == "d" else f"CAST({c} AS {_DUCK[k]}) AS {c}"
                for c, k in spec
            ]
            with_part, body = _split_with(sql)
            ORACLE[name] = f"{with_part} SELECT {', '.join(casts)} FROM ({body}) AS result".strip()
        return fn

    return register


def _split_with(sql: str) -> tuple[str, str]:
    """Separate a leading WITH list, marked off from the final query by a line ``--final``."""
    if "--final" in sql:
        head, body = sql.split("--final")
        return head.strip(), body.strip()
    return "", sql.strip()


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
