"""Registered queries: a Spark plan and, where SQL can say it, the same in ANSI SQL.

A query names its output columns with a kind each (``i`` long, ``d`` double rounded to
six places, ``s`` text, ``b`` boolean, ``t`` date, ``x`` as is). The same list shapes
both results, so they compare column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from closeline import session
from closeline.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Decimals that end in a five at the seventh place would round by the last bit of the
# sum; both sides are moved off that boundary by the same amount before rounding.
_NUDGE = 3.1e-08

_CASTS = {"i": "long", "d": "double", "s": "string", "b": "boolean", "t": "date"}
_SQL_CASTS = {"i": "bigint", "s": "varchar", "b": "boolean", "t": "date"}


def _spec(columns: str) -> list[tuple[str, str]]:
    out = []
    for token in columns.split():
        name, _, kind = token.partition(":")
        out.append((name, kind or "s"))
    return out


def shape(frame: DataFrame, columns: str) -> DataFrame:
    exprs = []
    for name, kind in _spec(columns):
        c = F.col(name)
        if kind == "d":
            v = c.cast("double")
            c = F.round(F.when(~F.isnan(v), v) + F.lit(_NUDGE), 6) + F.lit(0.0)
        elif kind != "x":
            c = c.cast(_CASTS[kind])
        exprs.append(c.alias(name))
    return frame.select(*exprs)


def shape_sql(columns: str, body: str) -> str:
    exprs = []
    for name, kind in _spec(columns):
        if kind == "d":
            exprs.append(f"case when isnan(cast({name} as double)) then null else round(cast({name} as double) + {_NUDGE!r}, 6) + 0.0e0 end as {name}")
        elif kind == "x":
            exprs.append(name)
        else:
            exprs.append(f"cast({name} as {_SQL_CASTS[kind]}) as {name}")
    return f"select {', '.join(exprs)} from ({body}) as result"


def query(name: str, columns: str, sql: str | None = None):
    """Register a plan ``fn(tables) -> DataFrame``; ``sql`` may use the adapter views."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.ensure(spark)
            return shape(fn(views.Tables(spark, sf_dir)), columns)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(shape_sql(columns, sql))
        return fn

    return register
