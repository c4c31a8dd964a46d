"""User functions: pricers, and switchable layers on a projection.

A pricer is a DataFrame to DataFrame function registered by name. It is handed the
rows to price and the history, and must use the history of earlier days only; the
result is stamped with the day it was priced through and checked.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from closeline.operators import segments as G

Pricer = Callable[..., DataFrame]
_PRICERS: dict[str, Pricer] = {}


def pricer(name: str) -> Callable[[Pricer], Pricer]:
    def register(fn: Pricer) -> Pricer:
        _PRICERS[name] = fn
        return fn

    return register


def resolve(name: str) -> Pricer:
    if name not in _PRICERS:
        raise KeyError(f"no pricer {name!r}; known: {sorted(_PRICERS)}")
    return _PRICERS[name]


def defaulted(fn: Pricer, provided: Sequence[str]) -> list[str]:
    """Inputs on offer that the function would take but leaves at a default name it lacks."""
    takes = inspect.signature(fn).parameters
    if any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        return []
    return [n for n in provided if n not in takes]


def walk_forward(prices: DataFrame, history: DataFrame, fn: Pricer, **frames: DataFrame) -> DataFrame:
    """Run a pricer over all days at once: ``fn(prices, history, **frames)``."""
    lost = defaulted(fn, list(frames))
    if lost:
        raise TypeError(f"the pricer does not take {lost}")
    out = fn(prices, history, **frames)
    missing = {"probability", "priced_through"} - set(out.columns)
    if missing:
        raise ValueError(f"the pricer returned no {sorted(missing)}")
    return out


@pricer("base_rate")
def base_rate(prices: DataFrame, history: DataFrame) -> DataFrame:
    """Share won in the tier on earlier days, shrunk to one half.

    The history is one row per tier and day before anything is ordered.
    """
    days = history.groupBy("tier", "slate_date").agg(F.count_if(F.col("outcome") == "won").alias("w"), F.count("*").alias("n"))
    run = G.running_before(days, ["tier"], ["slate_date"], {"pw": F.col("w"), "pn": F.col("n")}, [F.trunc("slate_date", "month")])
    through = G.previous_row(run, ["tier"], ["slate_date"], {"priced_through": F.col("slate_date")}, F.trunc("slate_date", "month"))
    table = through.select("tier", "slate_date", ((F.col("pw") + 5) / (F.col("pn") + 10.0)).alias("probability"), "priced_through")
    return prices.join(table, ["tier", "slate_date"])


def price_batches(frame: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """A pricer that needs Python, one Arrow batch at a time; no grouping, no shuffle."""
    schema = T.StructType([*frame.schema.fields, T.StructField("probability", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(probability=fn(pdf))

    return frame.mapInPandas(run, schema)


@dataclass(frozen=True)
class Layer:
    """An additive factor on the projected margin and total, on or off."""

    key: str
    margin: Callable[[], Column] | None = None
    total: Callable[[], Column] | None = None
    on: bool = True


def apply_layers(base: DataFrame, layers: Sequence[Layer], switches: dict[str, bool] | None = None) -> DataFrame:
    """Fold the layers that are on into ``margin`` and ``total``; one projection."""
    switches = switches or {}
    live = [layer for layer in layers if switches.get(layer.key, layer.on)]
    add = lambda start, parts: reduce(lambda a, b: a + F.coalesce(b(), F.lit(0.0)), parts, start)
    return base.withColumns({
        "margin": add(F.col("margin"), [x.margin for x in live if x.margin is not None]),
        "total": add(F.col("total"), [x.total for x in live if x.total is not None])})
