"""Lists of rows with one key, compared within a task, whatever a key's weight.

Rows (key, member, ...) of one key meet in a tile. A key with more than ``piece`` rows,
counted first, is cut by hash of the member into pieces; each two pieces meet in a tile of
their own, so that a hot key's comparisons spread over many tasks and no tile holds more
than about two pieces. Tasks read tiles in order and hold one buffer of whole tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TILE = ("key", "lo", "hi", "part")


def tiled(keyed: DataFrame, piece: int, suspects: DataFrame | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``lo``, ``hi`` and ``part`` added, dealt by tile and sorted by TILE, then ``order``, in each partition.

    ``suspects`` holds the rows whose keys can be over ``piece`` (all, if not given).
    """
    counts = (keyed if suspects is None else suspects).groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    hot = counts.where(F.col("held") > piece).select("key", F.ceil(F.col("held") / piece).cast("int").alias("pieces"))
    part = F.pmod(F.xxhash64("member"), F.coalesce("pieces", F.lit(1))).cast("int")
    rows = keyed.join(hot, "key", "left").withColumn("part", part)
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, coalesce(pieces, 1) - 1)")))
    rows = rows.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("pieces", "other")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions(*TILE, *order)


def buffers(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows in order, as tables of whole tiles with ``limit`` rows or few more."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= limit:
            rows = pa.Table.from_batches(waiting)
            edges = np.flatnonzero(_new(rows))
            if edges[-1]:
                yield rows.slice(0, edges[-1])
                rows = rows.slice(edges[-1])
            waiting, held = rows.combine_chunks().to_batches(), rows.num_rows
    if held:
        yield pa.Table.from_batches(waiting)


def _new(rows: pa.Table) -> np.ndarray:
    """Whether a row starts a tile."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for name in TILE[:3]:
        values = rows.column(name).to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def partners(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, whole): row i is to be compared with rows begin[i] to end[i]; whether its tile is one piece with itself."""
    n = rows.num_rows
    starts = np.flatnonzero(_new(rows))
    sizes = np.diff(np.append(starts, n))
    ends = np.repeat(starts + sizes, sizes)
    lo, hi, part = (rows.column(c).to_numpy() for c in TILE[1:])
    whole = lo == hi
    second = np.add.reduceat((part == lo).astype(np.int64), starts) + starts if n else starts
    begin = np.where(whole, np.arange(n) + 1, np.repeat(second, sizes))
    return begin, np.where(whole | (part == lo), ends, begin), whole
