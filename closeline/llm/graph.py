"""Connected components by joins and sums: every node learns the least of its component.

Each round makes every node point its larger neighbours at the least node it sees, then
its own links at the least of its smaller ones (alternating stars); components stay as
they are while the links flatten to stars. A node's neighbours are never gathered: they
meet in a minimum with partial sums, and the join on a hub can be split. A graph of at
most ``ONE_TASK`` links, counted first, is flattened in one task instead, with the same
result: rounds of shuffles over so few rows would cost more than the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from closeline.session import cut_lineage

ROUNDS = 60
ONE_TASK = 1 << 20  # 16 MB of links


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Links (a > b) after one star step over all neighbours, or over smaller ones only."""
    sides = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = sides.join(least, "a")
    if both:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, least = _least(*(np.concatenate(p) for p in zip(*parts)))
            inner = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(least[inner])], ["node", "least"])

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, least long")


def components(links: DataFrame) -> DataFrame:
    """(node, least): least node of its component, for each node of links (a, b) that isn't the least."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    if links.count() <= ONE_TASK:
        return cut_lineage(_in_one_task(links))
    before = None
    for _ in range(ROUNDS):
        links = cut_lineage(_stars(_stars(links, True), False).distinct())
        # In stars every node has one link and no least node has any.
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("least"))
        before = tuple(state)
    raise RuntimeError(f"components not found in {ROUNDS} rounds")
