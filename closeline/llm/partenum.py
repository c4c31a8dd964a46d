"""N-gram Jaccard join by PartEnum signatures.

A text's set is its distinct five-word shingles (fewer words: the whole sequence). Two
texts link if their sets have Jaccard similarity 0.8 or more: the sets then differ in at
most k elements, where k follows from their sizes. Sets are banded by size so that a pair
falls into one band or two neighbouring ones; each band has its own instance, in which a
set takes part with its own band and the one below. In an instance the domain of shingles
is cut by hash into more than k partitions, in groups of two of which one may differ:
the enumerated subsets are the single partitions, and the sets of a pair agree on at
least one of them. Empty partitions say nothing and give no signature, unless so many of
a set's partitions are empty that a pair might agree on empty ones only. There are so many
partitions that a pair agrees on several that aren't empty: fewer in common is no link.

Equal sets are one node from the start. Signatures meet in blocks of arrays: equal ones
of one task are thinned out there, so one signature's nodes never gather in one place.
Of the nodes that share signatures each is verified against the node it shares most
signatures with, then components are built; whatever pairs of different components still
share a signature is verified after that, first against one node each, then all. No
link between different sets is lost, and the pairs of a component aren't enumerated.

Sets are compared by 64-bit hashes of shingles, nodes by a 64-bit hash of the set.

A null text, or one without words, has an empty set and links with nothing: its component
is itself. Repeated rows, and different ids of one text, share a node; a null id belongs
to its component but can't be its least id unless all are null. Very long texts are one
set like any. An empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from closeline.llm import candidates, graph, texts
from closeline.session import cut_lineage

SLICE_BYTES = 1 << 18  # arrays of 2 MB stay in the caches of a core
WORDS = 5
SPARE = 130  # partitions in percent of those that one agreement takes
MOST_NEEDED = 1 << 40
SUBSETS = 2  # partitions in a group; subsets hold one less than may differ


@lru_cache(maxsize=1)
def bands(largest: int = 1 << 31) -> np.ndarray:
    """Least size of each band: a set is at most 5/4 of its partner, one band further at most."""
    low = [1]
    while low[-1] < largest:
        low.append(max(low[-1] + 1, -(-low[-1] * 5 // 4)))
    return np.array(low, np.int64)


def most_apart(total: int) -> int:
    """Largest symmetric difference of two sets of ``total`` elements that link."""
    return total - 2 * -(-4 * total // 9)


@lru_cache(maxsize=None)
def instance(band: int) -> tuple[int, int]:
    """k and the number of partitions for pairs whose smaller set is of the band."""
    low, high = int(bands()[band]), int(bands()[band + 1]) - 1
    largest = high + high * 5 // 4
    k = max(most_apart(s) for s in range(max(2, largest - 10), largest + 1))
    if k < SUBSETS:
        return k, k + 1
    return k, SUBSETS * -(-SPARE * (k + 1) // (100 * SUBSETS))


def sets(s: texts.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their rows, sorted by both."""
    starts, ends = texts.spans(s, texts.IS_SPACE)
    words = texts.hashes(texts.FOLD[s.data], starts, ends)
    values, per = texts.shingles(words, s.per_row(starts), WORDS)
    return texts.distinct(values, np.repeat(np.arange(s.rows), per))


def nodes(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size of each row's set."""
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, rows, texts.mix(values ^ np.uint64(0x5851F42D4C957F2D)))
    size = np.bincount(rows, minlength=n)
    return texts.mix(sums + size.astype(np.uint64)).view(np.int64), size


def signatures(values: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each row's set in both of its instances, their rows, and how many of them a pair shares at least."""
    full = np.flatnonzero(size)
    out, of = [], []
    need = np.full(len(size), MOST_NEEDED)
    own = np.searchsorted(bands(), size, "right") - 1
    for below in (0, 1):
        band = own - below
        taking = full[band[full] >= 0]
        if not len(taking):
            continue
        uniq, at = np.unique(band[taking], return_inverse=True)
        params = np.array([instance(int(b)) for b in uniq], np.int64).reshape(-1, 2)[at]
        parts, agree = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        parts[taking], agree[taking] = params[:, 1], params[:, 1] - params[:, 0]
        first = np.cumsum(parts) - parts
        chosen = parts[rows] > 0
        v, r = values[chosen], rows[chosen]
        salted = texts.mix(v + np.uint64(0x2545F4914F6CDD1D))
        cell = first[r] + ((salted >> np.uint64(32)) * parts[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, cell, texts.mix(salted))
        filled = np.bincount(cell, minlength=len(sums)) > 0
        cell_row = np.repeat(np.arange(len(size)), parts)
        empty = np.bincount(cell_row[~filled], minlength=len(size))
        keep = filled | (empty >= agree)[cell_row]
        need[taking] = np.minimum(need, np.where(empty >= agree, 1, agree - empty))[taking]
        place = (np.arange(len(sums)) - first[cell_row]).astype(np.uint64)
        label = texts.mix(band[cell_row].astype(np.uint64) << np.uint64(40) | place)
        out.append(texts.mix(sums ^ label)[keep])
        of.append(cell_row[keep])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), need
    return np.concatenate(out), np.concatenate(of), need


def shingle_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, n_shingles) per document; node is null for an empty set."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in texts.slices(batch.column(1), SLICE_BYTES):
                ids, size = nodes(*sets(s), s.rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(ids, mask=size == 0), pa.array(size)], ["doc_id", "node", "n_shingles"])

    return texts.mapped(frame, run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, node long, n_shingles long")


def _keys(s: texts.Slice) -> tuple[np.ndarray, np.ndarray]:
    values, rows = sets(s)
    ids, size = nodes(values, rows, s.rows)
    signs, of, need = signatures(values, rows, size)
    return signs, ids[of], ids[size > 0], need[size > 0]


def _items(s: texts.Slice):
    values, rows = sets(s)
    ids, size = nodes(values, rows, s.rows)
    edges = np.searchsorted(rows, np.arange(s.rows + 1))
    full = np.flatnonzero(size)

    def content(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        contents = [values[edges[i]:edges[i + 1]].tobytes() for i in full[places]]
        return *elements(contents), contents

    return ids[full], content


def elements(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of sets and the set of each."""
    return np.frombuffer(b"".join(contents), np.uint64), np.repeat(np.arange(len(contents)), [len(c) // 8 for c in contents])


def links_between(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (a, b) between nodes whose components are those of all links."""
    column = docs.select(F.col(text_col).cast("string").alias("text"))
    entries = cut_lineage(candidates.shared(column, _keys, SLICE_BYTES))
    items = cut_lineage(candidates.items_of(column, entries.select("node").distinct(), _items, SLICE_BYTES))
    return candidates.links(entries, items, elements)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, node): least id reachable by links, per document."""
    rows = cut_lineage(shingle_nodes(docs, id_col, text_col))
    least = graph.components(links_between(docs, text_col))
    rows = rows.join(least, "node", "left").withColumn("component", F.coalesce("least", "node"))
    ids = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that link, directly or not, to one of a lesser id; columns stay.

    Rows that repeat the least id itself stay. Only documents that may go are shuffled.
    """
    dropped = cut_lineage(classes(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct())
    sieve = candidates.Sieve(dropped.select(F.xxhash64("_dropped").alias("node")))
    names = docs.columns
    docs, (ident,) = texts.plain(docs, "doc_id")
    hit = sieve.may_hold(F.xxhash64(ident))
    return docs.where(hit).join(dropped, F.col(ident) == F.col("_dropped"), "left_anti").union(docs.where(~hit)).toDF(*names)
