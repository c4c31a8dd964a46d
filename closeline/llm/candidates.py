"""Pairs that share a key, verified, without listing the pairs of a group.

Keys of nodes (texts, lines, sets: 64-bit numbers) meet in blocks of arrays; equal keys of
one task are thinned out there, so one key's nodes never gather in one place. Of the
nodes that share keys, each is verified against the node it shares most keys with; what
links becomes components. Whatever different components still share a key is compared
next: first with one node of the key, then, in tiles inside a task, with the others of the
keys whose most central node is the same. A pair leaves its tile only if sketches of both
sets allow the similarity: parities of the elements that fall on a bit, so that the bits in
which two sketches differ are never more than the elements in which the sets do. Those that
leave are verified. So no link that shares a key is lost to the components, and neither the
pairs of a component nor those of a key are listed.

Where links are known to share several keys, each node comes with that number, its need:
a node with fewer shared keys has no link and goes before anything else is read. Of keys
that different components share, a node may leave out the most held ones, in one order for
all nodes, as long as they are fewer than its need: a pair that links meets in a rarer one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from closeline.llm import graph, texts, tiles
from closeline.session import cut_lineage

FLUSH = 1 << 20  # keys that a task thins out together
SIEVE_BITS = 1 << 23
BLOCKS_PER_PARTITION = 4
REMEMBERED = 200_000
SKETCH_BITS = 8, 16  # least and largest width as powers of two; between them, four bits or more an element
PIECE = 1024  # nodes of one key in a piece of tiles
BUFFER = 1 << 12
TOGETHER = 1 << 20  # bytes of contents, pairs times 8, or bytes of sketches compared in one step

Elements = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # contents to distinct elements and the content of each

_KEY = np.uint64(1 << 63)  # marks keys; smaller numbers are needs
_PLACE_BYTES = 5  # of a key within its block
_PACKED = pa.schema([("block", pa.int32()), ("found", pa.bool_()), ("sigs", pa.binary()), ("nodes", pa.binary())])
_ITEMS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("items", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _thin(sig: np.ndarray, node: np.ndarray, blocks: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Entries of one task by block. Signatures that are shared already here go on as found; one node of each stands for them."""
    order = texts.together(texts.mix(sig))
    sig, node = sig[order], node[order]
    alone = np.ones(len(sig), bool)
    alone[1:] = sig[1:] != sig[:-1]
    alone[:-1] &= alone[1:].copy()
    held, of = sig[~alone], node[~alone]
    order = np.lexsort((of, held))
    held, of = held[order], of[order]
    new = np.ones(len(held), bool)
    new[1:] = (held[1:] != held[:-1]) | (of[1:] != of[:-1])
    held, of = held[new], of[new]
    first = np.ones(len(held), bool)
    first[1:] = held[1:] != held[:-1]
    shared = ~first
    shared[:-1] |= ~first[1:]
    ones = np.concatenate((sig[alone], held[first])), np.concatenate((node[alone], of[first]))
    for found, (s, x) in ((False, ones), (True, (held[shared], of[shared]))):
        block = ((texts.mix(s ^ x.view(np.uint64)) if found else s) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")  # small numbers by radix
        edges = np.searchsorted(block[order], np.arange(blocks + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[b]:edges[b + 1]]
            yield b, found, s[at], x[at]


def _packed(sig: np.ndarray, node: np.ndarray, blocks: int) -> tuple[bytes, bytes]:
    """Keys of a block by their places in it, node by node; each node with how many of them are its own, 255 at most at a time."""
    order = np.argsort(node, kind="stable")
    places = sig[order] // np.uint64(blocks)
    ids, per = np.unique(node, return_counts=True)
    runs = -(-per // 255)
    counts = np.full(int(runs.sum()), 255, np.uint8)
    counts[np.cumsum(runs) - 1] = per - 255 * (runs - 1)
    return places.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PLACE_BYTES].tobytes(), np.repeat(ids, runs).tobytes() + counts.tobytes()


def _unpacked(block: int, blocks: int, sigs: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, runs = len(sigs) // _PLACE_BYTES, len(nodes) // 9
    places = np.zeros((n, 8), np.uint8)
    places[:, :_PLACE_BYTES] = np.frombuffer(sigs, np.uint8).reshape(n, _PLACE_BYTES)
    ids, counts = np.frombuffer(nodes[:8 * runs], np.int64), np.frombuffer(nodes[8 * runs:], np.uint8)
    return places.view("<u8").ravel() * np.uint64(blocks) + np.uint64(block), np.repeat(ids, counts)


def one_is_enough(keys: Callable) -> Callable:
    """Marks a function of keys that never gives needs."""
    keys.needs = False
    return keys


def shared(column: DataFrame, keys: Callable[[texts.Slice], tuple[np.ndarray, ...]], slice_bytes: int = texts.SLICE_BYTES) -> DataFrame:
    """(sig, node, need, central): keys that more than one node has.

    ``keys`` gives keys and their nodes for a slice of the one text column, and, if links
    share more than one key, nodes and their needs; if it is marked by ``one_is_enough``, what
    only counts keys against needs is left out. Keys are told apart by their block and
    five bytes more, so their space grows with the blocks; keys that coincide by chance only
    add comparisons.
    """
    blocks = BLOCKS_PER_PARTITION * int(column.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(sig: list[np.ndarray], node: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, found, s, x in _thin(np.concatenate(sig), np.concatenate(node), blocks):
            sigs, nodes = ((s | _KEY).tobytes(), x.tobytes()) if found else _packed(s, x, blocks)
            yield pa.RecordBatch.from_pylist([{"block": b, "found": found, "sigs": sigs, "nodes": nodes}], _PACKED)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, node, n = [], [], 0
        for batch in batches:
            for s in texts.slices(batch.column(0), slice_bytes):
                got, of, *noted = keys(s)
                sig.append(got % np.uint64(blocks << 8 * _PLACE_BYTES))
                node.append(of)
                if noted and len(noted[0]):  # small, and in any block
                    block = int(noted[0].view(np.uint64)[0] % np.uint64(blocks))
                    yield pa.RecordBatch.from_pylist([{"block": block, "found": True, "sigs": noted[1].astype(np.uint64).tobytes(), "nodes": noted[0].tobytes()}], _PACKED)
                n += len(got)
                if n >= FLUSH:
                    yield from emit(sig, node)
                    sig, node, n = [], [], 0
        if n:
            yield from emit(sig, node)

    def meet(block: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        sigs, ids, waiting = [none], [none], []
        for b, found, s, x in zip(*(block.column(c).to_pylist() for c in ("block", "found", "sigs", "nodes"))):
            if found:
                sigs.append(np.frombuffer(s, np.int64))
                ids.append(np.frombuffer(x, np.int64))
            else:
                waiting.append(_unpacked(b, blocks, s, x))
        if waiting:
            for _, found, s, x in _thin(*(np.concatenate(p) for p in zip(*waiting)), 1):
                if found:
                    sigs.append((s | _KEY).view(np.int64))
                    ids.append(x)
        return pa.table({"sig": np.concatenate(sigs), "node": np.concatenate(ids)})

    entries = texts.mapped(column, sign, "block int, found boolean, sigs binary, nodes binary")
    met = cut_lineage(entries.groupBy("block").applyInArrow(meet, "sig long, node long").distinct())
    if getattr(keys, "needs", True):
        noted = met.where("sig >= 0").groupBy("node").agg(F.max("sig").alias("need"))
        keyed = met.where("sig < 0")
        enough = keyed.groupBy("node").count().join(noted, "node", "left").select("node", "count", F.coalesce("need", F.lit(1)).alias("need")).where("count >= need")
        left = cut_lineage(keyed.join(enough.select("node", "need"), "node"))
    else:
        left = met.withColumn("need", F.lit(1).cast("long"))
    held = left.join(left.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "sig")
    # How often a node meets others: the text that copies were made from comes first.
    central = held.groupBy("node").agg(F.sum("held").alias("central"))
    return held.join(central, "node").select("sig", "node", "need", "central")


class Sieve:
    """Bit map of fixed size over the nodes of a table: what it rejects isn't in the table."""

    def __init__(self, nodes: DataFrame):
        bits = nodes.selectExpr(f"pmod(node, {SIEVE_BITS}L) as bit").groupBy(F.expr("cast(bit div 64 as int) as at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int))) as bits")).toPandas()
        table = np.zeros(SIEVE_BITS // 64, np.int64)
        table[bits["at"].to_numpy(int)] = bits["bits"].to_numpy(np.int64)
        self.table = nodes.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def holds(self, nodes: np.ndarray) -> np.ndarray:
        at = nodes % SIEVE_BITS
        return self.table.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0

    def may_hold(self, node: Column) -> Column:
        @F.pandas_udf("boolean")
        def test(nodes: pd.Series) -> pd.Series:
            return pd.Series(self.holds(nodes.to_numpy()))

        return test(node)


def sketches(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Size of each of n sets of distinct elements, which are hashes, and the parities of its elements by bit."""
    size = np.bincount(rows, minlength=n)
    width = 1 << np.clip(np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64), *SKETCH_BITS)
    edges = np.concatenate(([0], np.cumsum(width)))
    bit = (values & (width[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(edges[rows] + bit, minlength=int(edges[-1])) & 1
    data = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return size, [data[x:y] for x, y in zip((edges[:-1] >> 3).tolist(), (edges[1:] >> 3).tolist())]


def items_of(column: DataFrame, wanted: DataFrame, items: Callable[[texts.Slice], tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, list[bytes]]]]], slice_bytes: int = texts.SLICE_BYTES) -> DataFrame:
    """(node, n, sketch, items): size, sketch and content of the wanted nodes, each once.

    ``items`` gives the nodes of a slice and a function from places among them to their
    distinct elements, the place of each, and their contents. A bit map of fixed size keeps
    most others from being shuffled; the join decides.
    """
    sieve = Sieve(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in texts.slices(batch.column(0), slice_bytes):
                ids, content = items(s)
                chosen = []
                for i in np.flatnonzero(sieve.holds(ids)).tolist():
                    node = int(ids[i])
                    if node not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                        chosen.append(i)
                if chosen:
                    values, rows, contents = content(np.array(chosen))
                    size, bits = sketches(values, rows, len(chosen))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[chosen]), pa.array(size), pa.array(bits, pa.binary()), pa.array(contents, pa.binary())], schema=_ITEMS)

    found = texts.mapped(column, run, "node long, n long, sketch binary, items binary")
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in _ITEMS.names[1:]])


def alike(x: list[bytes], y: list[bytes], elements: Elements) -> np.ndarray:
    """Whether 100 * intersection >= 80 * union, for each x and y."""
    n = len(x)
    values, rows = elements(x + y)
    size = np.bincount(rows, minlength=2 * n)
    pair = rows % max(n, 1)
    marked = values ^ texts.mix(np.arange(1, n + 1))[pair]
    order = texts.together(marked)
    marked = marked[order]
    common = np.bincount(pair[order[1:]][marked[1:] == marked[:-1]], minlength=n)
    return 100 * common >= 80 * (size[:n] + size[n:] - common)


def _portions(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of places whose sizes sum to the limit or less, or of one place."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield slice(at, to)
        at = to


def verified(pairs: DataFrame, items: DataFrame, elements: Elements) -> DataFrame:
    """The pairs (a, b) whose contents are similar; sizes alone rule out those beyond 4 to 5."""
    a = items.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("items").alias("ai"))
    b = items.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("items").alias("bi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for some in _portions(np.array([len(p) + len(q) for p, q in zip(x, y)]), TOGETHER >> 2):
                hit = pa.array(alike(x[some], y[some], elements))
                yield batch.select([0, 1]).slice(some.start, some.stop - some.start).filter(hit).cast(_PAIRS)

    met = pairs.join(a, "a").join(b, "b").where("5 * least(an, bn) >= 4 * greatest(an, bn)")
    return met.select("a", "b", "ai", "bi").mapInArrow(run, "a long, b long")


def _folded(sketch: list[bytes], length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of ``width`` bytes, those of twice the width folded to it, and the place of each row's."""
    same, wide = np.flatnonzero(length == width), np.flatnonzero(length == 2 * width)
    halves = np.frombuffer(b"".join(sketch[i] for i in wide), np.uint64).reshape(-1, 2, width // 8)
    bits = np.concatenate((np.frombuffer(b"".join(sketch[i] for i in same), np.uint64).reshape(-1, width // 8), halves[:, 0] ^ halves[:, 1]))
    place = np.full(len(length), -1)
    place[np.concatenate((same, wide))] = np.arange(len(bits))
    return bits, place


def _possible(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of a buffer of tiles, of different components, that sizes and sketches allow to link."""
    begin, end, _ = tiles.partners(rows)
    node, comp, n = (rows.column(c).to_numpy() for c in ("member", "comp", "n"))
    sketch = rows.column("sketch").to_pylist()
    length = np.array([len(x) for x in sketch])
    folded = {int(w): _folded(sketch, length, int(w)) for w in np.unique(length)}
    count = np.maximum(end - begin, 0)
    for some in _portions(count, TOGETHER // 8):
        of = np.arange(some.start, some.stop)
        per = count[some]
        i = np.repeat(of, per)
        j = np.arange(len(i)) + np.repeat(begin[some] - (np.cumsum(per) - per), per)
        open_ = (comp[i] != comp[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        i, j = i[open_], j[open_]
        width = np.minimum(length[i], length[j])
        for w in np.unique(width).tolist():
            bits, place = folded[w]
            p, q = i[width == w], j[width == w]
            for at in range(0, len(p), max(1, TOGETHER // w)):
                x, y = p[at:at + TOGETHER // w], q[at:at + TOGETHER // w]
                apart = np.bitwise_count(bits[place[x]] ^ bits[place[y]]).sum(axis=1, dtype=np.int64)
                near = 9 * apart <= n[x] + n[y]
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[x[near]]), pa.array(node[y[near]])], schema=_PAIRS)


def possible(keyed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes of one key that may link, of (key, member, comp, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tiles.buffers(batches, BUFFER):
            yield from _possible(rows)

    pairs = tiles.tiled(keyed, PIECE).select(*tiles.TILE, "member", "comp", "n", "sketch").mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(entries: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their components, and the keys that different components share, each with one node.

    Keys of the same nodes are one key with the sum of their weights.
    """
    least = graph.components(links)
    known = entries.join(least, "node", "left").withColumn("comp", F.coalesce("least", "node")).drop("least")
    split = (known.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("central", "node", "comp")).alias("top"),
                                      F.expr("bit_xor(xxhash64(node))").alias("mark"), F.count(F.lit(1)).alias("held"), F.max("weight").alias("weight"))
             .where("low < high").groupBy("mark", "low", "high", "held", F.col("top.node").alias("center"), F.col("top.comp").alias("center_comp")))
    return known, split.agg(F.min("sig").alias("sig"), F.sum("weight").alias("weight"))


def links(entries: DataFrame, items: DataFrame, elements: Elements, needs: bool = True) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all links that share enough keys; without ``needs``, one."""
    # Each node with the node it shares most keys with among the most central of each key.
    centers = entries.groupBy("sig").agg(F.max(F.struct("central", "node")).alias("top")).select("sig", F.col("top.node").alias("center"))
    near = entries.select("sig", "node").join(centers, "sig").where("node <> center").groupBy("node", "center").count()
    first = near.groupBy("node").agg(F.max_by("center", F.struct("count", "center")).alias("center"))
    found = cut_lineage(verified(first.select(F.col("node").alias("a"), F.col("center").alias("b")), items, elements))
    known, split = _labelled(entries.withColumn("weight", F.lit(1).cast("long")), found)
    # Components only grow, so other keys than these are of no more use.
    open_ = cut_lineage(known.drop("weight").join(split.select("sig", "weight", "center", "center_comp"), "sig"))
    again = open_.where("comp <> center_comp").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    found = cut_lineage(found.union(verified(again, items, elements)))
    known, split = _labelled(open_.select("sig", "node", "need", "central", "weight"), found)
    open_ = known.select("sig", "node", "comp", "need").join(split.select("sig", "weight", "held", "center"), "sig")
    most_held = Window.partitionBy("node").orderBy(F.desc("held"), F.desc("sig")).rowsBetween(Window.unboundedPreceding, 0)
    if needs:  # each key weighs one at least
        open_ = open_.withColumn("so_far", F.sum("weight").over(most_held)).where("so_far >= need")
    keyed = open_.select(F.col("center").alias("key"), "node", "comp").distinct().join(items.select("node", "n", "sketch"), "node")
    rest = cut_lineage(possible(cut_lineage(keyed.withColumnRenamed("node", "member"))))
    # Few pairs are left, and only what they name is shuffled.
    named = Sieve(rest.select(F.explode(F.array("a", "b")).alias("node")))
    return cut_lineage(found.union(verified(rest, items.where(named.may_hold(F.col("node"))), elements)))
