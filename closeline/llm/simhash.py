"""Near-duplicate texts by SimHash, compared bit plane by bit plane.

A text's fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its
4-word shingles, repeats included, have it set. Texts link if their fingerprints differ
in at most ``radius`` bits; the result is the connected components of all links.

Equal fingerprints are one node. Nodes within the radius agree on at least ``agree`` of
``radius + agree`` blocks of bits, so they meet in a list of nodes that have these blocks
in common. ``agree`` follows the counted number of nodes: it is the least for which lists
hold ``LIST`` nodes on average, so that lists stay short at any size, and no link is lost.
A list that is long all the same is compared in tiles.

In a task, nodes stand in 64-lane words with a bit plane for each of the 64 bits. A
node is compared with all lanes of a word at once: eight planes are added at a time into
vertical counters by carry-save adders, and a word is abandoned when all of its lanes are
over the radius. A task joins what it finds at once: words whose lanes are known to be of
the node's component are left out, and only one link to its component is written for each
node, not the pairs.

A null text, or one without words, has fingerprint zero and links like any other. With
fewer words than a shingle has, the whole sequence is the one shingle. Repeated rows and
ids each get a row. A null id belongs to its component but can't be its least id unless
all are null. Very long texts are hashed in pieces. An empty table gives no rows. Further
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from closeline.llm import graph, texts, tiles
from closeline.session import cut_lineage

WORDS = 4
RADIUS = 4
SEED = 42
LIST = 256  # nodes that a list holds on average at most
PIECE = 4096  # nodes of a list compared within one tile
BUFFER = 1 << 15
CHUNK = 1 << 17  # shingles hashed together
LANES = 1 << 15  # (node, word) pairs compared together

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _joined(s: texts.Slice) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The folded words of all rows, one space after each; start and end of each; words per row."""
    starts, ends = texts.spans(s, texts.IS_SPACE)
    sizes = ends - starts
    first = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    word = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(word)) + word] = texts.FOLD[s.data[~texts.IS_SPACE[s.data]]]
    return out.tobytes(), first, first + sizes, s.per_row(starts)


def fingerprints(s: texts.Slice, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each row."""
    data, starts, ends, n = _joined(s)
    base = np.cumsum(n) - n
    per = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    edges = np.concatenate(([0], np.cumsum(per)))
    votes = np.zeros((s.rows, 64), np.int64)
    for at in range(0, int(edges[-1]), CHUNK):
        window = np.arange(at, min(at + CHUNK, int(edges[-1])))
        row = np.searchsorted(edges, window, "right") - 1
        first = base[row] + window - edges[row]
        last = np.minimum(first + words, base[row] + n[row]) - 1
        found = np.fromiter((xxhash.xxh64_intdigest(data[a:z], SEED) for a, z in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(window))
        rows, begin = np.unique(row, return_index=True)
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[rows] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > per[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _planes(prints: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all prints, 64 to a word."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, -len(prints) % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits in each lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counter: tuple[np.ndarray, ...], radius: int) -> np.ndarray:
    """Lanes whose counter (ones, twos, fours) is over the radius."""
    over, same = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    for bit in (2, 1, 0):
        if radius >> bit & 1:
            same &= counter[bit]
        else:
            over |= same & counter[bit]
            same &= ~counter[bit]
    return over


def within(planes: np.ndarray, prints: np.ndarray, node: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of (node, word) with a lane within the radius of the node, and those lanes."""
    place = np.arange(len(node))
    ones, twos, fours, far = (np.zeros(len(node), np.uint64) for _ in range(4))
    for plane in range(0, 64, 8):
        x = [planes[b][word] ^ (np.uint64(0) - (prints[node] >> np.uint64(b) & np.uint64(1))) for b in range(plane, plane + 8)]
        ones, a = _add(ones, x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, c = _add(twos, a, b)
        ones, a = _add(ones, x[4], x[5])
        ones, b = _add(ones, x[6], x[7])
        twos, d = _add(twos, a, b)
        fours, eights = _add(fours, c, d)
        far |= eights
        open_ = (far | _beyond((ones, twos, fours), radius)) != _ALL
        if not open_.all():
            place, node, word, ones, twos, fours, far = (v[open_] for v in (place, node, word, ones, twos, fours, far))
    return place, ~(far | _beyond((ones, twos, fours), radius))


def joined(prints: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each print the least place it reaches by links between prints i and begin[i] to end[i]."""
    label = np.arange(len(prints))
    planes = _planes(prints)
    words = planes.shape[1]
    begin = np.minimum(begin, end)
    first = begin >> 6
    per = np.where(begin < end, ((end - 1) >> 6) - first + 1, 0)
    edges = np.concatenate(([0], np.cumsum(per)))
    lanes = np.arange(64, dtype=np.int64)
    for at in range(0, int(edges[-1]), LANES):
        pair = np.arange(at, min(at + LANES, int(edges[-1])))
        node = np.searchsorted(edges, pair, "right") - 1
        word = first[node] + pair - edges[node]
        padded = np.append(label, np.full(words * 64 - len(label), label[-1])).reshape(words, 64)
        low, high = padded.min(axis=1), padded.max(axis=1)
        new = (low[word] != label[node]) | (high[word] != label[node])
        node, word = node[new], word[new]
        place, hit = within(planes, prints, node, word, radius)
        node, word = node[place], word[place]
        lane = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        other = word[:, None] * 64 + lanes
        which, where = np.nonzero(lane & (other >= begin[node][:, None]) & (other < end[node][:, None]))
        a, b = label[node[which]], label[other[which, where]]
        if (a != b).any():
            ids, least = graph._least(a, b)
            mapped = np.arange(len(label))
            mapped[ids] = least
            label = mapped[label]
    return label


def agreeing(nodes: int, radius: int = RADIUS) -> int:
    """How many of ``radius + agree`` blocks a list's nodes have in common."""
    agree = 1
    while agree < 4 and nodes / 2 ** (64 * agree // (radius + agree)) > LIST:
        agree += 1
    return agree


def _keys(node: Column, radius: int, agree: int) -> Column:
    """One key for each choice of agreeing blocks."""
    blocks = radius + agree
    masks = [(1 << 64 * (i + 1) // blocks) - (1 << 64 * i // blocks) for i in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(sum(1 << i for i in chosen)), node.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*out)


def links(nodes: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between different nodes whose components are those of all links within the radius (at most 7)."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold a radius of 0 to 7")
    agree = agreeing(nodes.count(), radius)
    keyed = nodes.select(F.explode(_keys(F.col("node"), radius, agree)).alias("key"), F.col("node").alias("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tiles.buffers(batches, BUFFER):
            begin, end, _ = tiles.partners(rows)
            node = rows.column("member").to_numpy()
            label = joined(node.view(np.uint64), begin, end, radius)
            inner = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(node[inner]), pa.array(node[label[inner]])], ["a", "b"])

    return tiles.tiled(keyed, piece).select(*tiles.TILE, "member").mapInArrow(run, "a long, b long").where("a <> b")


def prints_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, node): each row's fingerprint as a signed number."""
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in texts.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(fingerprints(s, words).view(np.int64))], ["doc_id", "node"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, node long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(doc_id, fingerprint, component_id): least id reachable by links, per row."""
    rows = cut_lineage(prints_of(docs, id_col, text_col, words))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min("doc_id").alias("first")))
    least = graph.components(links(nodes.select("node"), radius, piece))
    known = nodes.join(least, "node", "left").withColumn("component", F.coalesce("least", "node")).drop("least")
    ids = known.groupBy("component").agg(F.min("first").alias("component_id"))
    named = known.join(ids, "component").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
