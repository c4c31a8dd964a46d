"""Fuzzy line dedup: MinHash over character shingles, exact verification, union-find.

A line is folded (A-Z) and stripped of surrounding white space. Its set is the distinct
windows of ``CHARS`` bytes; a shorter line is one window. Signatures come from one
permutation whose range is cut into places; an empty place borrows from a place drawn by
its number until it finds a value. Bands of ``ROWS`` of the ``BANDS * ROWS`` places find
a pair of similarity 0.8 with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.99. Pairs
that share a band are verified by exact Jaccard similarity of at least 0.8; components of
verified lines, over the whole table, keep their first line by id and place.

Every line that isn't blank takes part, however short: one of up to ``CHARS`` bytes is one
window, so only equal lines are alike. Blank lines stay. The lines left of a text keep
their order and bytes. A null text stays null
and has no lines; an empty one has none either. Equal lines are one node, so ties and
repeated rows come to one line. Rows with equal id and text are one document, and all of
them keep its lines; rows that share an id only are documents of their own, in the order of
a hash of their texts. Rows of a null id are never changed and keep no line from others. An
empty table gives no rows. Columns besides id and text are carried, whatever their names;
those named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from closeline.llm import candidates, graph, texts
from closeline.session import cut_lineage, stored

CHARS = 10
BANDS = 12
ROWS = 5
LEAST = 1  # bytes of a stripped line that takes part: all but blank ones
SLICE_BYTES = 1 << 18  # arrays of 2 MB stay in the caches of a core
_PLACES = BANDS * ROWS
_DRAWS = 24
_NONE = np.uint32(0xFFFFFFFF)


def stripped(s: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in its text, start and stripped end of each line that isn't blank."""
    starts, ends = texts.lines(s)
    solid = np.flatnonzero(~texts.spaces(s.data))
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = last > first
    a, z = solid[first[some]], solid[last[some] - 1] + 1
    # By the place of the first byte: starts of empty lines are edges of several rows.
    row, breaks = s.row_of(a), np.flatnonzero(s.data == 10)
    return row, np.searchsorted(breaks, a) - np.searchsorted(breaks, s.edges[row]), a, z


def _starts(size: int, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window starts at each byte, and the windows of each line."""
    n = np.maximum(z - a - CHARS + 1, 1)
    edge = np.zeros(size + 1, np.int8)
    edge[a] = 1
    edge[a + n] -= 1  # two lines may meet here
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool), n


def drawn(a: np.ndarray, z: np.ndarray, summed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows``, of lines of CHARS bytes and more, by 32 bits: enough to draw a least one, not to tell sets."""
    starts, n = _starts(len(summed) - 1, a, z)
    whole = texts.rolling32(summed, CHARS)
    return whole[starts[:len(whole)]], np.repeat(np.arange(len(a)), n)


def windows(folded: np.ndarray, a: np.ndarray, z: np.ndarray, summed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of CHARS bytes of each line, and the line of each; lines ascend and stand apart."""
    summed = texts.sums(folded) if summed is None else summed
    starts, n = _starts(len(folded), a, z)
    whole = texts.rolling(summed, CHARS)
    if len(whole) < len(folded):  # what starts behind is shorter
        whole = np.concatenate((whole, np.zeros(len(folded) - len(whole), np.uint64)))
    out = whole[starts]
    short = np.flatnonzero(z - a < CHARS)
    out[(np.cumsum(n) - n)[short]] = texts.hashes(folded, a[short], z[short], summed)
    return out, np.repeat(np.arange(len(a)), n)


def places(hashes: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """MinHash values per line and place."""
    out = np.full(n * _PLACES, _NONE, np.uint32)
    place = hashes >> np.uint32(16)
    place *= np.uint32(_PLACES)
    place >>= np.uint32(16)
    np.minimum.at(out, line * _PLACES + place, hashes)
    out = out.reshape(n, _PLACES)
    filled = out.copy()
    draws = ((texts.constants(21, _DRAWS * _PLACES).reshape(_DRAWS, _PLACES) >> np.uint64(8)) % np.uint64(_PLACES)).astype(np.int64)
    r, p = np.nonzero(out == _NONE)
    for t in range(_DRAWS):
        if not len(r):
            return filled
        found = out[r, draws[t][p]]
        filled[r, p] = found
        left = found == _NONE
        r, p = r[left], p[left]
    filled[r, p] = out.min(axis=1)[r]
    return filled


@candidates.one_is_enough
def _keys(s: texts.Slice) -> tuple[np.ndarray, np.ndarray]:
    _, _, a, z = stripped(s)
    # A line below CHARS bytes is its own one window, which no other line has: it has no links.
    long = z - a >= CHARS
    a, z = a[long], z[long]
    folded = texts.folded(s.data)
    summed = texts.sums(folded)
    nodes = texts.hashes(folded, a, z, summed)
    at = np.sort(np.unique(nodes, return_index=True)[1])
    nodes = nodes[at]
    values = places(*drawn(a[at], z[at], summed), len(nodes)).reshape(len(nodes), BANDS, ROWS).astype(np.uint64)
    keys = values[:, :, 0] + np.arange(BANDS, dtype=np.uint64)
    for j in range(1, ROWS, 2):  # two by two
        pair = values[:, :, j] << np.uint64(32)
        keys = texts.mix(texts.mix(keys) ^ (pair | values[:, :, j + 1]) if j + 1 < ROWS else texts.mix(keys) ^ pair)
    return keys.ravel(), np.repeat(nodes, BANDS).view(np.int64)


def _items(s: texts.Slice):
    _, _, a, z = stripped(s)
    folded = texts.folded(s.data)

    def content(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        contents = [folded[x:y].tobytes() for x, y in zip(a[at].tolist(), z[at].tolist())]
        return *elements(contents), contents

    return texts.hashes(folded, a, z).view(np.int64), content


def _distinct(values: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of each line."""
    marked = values ^ texts.mix(np.arange(1, (int(line[-1]) if len(line) else 0) + 2))[line]
    order = texts.together(marked)
    marked = marked[order]
    new = np.ones(len(order), bool)
    new[1:] = marked[1:] != marked[:-1]
    order = order[new]
    return values[order], line[order]


def elements(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of folded lines and the line of each."""
    ends = np.cumsum([len(c) for c in contents])
    return _distinct(*windows(np.frombuffer(b"".join(contents), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, line, node) of every line that takes part; ``mark`` is a hash of the whole text."""
    text = F.col(f"`{text_col}`").cast("string")
    frame = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in texts.slices(batch.column(1), SLICE_BYTES):
                row, number, a, z = stripped(s)
                nodes = texts.hashes(texts.folded(s.data), a, z).view(np.int64)
                of = pa.array(row + s.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(number.astype(np.int32)), pa.array(nodes)], ["id", "mark", "line", "node"])

    return texts.mapped(frame, run, f"id {frame.schema['id'].dataType.simpleString()}, mark long, line int, node long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, lines): numbers of the lines that a component of the whole table has earlier."""
    column = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    entries = cut_lineage(candidates.shared(column, _keys, SLICE_BYTES))
    items = cut_lineage(candidates.items_of(column, entries.select("node").distinct(), _items, SLICE_BYTES))
    least = graph.components(candidates.links(entries, items, elements, needs=False))
    lines = occurrences(docs, id_col, text_col).join(least, "node", "left").select("id", "mark", "line", F.coalesce("least", "node").alias("component"))
    lines = stored(lines)
    first = lines.groupBy("component").agg(F.min(F.struct("id", "mark", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "first")
    later = lines.join(first, "component").where("struct(id, mark, line) <> first")
    return later.groupBy("id", "mark").agg(F.collect_set("line").alias("lines"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that come earlier in the table, with n_lines and n_removed."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs, (ident, text, *columns) = texts.plain(docs, id_col, text_col, *names)
    again = cut_lineage(repeats(docs, ident, text).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "lines"))
    sieve = candidates.Sieve(again.select(F.xxhash64("_id", "_mark").alias("node")))
    docs = docs.select(*columns).withColumn("mark", F.xxhash64(F.col(text).cast("string")))
    hit = sieve.may_hold(F.xxhash64(ident, "mark")) & F.col(ident).isNotNull()
    # Only documents that may lose lines are shuffled.
    split = docs.where(hit).join(again, (F.col(ident) == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").drop("_id", "_mark").union(docs.where(~hit).withColumn("lines", F.lit(None).cast("array<int>")))
    split = split.withColumn("_all", F.split(F.col(text), "\n"))
    kept = F.expr("filter(_all, (x, i) -> not array_contains(lines, i))")
    return split.select(
        *[F.when(F.col("lines").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")) if c == text else F.col(c) for c in columns],
        F.when(F.length(text) > 0, F.size("_all")).otherwise(0).cast("long"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")).toDF(*names, "n_lines", "n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their first lines only; one that loses all its lines goes; columns stay.

    Where a document has ``n_chars`` and loses lines, it is counted anew.
    """
    done = dedup(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
