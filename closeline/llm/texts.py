"""Whole texts as arrays: slices of an Arrow column, words, lines and hashes of both.

Words are runs of bytes outside space and the control characters 9 to 13. Only A-Z are
folded. All work is by array over slices of a few MB, so a task's memory follows the
slice and its longest text, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20
BATCH_BYTES = "4m"  # of an Arrow batch on its way to a worker; Spark's own bound is 10,000 rows, whatever their texts

_BYTES = np.arange(256)
IS_SPACE = np.isin(_BYTES, (9, 10, 11, 12, 13, 32))
FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_FOLD = FOLD.tobytes()
_SPACES = IS_SPACE.astype(np.uint8).tobytes()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """The table under column names that meet no other (c0, c1, ...), then those of the named columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(n)] for n in named]


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over a table with texts, in batches of some MB unless the session has a bound of its own."""
    conf = frame.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return frame.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = np.array(x, np.uint64)
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    t = np.right_shift(x, np.uint64(27), out=t if t.ndim else None)
    x ^= t
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=t if t.ndim else None)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) | np.uint64(1)


_RATE = np.uint64(0x9E3779B97F4A7C15 | 5)
_UNRATE = np.uint64(pow(int(_RATE), -1, 1 << 64))
_BYTE_VALUES = constants(11, 256)
_PLACES = constants(12, 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int, inverse: bool) -> np.ndarray:
    if len(_powers[inverse]) < n:
        base = np.full(max(n, 2 * len(_powers[inverse])), _UNRATE if inverse else _RATE, np.uint64)
        base[0] = 1
        _powers[inverse] = np.cumprod(base)
    return _powers[inverse][:n]


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a column; row i is ``data[edges[i]:edges[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    edges: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, at, "right") - 1

    def per_row(self, at: np.ndarray) -> np.ndarray:
        """How many of the ascending byte positions lie in each row."""
        return np.diff(np.searchsorted(at, self.edges))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's rows in order, a null as an empty text; a longer text is a slice alone."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield Slice(first, last, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first])
        first = last
    give_back()


def give_back() -> None:
    """Freed memory to the system: workers stay for later tasks, and what they held would add to those of the next step."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def spans(s: Slice, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are no gap; runs stop at a row's edge."""
    if not len(s.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~gap[s.data]
    edge = np.zeros(len(s.data) + 1, bool)
    edge[s.edges] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line of each row; an empty text has one empty line."""
    breaks = np.flatnonzero(s.data == 10)
    starts = np.concatenate((s.edges[:-1], breaks + 1))
    ends = np.concatenate((breaks, s.edges[1:]))
    return np.sort(starts), np.sort(ends)


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values at their places, from which hashes are made."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = np.take(_BYTE_VALUES, data, mode="clip")  # a byte has no other values; unchecked it takes half the time
    values *= _power(len(data), False)
    np.cumsum(values, out=out[1:])
    return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, summed: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span, equal for equal bytes in any slice."""
    summed = sums(data) if summed is None else summed
    return mix((summed[ends] - summed[starts]) * _power(len(data) + 1, True)[starts])


def rolling(summed: np.ndarray, size: int) -> np.ndarray:
    """``hashes`` of the windows of ``size`` bytes that start at each place, as far as they are whole."""
    n = max(len(summed) - size, 0)
    out = summed[size:size + n] - summed[:n]
    out *= _power(len(summed), True)[:n]
    return mix(out)


def rolling32(summed: np.ndarray, size: int) -> np.ndarray:
    """As ``rolling``, of 32 bits only: several times as fast."""
    n = max(len(summed) - size, 0)
    low = summed.astype(np.uint32)
    out = low[size:size + n] - low[:n]
    out *= _power(len(summed), True)[:n].astype(np.uint32)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        out ^= out >> np.uint32(shift)
        if factor > 1:
            out *= np.uint32(factor)
    return out


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)


def spaces(data: np.ndarray) -> np.ndarray:
    """Whether each byte is white space."""
    return np.frombuffer(data.tobytes().translate(_SPACES), bool)


def together(marks: np.ndarray) -> np.ndarray:
    """An order with equal numbers side by side, first places first; marks are scrambled.

    Numbers are sorted with their places in the low bits, several times as fast as by argsort.
    """
    low = np.uint64((1 << max(len(marks) - 1, 1).bit_length()) - 1)
    packed = np.sort((marks & ~low) | np.arange(len(marks), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    ahead = marks[order]
    apart = ahead[1:] ^ ahead[:-1]
    if ((apart != 0) & (apart <= low)).any():  # different numbers, equal above the places
        return np.argsort(marks, kind="stable")
    return order


def shingles(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words, and windows per row; fewer words are one window."""
    n, base = counts, np.cumsum(counts) - counts
    per = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at, left = base[row] + place, n[row] - place
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    short = bool((n < size).any())
    for j in range(size):
        term = (padded[at + j] ^ _PLACES[j]) * _PLACES[j + 1]
        out += np.where(left > j, term, np.uint64(j + 1)) if short else term
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return mix(out), per


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, sorted by both."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]
