"""Histogram sort: exact counts below candidate boundaries, refined, then one exchange.

Documents are ordered by (hash of the text, id), so equal texts stand together. Shards
are cut so that their bytes (text in UTF-8 plus one) are near equal. Each round sends a
sorted list of candidate keys to all partitions, which count rows and bytes between
neighbours exactly; the sums say how many bytes lie below each candidate. A boundary that
isn't within its tolerance gets new candidates inside the keys that were seen around its
target, until it is, or one key is left. A cut goes to an edge between texts if one is
near enough; a group of equal texts too heavy for that, be it a third of all rows, is cut
between ids.

The driver sees sums per candidate, whose number follows the number of pieces, not the
rows. Besides shards, finer boundaries cut even pieces, which are dealt out in the one
exchange; a row's slot is the exact number of rows before its piece plus its place in it.

A null text has size 1, as an empty one, and stands with empty texts. A null id comes
first. Ids that aren't whole numbers are ordered by their hash. Repeated rows (equal text and
id) have equal keys: they share a shard and have neighbouring slots in any order. An empty
table gives no rows. Extra columns are carried, whatever their names; one named as an
output column, in any case of letters, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from closeline import session
from closeline.llm import texts

SHARD_TOLERANCE = 0.001  # of a shard's bytes
TEXT_TOLERANCE = 0.01  # a cut this near may go to an edge between texts
PIECE_TOLERANCE = 0.25  # of a piece's bytes
PIECES_PER_PARTITION = 4
FIRST_PROBES = 8  # for each piece
PROBES = 32  # for each open boundary of a later round
OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_SIGN = 1 << 63
_END = 1 << 128


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes whose order is that of (high, low)."""
    pair = np.stack([high.astype(np.int64), low.astype(np.int64)], axis=1).view(np.uint64) ^ np.uint64(_SIGN)
    return np.ascontiguousarray(pair.astype(">u8")).view("S16").ravel()


def _probes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def _between(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """Per interval of the probes: rows, bytes, least and greatest key."""
    candidates = _probes(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(candidates) + 1, np.int64)
        size = np.zeros(len(candidates) + 1, np.int64)
        least: dict[int, bytes] = {}
        most: dict[int, bytes] = {}
        for batch in batches:
            high, low, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            key = np.sort(packed := _packed(high, low))
            at = np.searchsorted(candidates, packed, "right")
            n += np.bincount(at, minlength=len(n))
            np.add.at(size, at, b)
            edges = np.searchsorted(key, candidates, "left")
            first, last = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
            for i in np.flatnonzero(last > first).tolist():
                a, z = (bytes(key[j]).ljust(16, b"\0") for j in (first[i], last[i] - 1))
                least[i], most[i] = min(least.get(i, a), a), max(most.get(i, z), z)
        hit = sorted(least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit, pa.int64()), pa.array(n[hit]), pa.array(size[hit]), pa.array([least[i] for i in hit], pa.binary()), pa.array([most[i] for i in hit], pa.binary())],
            ["i", "n", "b", "least", "most"])

    parts = keys.mapInArrow(count, "i long, n long, b long, least binary, most binary")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("least").alias("least"), F.max("most").alias("most"))
    out = [(0, 0, 0, 0)] * (len(probes) + 1)
    for r in sums.collect():  # one row for each interval at most
        out[r["i"]] = (r["n"], r["b"], int.from_bytes(r["least"], "big"), int.from_bytes(r["most"], "big"))
    return out


def _spread(low: int, high: int, n: int) -> list[int]:
    """Up to n candidates above low and up to high, evenly spaced."""
    gap = high - low
    return sorted({low + max(1, gap * j // n) for j in range(1, n + 1)}) if gap > n else list(range(low + 1, high + 1))


def boundaries(keys: DataFrame, shards: int, pieces: int) -> list[tuple[int, int]]:
    """Start key of each piece and the exact number of rows below it; piece k is of shard k * shards // pieces."""
    per = pieces // shards
    probes = [_END * j // (pieces * FIRST_PROBES) for j in range(1, pieces * FIRST_PROBES)]
    best: dict[int, tuple[int, int, int]] = {}
    open_ = set(range(1, pieces))
    while open_:
        intervals = _between(keys, probes)
        total = sum(b for _, b, _, _ in intervals)
        rows = np.cumsum([0, *(n for n, _, _, _ in intervals)])
        below = np.cumsum([0, *(b for _, b, _, _ in intervals)])
        starts = [0, *probes, _END]
        again: list[int] = []
        for k in sorted(open_):
            target, cut = total * k / pieces, k % per == 0
            width = total / (shards if cut else pieces)
            i = min(int(np.searchsorted(below, target, "right")) - 1, len(intervals) - 1)
            _, _, least, most = intervals[i]
            edges = [(i, starts[i]), (i + 1, starts[i + 1])]
            best[k] = min([*([best[k]] if k in best else []), *((abs(int(below[j]) - target), key, int(rows[j])) for j, key in edges)])
            one_text = least >> 64 == most >> 64
            enough = width * (PIECE_TOLERANCE if not cut else TEXT_TOLERANCE if one_text else SHARD_TOLERANCE)
            if best[k][0] <= enough or least >= most:
                open_.discard(k)
            else:
                again += [least, *_spread(least, most, PROBES), most + 1]
        probes = sorted({p for p in again if 0 < p < _END})
    cuts = {k: best[k][1:] for k in best}
    out = [(0, 0)]
    for k in range(1, pieces):
        ahead = -(-k // per) * per  # pieces keep to their shard
        bound = cuts[ahead] if ahead < pieces else (_END, 1 << 62)
        out.append(max(out[-1], min(cuts[k], bound)))
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with size, text_crc32, law ``bytes``, shard, slot (gapless from 0 in a shard) and a null grown_shard."""
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    names = [c for c in docs.columns if c.lower() not in OUTPUT]
    docs, (ident, body, *carried) = texts.plain(docs, id_col, text_col, *names)
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    low = F.col(ident).cast("long") if whole else F.when(F.col(ident).isNotNull(), F.xxhash64(ident))
    rows = docs.select(
        *carried, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_high"), F.coalesce(low, F.lit(-_SIGN).cast("long")).alias("_low"))
    keys = session.cut_lineage(rows.select("_high", "_low", "size"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = shards * max(1, -(-PIECES_PER_PARTITION * partitions // shards))
    cuts = boundaries(keys, shards, pieces)
    per = pieces // shards
    inner = _probes([min(c, _END - 1) for c, _ in cuts[1:]])
    unreached = sum(c == _END for c, _ in cuts[1:])

    @F.pandas_udf("int")
    def piece(high: pd.Series, low: pd.Series) -> pd.Series:
        at = np.searchsorted(inner, _packed(high.to_numpy(), low.to_numpy()), "right")
        return pd.Series(np.minimum(at, len(inner) - unreached).astype(np.int32))

    before = [cuts[k][1] - cuts[k // per * per][1] for k in range(pieces)]
    dealt = rows.withColumn("_piece", piece("_high", "_low"))
    place = F.expr("row_number() over (partition by _piece order by _high, _low)")
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_piece") + 1)
    return (dealt.withColumn("slot", (start + place - 1).cast("long"))
            .withColumn("law", F.lit("bytes"))
            .withColumn("shard", F.floor(F.col("_piece") / per).cast("int"))
            .withColumn("grown_shard", F.lit(None).cast("int"))
            .select(*carried, *OUTPUT).toDF(*names, *OUTPUT))
