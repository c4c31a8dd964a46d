"""Hard negatives of anchors by coordinate pruning in buckets of like length.

Vectors are whole numbers (floor of 256 times a component). An anchor's positives are the
first ``POSITIVES`` other vectors of its label by inner product; for each of them come the
first ``NEGATIVES`` vectors of other labels whose score is 50 to 95 percent of the
positive's. Ties go to the smaller id.

Vectors stand in buckets by length, a constant factor from one to the next, and buckets in
blocks of bounded size. The stated anchors meet the blocks in cells of bounded size, by a
shuffle of both sides; a block whose longest vector can't reach an anchor's least score of
interest isn't sent to it. In a block every coordinate of the unit vectors has a sorted
list. The least score of interest bounds the cosine, and that each coordinate: the values
that can still reach it are a range of the list. The ranges of the coordinates where the
anchor is largest are intersected, and what is left is verified by its exact product. An
anchor first meets one block of the longest vectors, whose best scores are its bound for
all the others.

Scores are exact: products whose sums can pass 2^53 are taken as 64-bit integers. A row
with a null id, a null label, a null vector, a null or non-finite component, or a squared
length (after rounding) of 2^62 or more, whose scores would not fit, takes no part. A shorter
vector counts as padded with zeros, an empty one as zero. Rows that repeat an id, a label
and a vector count once; rows that share an id only are different rows, none of which is
"other" to an anchor of that id. With no positive there are no rows, nor for a table that is
empty. Columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from closeline.session import cut_lineage

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
STEP = 1.05  # length of a bucket's longest vector by its shortest
BLOCK, LEAST_BLOCK = 4096, 256  # vectors in a block
NUMBERS = 1 << 20  # numbers in a block
CHUNK = 1024  # anchors in a cell
FOCUS = 4
SLACK = 1e-9

_CELL = ("side", "bucket", "piece", "chunk")
_FOUND = "anchor_id long, mark long, place int, vec_id long, score long"


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(vec_id, label, vector, dims, length): vectors that take part, as 32-bit whole numbers."""
    label = F.col("`label`") if label is None else label
    frame = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    frame = frame.where("vec_id is not null and label is not null and x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            if not len(x):
                continue
            size = x.value_lengths().to_numpy()
            flat = x.flatten().to_numpy(zero_copy_only=False)  # nulls as nan
            edges = np.concatenate(([0], np.cumsum(size)))
            with np.errstate(all="ignore"):
                flat = np.floor(flat * SCALE)
                fine = np.isfinite(flat) & (np.abs(flat) < 2.0**31)
                squares = np.add.reduceat(np.append(np.where(fine, flat, 0.0) ** 2, 0.0), np.minimum(edges[:-1], len(flat))) * (size > 0)
            bad = np.concatenate(([0], np.cumsum(~fine)))
            keep = np.flatnonzero((bad[edges[1:]] == bad[edges[:-1]]) & (squares < 2.0**62 * (1 - SLACK)))
            raw = np.where(fine, flat, 0.0).astype("<i4")
            rows = [raw[edges[i]:edges[i + 1]].tobytes() for i in keep.tolist()]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows, pa.binary()), pa.array(size[keep].astype(np.int32)), pa.array(np.sqrt(squares[keep]))], ["vec_id", "label", "vector", "dims", "length"])

    return frame.mapInArrow(run, "vec_id long, label long, vector binary, dims int, length double")


def _dense(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    parts = [np.frombuffer(v, "<i4") for v in column.to_pylist()]
    out = np.zeros((len(parts), dims), np.int64)
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def _once(rows: pa.Table) -> pa.Table:
    """The rows without repetitions of id, label and vector."""
    ids = rows.column("vec_id").to_numpy()
    if len(np.unique(ids)) == len(ids):
        return rows
    seen: dict[tuple, int] = {}
    for i, key in enumerate(zip(ids.tolist(), rows.column("label").to_pylist(), rows.column("vector").to_pylist())):
        seen.setdefault(key, i)
    return rows.take(pa.array(list(seen.values())))


class Block:
    """Vectors of one block with a sorted list for each coordinate."""

    def __init__(self, rows: pa.Table, dims: int):
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.whole = _dense(rows.column("vector"), dims)
        self.numbers = self.whole.astype(np.float64)
        length = np.sqrt((self.numbers**2).sum(axis=1))
        self.longest = float(length.max(initial=0.0))
        unit = self.numbers / np.where(length > 0, length, 1.0)[:, None]
        self.lists = np.argsort(unit, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(unit.T, self.lists, axis=1)
        self.unit = unit

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Places that may reach the least score; None for all of them."""
        reach = length * self.longest
        if least <= 0 or not self.unit.shape[1]:
            return None
        if reach * (1 + SLACK) < least:
            return np.zeros(0, np.int64)
        angle = np.arccos(min(1.0, least / reach))
        unit = anchor / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        own = np.arccos(np.clip(unit[focus], -1.0, 1.0))
        low, high = np.cos(np.minimum(np.pi, own + angle)) - SLACK, np.cos(np.maximum(0.0, own - angle)) + SLACK
        begin = [int(np.searchsorted(self.values[f], v, "left")) for f, v in zip(focus, low)]
        end = [int(np.searchsorted(self.values[f], v, "right")) for f, v in zip(focus, high)]
        first = min(range(len(focus)), key=lambda i: end[i] - begin[i])
        found = self.lists[focus[first], begin[first]:end[first]]
        for i in range(len(focus)):
            if i != first:
                x = self.unit[found, focus[i]]
                found = found[(x >= low[i]) & (x <= high[i])]
        return np.sort(found)

    def scores(self, anchor: np.ndarray, length: float, at: np.ndarray | None) -> np.ndarray:
        exact = length * self.longest < 2.0**53
        table = self.numbers if exact else self.whole
        return ((table if at is None else table[at]) @ anchor.astype(table.dtype)).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first by score downwards, ids upwards."""
    if len(score) > 4 * n:
        near = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        return near[np.lexsort((ids[near], -score[near]))[:n]]
    return np.lexsort((ids, -score))[:n]


def _search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The first rows of one block for each anchor of a cell and each of its bands of scores."""
    out: list[list] = [[], [], [], [], []]
    if anchors.num_rows and rows.num_rows:
        dims = max(anchors.column("dims").to_numpy().max(), rows.column("dims").to_numpy().max())
        block = Block(_once(rows), int(dims))
        names = ("vec_id", "mark", "label", "same", "keep", "lows", "highs")
        vectors = _dense(anchors.column("vector"), int(dims))
        for x, anchor_id, mark, label, same, keep, lows, highs in zip(vectors, *(anchors.column(c).to_pylist() for c in names)):
            length = float(np.sqrt((x.astype(np.float64) ** 2).sum()))
            at = block.candidates(x, length, min(lows))
            score = block.scores(x, length, at)
            at = np.arange(len(score)) if at is None else at
            fit = (block.labels[at] == label) == same
            if same:
                fit &= block.ids[at] != anchor_id
            at, score = at[fit], score[fit]
            for place, (low, high) in enumerate(zip(lows, highs)):
                inside = np.flatnonzero((score >= low) & (score <= high))
                top = inside[_first(score[inside], block.ids[at[inside]], keep)]
                for column, values in zip(out, ([anchor_id] * len(top), [mark] * len(top), [place] * len(top), block.ids[at[top]].tolist(), score[top].tolist())):
                    column += values
    return pa.table({c.split()[0]: pa.array(v, pa.int32() if c.endswith("int") else pa.int64()) for c, v in zip(_FOUND.split(", "), out)})


def _cells(anchors: DataFrame, rows: DataFrame, blocks: DataFrame, seed: bool) -> DataFrame:
    """What each cell finds; ``side`` says which anchors and rows meet. A seed is one block of the longest vectors a side."""
    if seed:
        blocks = blocks.where("top")
    dealt = rows.join(blocks.select("side", "bucket", "pieces", "chunks"), ["side", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
    sent = anchors.join(blocks.select("side", "bucket", "longest", "pieces", "chunks"), "side").where(F.col("length") * F.col("longest") * (1 + SLACK) >= F.array_min("lows"))
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "mark"), F.col("chunks")).cast("int"))
    if seed:
        dealt, sent = dealt.where("piece = 0"), sent.withColumn("piece", F.lit(0))
    else:
        sent = sent.withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    dealt = dealt.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    # Both sides come from the same rows; new names tell their columns apart.
    dealt = dealt.select(*[F.col(c).alias(c) for c in (*_CELL, "vec_id", "label", "vector", "dims")])
    sent = sent.select(*[F.col(c).alias(c) for c in (*_CELL, "vec_id", "mark", "label", "same", "keep", "lows", "highs", "vector", "dims")])
    return sent.groupBy(*_CELL).cogroup(dealt.groupBy(*_CELL)).applyInArrow(_search, _FOUND)


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The first of all cells, with their rank from 1."""
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by anchor_id, mark, place order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= keep)


def _searched(anchors: DataFrame, rows: DataFrame, keep: int, block: int) -> DataFrame:
    """First ``keep`` rows for each anchor and band: a seed block raises the bounds, all blocks are searched within them."""
    buckets = rows.groupBy("side", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces"), F.max("length").alias("longest"))
    chunks = anchors.groupBy("side").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    top = buckets.groupBy("side").agg(F.max("bucket").alias("most"))
    blocks = cut_lineage(buckets.join(chunks, "side").join(top, "side").withColumn("top", F.col("bucket") == F.col("most")).drop("most"))
    seed = _best(_cells(anchors, rows, blocks, True), keep).where(F.col("rank") == keep)
    raised = seed.groupBy("anchor_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("raised"))
    bounded = anchors.join(raised.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "mark"], "left")
    lows = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.element_at("raised", i.cast("int")), low)))
    return _best(_cells(cut_lineage(bounded.withColumn("lows", lows).drop("raised")), rows, blocks, False), keep)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, block: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` holds."""
    step = float(np.log(STEP))
    rows = whole(vectors, id_col, vector_col, label).select(
        "*", F.xxhash64("label", "vector").alias("mark"), F.lit(0).cast("long").alias("everyone"), F.when(F.col("length") > 0, F.ceil(F.log("length") / step)).otherwise(-1).cast("int").alias("bucket"))
    rows = cut_lineage(rows)
    widest = rows.agg(F.max("dims")).first()[0] or 1
    block = block or int(min(BLOCK, max(LEAST_BLOCK, NUMBERS // max(widest, 1))))
    least, most = F.lit(-(1 << 62)).cast("long"), F.lit(1 << 62).cast("long")
    chosen = cut_lineage(rows.where(anchors).drop("bucket").dropDuplicates(["vec_id", "label", "vector"]))
    positives = _searched(
        chosen.select("*", F.col("label").alias("side"), F.lit(True).alias("same"), F.lit(POSITIVES).alias("keep"), F.array(least).alias("lows"), F.array(most).alias("highs")),
        rows.withColumn("side", F.col("label")), POSITIVES, block)
    positives = cut_lineage(positives.where("score >= 0").select("anchor_id", "mark", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    bands = positives.groupBy("anchor_id", "mark").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # POSITIVES at most
    # 50 p <= 100 n <= 95 p in whole numbers
    wanted = chosen.join(bands.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "mark"]).select(
        "*", F.col("everyone").alias("side"), F.lit(False).alias("same"), F.lit(NEGATIVES).alias("keep"),
        F.expr("transform(p, x -> (x.positive_score + 1) div 2)").alias("lows"), F.expr("transform(p, x -> x.positive_score - (x.positive_score + 19) div 20)").alias("highs")).drop("p")
    negatives = _searched(cut_lineage(wanted), rows.withColumn("side", F.col("everyone")), NEGATIVES, block)
    negatives = negatives.select("anchor_id", "mark", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negatives.join(positives, ["anchor_id", "mark", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_inner_product(a.x, b.x) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 3
"""
