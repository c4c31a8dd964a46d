"""Ordered scans over groups of any size.

A window partitioned by a key puts the whole key into one task. When one key may hold
a third of all rows that task is the job. The scans here cut every group along its
order into segments (a day, then a range of ids), scan inside the segments, and add
what came before, taken from per-segment totals. Rows are shuffled once, by key and
segment; only the totals, one row per segment, are ever ordered per key. A segment must
hold many rows: a month, or a range of ids that is dense.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from closeline import session


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join on keys that may be null; the keys appear once in the result."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def running_before(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    segment: Sequence[Column],
) -> DataFrame:
    """Add, per row, the sum of each expression over all earlier rows of its key.

    ``order`` must be unique within the key. ``segment`` is a list of expressions that
    rise with the order (coarse first), such as the day and a range of the id.
    """
    levels = [f"__seg{i}" for i in range(len(segment))]
    work = frame.select("*", *[e.alias(n) for e, n in zip(segment, levels)],
                        *[F.coalesce(e, F.lit(0)).alias(f"__v_{n}") for n, e in sums.items()])
    inside = W.partitionBy(*keys, *levels).orderBy(*order)
    past, all_ = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scanned = work.select("*", F.row_number().over(inside).alias("__rn"),
                          *[F.coalesce(F.sum(f"__v_{n}").over(past), F.lit(0)).alias(f"__i_{n}") for n in sums],
                          *[F.sum(f"__v_{n}").over(all_).alias(f"__t_{n}") for n in sums])
    # One row per segment has its totals; what the key held before is a window over these.
    earlier = W.partitionBy(*keys).orderBy(*levels).rowsBetween(W.unboundedPreceding, -1)
    offsets = scanned.filter("__rn = 1").select(*keys, *levels, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums])
    joined = _null_safe(scanned, offsets, [*keys, *levels], "inner")
    return joined.select(*[F.col(c) for c in frame.columns if c not in sums],
                         *[(F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def previous_row(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    segment: Column,
) -> DataFrame:
    """Add, per row, the given values of the row just before it in its key (lag 1).

    Inside a segment this is ``lag``; the first row of a segment takes the last row of
    the segment before, found with ``max_by`` and one row per segment.
    """
    work = frame.select("*", segment.alias("__seg"), F.struct(*[e.alias(n) for n, e in values.items()]).alias("__cur"))
    last = work.groupBy(*keys, "__seg").agg(F.max_by("__cur", F.struct(*order)).alias("__last"))
    carried = last.select(*keys, "__seg", F.lag("__last").over(W.partitionBy(*keys).orderBy("__seg")).alias("__carry"))
    inside = W.partitionBy(*keys, "__seg").orderBy(*order)
    scanned = work.select("*", F.lag("__cur").over(inside).alias("__lag"), F.row_number().over(inside).alias("__rn"))
    joined = _null_safe(scanned, carried, [*keys, "__seg"], "inner")
    prev = F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    return joined.select(*frame.columns, *[prev[n].alias(n) for n in values])


def next_row(frame: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], segment: Column) -> DataFrame:
    """Values of the row just after each row in its key (lead 1), by segments."""
    work = frame.select("*", segment.alias("__seg"), F.struct(*[e.alias(n) for n, e in values.items()]).alias("__cur"))
    first = work.groupBy(*keys, "__seg").agg(F.min_by("__cur", F.struct(*order)).alias("__first"))
    carried = first.select(*keys, "__seg", F.lead("__first").over(W.partitionBy(*keys).orderBy("__seg")).alias("__carry"))
    inside = W.partitionBy(*keys, "__seg").orderBy(*order)
    scanned = work.select("*", F.lead("__cur").over(inside).alias("__lead"),
                          F.row_number().over(W.partitionBy(*keys, "__seg").orderBy(*[F.col(o).desc() for o in order])).alias("__rn"))
    joined = _null_safe(scanned, carried, [*keys, "__seg"], "inner")
    following = F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lead"))
    return joined.select(*frame.columns, *[following[n].alias(n) for n in values])


def last_known(frame: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, value: Column, segment: Sequence[Column]) -> DataFrame:
    """Add, per row, the last value that isn't null at or before it in its key.

    A segment hands on its last known value; a segment without one hands on what it got.
    Rows that are equal in ``order`` must not hold different values.
    """
    levels = [f"__seg{i}" for i in range(len(segment))]
    work = frame.select("*", *[e.alias(n) for e, n in zip(segment, levels)], value.alias("__cur"))
    known = work.filter(F.col("__cur").isNotNull()).groupBy(*keys, *levels).agg(F.max_by("__cur", F.struct(*order)).alias("__last"))
    # One row per segment of any row; those without a known value pass on the one before.
    all_ = _null_safe(work.select(*keys, *levels).distinct(), known, [*keys, *levels], "left")
    before = W.partitionBy(*keys).orderBy(*levels).rowsBetween(W.unboundedPreceding, -1)
    carried = all_.select(*keys, *levels, F.last("__last", True).over(before).alias("__carry"))
    inside = W.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    scanned = work.withColumn("__own", F.last("__cur", True).over(inside))
    joined = _null_safe(scanned, carried, [*keys, *levels], "inner")
    return joined.select(*frame.columns, F.coalesce("__own", "__carry").alias(name))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], segment: Sequence[Column], strict: bool = False, right_at: str | None = None) -> DataFrame:
    """Left rows with the values of the newest right row of their key at or before them (before them, if ``strict``).

    Both sides are scanned as one sequence per key, in segments: no range join, and no
    window over a key. ``segment`` are expressions over ``at`` that rise with it. Of right
    rows of one key and time the one with the greatest values counts. Null keys meet null
    keys; a null time meets nothing. ``right_at`` keeps the time of the row that was found.
    """
    fields = F.struct(*[F.col(v) for v in values], F.col(at).alias(right_at or "__at"))
    newest = right.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(fields).alias("__value"))
    seen, asked = (1, 0) if strict else (0, 1)
    rows = newest.select(*keys, at, F.lit(seen).alias("__turn"), "__value").unionByName(
        left.select(*keys, at, F.lit(asked).alias("__turn"), F.struct(*left.columns).alias("__row")), allowMissingColumns=True)
    scanned = last_known(rows, keys, [at, "__turn"], "__found", F.when(F.col(at).isNotNull(), F.col("__value")), segment).filter(F.col("__row").isNotNull())
    found = F.when(F.col(at).isNotNull(), F.col("__found"))
    return scanned.select("__row.*", *[found[v].alias(v) for v in [*values, *([right_at] if right_at else [])]])


def ranked(frame: DataFrame, keys: Sequence[str], value: str, descending: bool = False, cuts: int = 64) -> DataFrame:
    """Add ``rank`` (ties share the least) of each value that isn't null within its key, and ``field``, their number.

    Equal values are counted map-side. Approximate quantiles propose ranges, exact counts
    of ranges give each its offset, and ranks are counted on inside a range: tasks follow
    the values, not the keys.
    """
    v = (-F.col(value) if descending else F.col(value)).alias("__v")
    counts = session.cut_lineage(frame.filter(F.col(value).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("__n")))
    proposed = counts.groupBy(*keys).agg(F.percentile_approx("__v", [i / cuts for i in range(1, cuts)], 2048).alias("__cuts"), F.sum("__n").alias("field"))
    placed = _null_safe(counts, proposed, keys, "inner").withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts")
    before = running_before(placed, keys, ["__v"], {"__before": F.col("__n")}, [F.col("__range")])
    ranks = before.select(*keys, F.col("__v").alias("__rank_of"), (F.col("__before") + 1).alias("rank"))
    rows = _null_safe(frame.withColumn("__rank_of", v), ranks, [*keys, "__rank_of"], "left").drop("__rank_of")
    return _null_safe(rows, proposed.select(*keys, "field"), keys, "left").withColumn("field", F.coalesce("field", F.lit(0)))


def exact_quantiles(frame: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "q", levels: int = 2, cuts: int = 64) -> DataFrame:
    """Exact interpolated quantiles per group, for continuous values and groups of any size.

    Equal values are counted map-side. Approximate quantiles only propose cut points;
    exact counts per piece then tell which pieces hold the wanted positions, and only
    their values go on to the next level. With two levels of 64 the ordered window at
    the end sees about 1/4096 of a group. A poor cut costs time, never correctness.
    """
    keys = list(keys)
    # The counts are read several times: they are written once to the checkpoint folder.
    rows = session.cut_lineage(frame.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")))
    total = rows.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    spots = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("__all") - 1) * F.lit(s)), F.ceil((F.col("__all") - 1) * F.lit(s))) for s in shares])))
    state = total.select(*keys, F.lit(0).cast("long").alias("__base"), spots.alias("__need"))
    group = list(keys)
    meet = lambda a, b, on: _null_safe(a, b, on, "inner") if on else a.crossJoin(F.broadcast(b))
    for level in range(levels):
        proposed = rows.groupBy(*group).agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 2048).alias("__cuts"))
        piece = f"__piece{level}"
        placed = meet(rows, proposed, group).withColumn(piece, F.size(F.filter("__cuts", lambda c: c <= F.col(value)))).drop("__cuts")
        sizes = meet(placed.groupBy(*group, piece).agg(F.sum("__n").alias("__size")), state, group)
        before = W.partitionBy(*(group or [F.lit(0)])).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn("__base", F.col("__base") + F.coalesce(F.sum("__size").over(before), F.lit(0)))
        hit = sizes.withColumn("__need", F.filter("__need", lambda p: (p >= F.col("__base")) & (p < F.col("__base") + F.col("__size"))))
        group = [*group, piece]
        state = hit.filter(F.size("__need") > 0).select(*group, "__base", "__need")
        state = session.cut_lineage(state)
        rows = session.cut_lineage(_null_safe(placed, state.select(*group), group, "left_semi"))
    inside = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    low = F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    located = _null_safe(rows, state, group, "inner").withColumn("__lo", low)
    found = located.select(*keys, value, F.explode(F.filter("__need", lambda p: (p >= F.col("__lo")) & (p < F.col("__lo") + F.col("__n")))).alias("__pos"))
    found = meet(found, total, keys)
    at = lambda p: F.max(F.when(F.col("__pos") == p, F.col(value)))
    out = []
    for i, s in enumerate(shares):
        spot = (F.col("__all") - 1) * F.lit(s)
        lower, upper = at(F.floor(spot)), at(F.ceil(spot))
        out.append((lower + (upper - lower) * F.max(spot - F.floor(spot))).alias(name if len(shares) == 1 else f"{name}{i}"))
    return found.groupBy(*keys).agg(*out)
