"""Cluster-robust intervals of ratios, many cells at once, in two shuffles.

Rows are first summed per cell and cluster (map-side combine, so a hot cluster is one
partial row per task). The residual variance of the ratio then follows from centred
second moments of the cluster sums, which are themselves partial aggregates: no join
back to the totals and no window over a cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

Z95 = 1.959963984540054
MINIMUM_BETS = 200
_NOISE = 64 * 2.220446049250313e-16


def adjusted_z(looks: int) -> float:
    """Normal quantile widened for the number of looks."""
    return Z95 if looks <= 1 else NormalDist().inv_cdf(1.0 - 0.025 / looks)


def per_cluster(
    frame: DataFrame,
    cells: Sequence[Sequence[str]],
    clusters: dict[str, str],
    value: Column | str = "profit_units",
    weight: Column | None = None,
) -> DataFrame:
    """Sums per cell and cluster, for every listed cell grouping and every cluster unit.

    ``cells`` is a list of column lists, like grouping sets; ``clusters`` maps a unit
    (game, day, athlete) to its column. Output: the cell columns, ``grouping`` (index
    into ``cells``), ``unit``, ``cluster``, ``profit``, ``bets``.
    """
    value = F.col(value) if isinstance(value, str) else value
    names = list(dict.fromkeys(c for cell in cells for c in cell))
    base = (
        frame.filter(value.isNotNull())
        .groupBy(*names, *[F.col(c).alias(f"__by_{u}") for u, c in clusters.items()])
        .agg(F.sum(value).alias("__p"), F.sum(weight if weight is not None else F.lit(1)).alias("__b"))
    )
    ways = F.array(*[
        F.struct(
            F.lit(g).alias("grouping"), F.lit(u).alias("unit"), F.col(f"__by_{u}").cast("string").alias("cluster"),
            *[(F.col(n) if n in cell else F.lit(None)).cast(frame.schema[n].dataType).alias(n) for n in names],
        )
        for g, cell in enumerate(cells) for u in clusters
    ])
    return (
        base.select(F.explode(ways).alias("w"), "__p", "__b").select("w.*", "__p", "__b")
        .groupBy(*names, "grouping", "unit", "cluster")
        .agg(F.sum("__p").alias("profit"), F.sum("__b").alias("bets"))
    )


def from_clusters(clusters: DataFrame, by: Sequence[str], looks: int = 1) -> DataFrame:
    """Interval per group of cluster sums (``profit``, ``bets``)."""
    p, n = F.col("profit").cast("double"), F.col("bets").cast("double")
    ratio = F.try_divide(p, n)
    moments = clusters.groupBy(*by).agg(
        F.sum(p).alias("__p"), F.sum("bets").alias("bets"), F.count("*").alias("clusters"),
        F.var_pop(p).alias("__vp"), F.var_pop(n).alias("__vn"), F.covar_pop(p, n).alias("__cpn"),
        F.min(ratio).alias("__rmin"), F.max(ratio).alias("__rmax"), F.max(F.abs(ratio)).alias("__rabs"),
    )
    g = F.col("clusters").cast("double")
    roi = F.coalesce(F.try_divide(F.col("__p"), F.col("bets")), F.lit(0.0))
    flat = (F.col("__rmax") - F.col("__rmin")) <= _NOISE * 2.0 * F.greatest(F.col("__rabs"), F.lit(1e-300))
    unidentified = (F.col("clusters") < 2) | flat
    squares = g * F.greatest(F.lit(0.0), F.col("__vp") - 2.0 * roi * F.col("__cpn") + roi * roi * F.col("__vn"))
    error = F.when(unidentified, 0.0).otherwise(
        F.sqrt(F.try_divide(squares, g * (g - 1.0))) / (F.col("bets") / g))
    out = moments.select(*by, roi.alias("roi"), "bets", "clusters", error.alias("standard_error"), unidentified.alias("__u"))
    return bounds(out, looks).drop("__u")


def bounds(frame: DataFrame, looks: int = 1) -> DataFrame:
    """Bounds, adjusted bounds and verdict from roi, standard_error and bets."""
    roi, se = F.col("roi"), F.col("standard_error")
    unknown = F.col("__u") if "__u" in frame.columns else (se == 0)
    inf = F.lit(float("inf"))
    half = F.when(unknown, inf).otherwise(Z95 * se)
    wide = F.when(unknown, inf).otherwise(adjusted_z(looks) * se)
    out = frame.select(
        "*", (roi - half).alias("low"), (roi + half).alias("high"),
        (roi - wide).alias("adjusted_low"), (roi + wide).alias("adjusted_high"))
    return out.withColumn("verdict", verdict())


def verdict(minimum: int = MINIMUM_BETS) -> Column:
    low, high = F.col("adjusted_low"), F.col("adjusted_high")
    return (
        F.when(F.col("bets") < minimum, "not enough evidence")
        .when((high <= low) | ((low <= 0) & (high >= 0)), "no demonstrated edge")
        .when(low > 0, "demonstrated edge")
        .otherwise("demonstrated deficit")
    )


def record(intervals: DataFrame, looks: int = 1, power: float = 0.8, minimum: int = MINIMUM_BETS) -> DataFrame:
    """What each interval could have shown, beside what it shows.

    ``detectable_effect``: the least estimate whose adjusted interval leaves out zero (null
    without a standard error: such a cell can detect nothing). ``powered_effect``: the least
    true effect that would do so with the given power. ``enough_evidence``,
    ``survives_correction`` (the adjusted bounds are an interval, on one side of zero) and
    ``inside_bounds`` (the return lies between the bounds printed beside it).
    """
    se, low, high = F.col("standard_error"), F.col("adjusted_low"), F.col("adjusted_high")
    measured = F.when(se > 0, se)
    enough = F.col("bets") >= minimum
    survives = enough & F.coalesce(~F.isnan(low) & ~F.isnan(high) & (high > low) & ((low > 0) | (high < 0)), F.lit(False))
    return intervals.select(
        "*", (adjusted_z(looks) * measured).alias("detectable_effect"), ((adjusted_z(looks) + NormalDist().inv_cdf(power)) * measured).alias("powered_effect"),
        enough.alias("enough_evidence"), survives.alias("survives_correction"), F.col("roi").between(low, high).alias("inside_bounds"))


def widest(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keep per group the widest of several units: game first, day if wider, athlete
    only if finite and wider than both. Widths equal to nine places are ties."""
    half = (F.col("high") - F.col("low")) / 2.0
    order = F.when(F.col("unit") == "game", 0).when(F.col("unit") == "day", 1).otherwise(2)
    inf = F.lit(float("inf"))
    ranked = intervals.filter((order < 2) | (half < inf)).withColumn("__k", F.struct(F.round(half, 9).alias("h"), (-order).alias("o")))
    fields = [c for c in intervals.columns if c not in by]
    return ranked.groupBy(*by).agg(F.max_by(F.struct(*fields), "__k").alias("__w")).select(*by, "__w.*")


def interval(
    frame: DataFrame,
    cells: Sequence[Sequence[str]],
    clusters: dict[str, str],
    value: Column | str = "profit_units",
    looks: int = 1,
) -> DataFrame:
    """One-, two- or three-way interval for every cell of every grouping."""
    names = list(dict.fromkeys(c for cell in cells for c in cell))
    sums = per_cluster(frame, cells, clusters, value)
    each = from_clusters(sums, [*names, "grouping", "unit"], looks)
    return widest(each, [*names, "grouping"])


def clustered_mean(frame: DataFrame, value: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and cluster-robust standard error with the g/(g-1) correction."""
    sums = frame.filter(F.col(value).isNotNull()).groupBy(*by, cluster).agg(
        F.sum(value).alias("profit"), F.count("*").alias("bets"))
    moments = sums.groupBy(*by).agg(
        F.sum("profit").alias("s"), F.sum("bets").alias("n"), F.count("*").alias("g"),
        F.var_pop("profit").alias("vp"), F.var_pop("bets").alias("vn"), F.covar_pop("profit", F.col("bets").cast("double")).alias("c"))
    mean = F.col("s") / F.col("n")
    squares = F.col("g") * F.greatest(F.lit(0.0), F.col("vp") - 2 * mean * F.col("c") + mean * mean * F.col("vn"))
    variance = F.when(F.col("g") >= 2, squares * F.col("g") / (F.col("g") - 1) / (F.col("n") * F.col("n")))
    return moments.select(*by, mean.alias("mean"), F.when(variance > 0, F.sqrt(variance)).alias("standard_error"),
                          F.col("n").alias("rows"), F.col("g").alias("clusters"))
