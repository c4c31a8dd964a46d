"""Scores of probabilities: census, Brier, log loss, calibration, edge buckets, OLS."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from closeline import session
from closeline.functions import prices as P
from closeline.operators import intervals as I

EDGE_EDGES = (float("-inf"), -0.10, -0.05, 0.0, 0.02, 0.05, 0.10, 0.20, float("inf"))
MINIMUM_BUCKET = 30
MINIMUM_CLUSTERS = 30
BENCHMARKED_RUNGS = 3
SCORED = ("won", "lost")
CLIP = 1e-6


def population_census(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many devigged rows can be scored and why the others cannot."""
    outcome = F.lower(F.trim(F.col("outcome")))
    have = F.col("model_probability").isNotNull()
    rows = frame.filter(F.col("market_implied").isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("devigged"), F.count_if(~have).alias("no_model_probability"),
        *[F.count_if(have & (outcome == o)).alias(o) for o in ("push", "void", "unsettleable")],
        F.count_if(have & ~outcome.isin(*SCORED, "push", "void", "unsettleable")).alias("other_outcome"),
        F.count_if(have & outcome.isin(*SCORED)).alias("scored"))


def scorable(frame: DataFrame) -> DataFrame:
    outcome = F.lower(F.trim(F.col("outcome")))
    rows = frame.filter(F.col("market_implied").isNotNull() & F.col("model_probability").isNotNull() & outcome.isin(*SCORED))
    return rows.withColumns({"won": (outcome == "won").cast("double"), "model_implied": F.col("model_probability").cast("double"),
                             "disagreement": F.col("model_probability") - F.col("market_implied")})


def ladder_population(frame: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Scorable tiered rows tagged near (priced within the benchmarked rungs) or far."""
    rows = scorable(frame).filter(F.col("tier").isin(*tiers) & F.col("fair_power").isNotNull())
    near = F.coalesce(F.col("rungs_from_the_money") <= BENCHMARKED_RUNGS, F.lit(False))
    loss = lambda p: log_loss(F.col(p), F.col("won"))
    return rows.withColumns({
        "population": F.when(near, "near").otherwise("far"), "loss_model": loss("model_implied"),
        "loss_fair": loss("fair_power"), "advantage": loss("fair_power") - loss("model_implied")})


def log_loss(p: Column, won: Column) -> Column:
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1.0 - CLIP), p))
    return -(won * F.ln(q) + (1.0 - won) * F.ln(1.0 - q))


def clipped(p: Column) -> Column:
    return (p < CLIP) | (p > 1.0 - CLIP)


def exclusions(frame: DataFrame, probability: str) -> DataFrame:
    o = F.col("outcome")
    return frame.agg(F.count_if(F.col(probability).isNull()).alias("no_probability"),
                     *[F.count_if(o == x).alias(x) for x in ("push", "void", "unsettleable")])


def brier(frame: DataFrame, looks: int = 1) -> DataFrame:
    """Brier scores of model, fair, raw and base rate, with the paired advantage."""
    won, model, fair, raw = (F.col(c) for c in ("won", "model_implied", "market_implied", "market_implied_raw"))
    sq = lambda p: F.pow(p - won, 2)
    means = frame.agg(
        F.count("*").alias("rows"), F.avg(won).alias("base_rate"), F.avg(sq(model)).alias("model"), F.avg(sq(fair)).alias("market_devigged"),
        F.avg(sq(raw)).alias("market_raw"), F.var_pop(won).alias("base_rate_reference"))
    units = {"game": "event_id", "day": "slate_date"}
    loss = lambda n, p: F.struct(F.lit(n).alias("against"), (sq(p) - sq(model)).alias("ahead"))
    ahead = frame.select(*units.values(), F.inline(F.array(loss("fair", fair), loss("raw", raw))))
    cells = I.interval(ahead, [["against"]], units, "ahead", looks)  # two rows
    pick = lambda n, c, as_: F.max(F.when(F.col("against") == n, F.col(c))).alias(f"{n}_{as_}")
    wide = cells.agg(*[pick(n, c, as_) for n in ("fair", "raw") for c, as_ in (("roi", "advantage"), ("adjusted_low", "low"), ("adjusted_high", "high"), ("verdict", "verdict"))])
    out = means.crossJoin(F.broadcast(wide))  # one row each
    return out.withColumns({
        "skill_vs_devigged": 1.0 - F.try_divide(F.col("model"), F.col("market_devigged")),
        "skill_vs_raw": 1.0 - F.try_divide(F.col("model"), F.col("market_raw")),
        "loses_to_market": F.col("model") > F.col("market_raw")})


def bucket_index(value: Column, edges: Sequence[float]) -> Column:
    """Bucket by left-closed edges; the last one is closed on both sides."""
    inner = edges[1:-1]
    return sum((F.when(value >= e, 1).otherwise(0) for e in inner), F.lit(0))


def _bucket_table(frame: DataFrame, edges: Sequence[float]) -> DataFrame:
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    return frame.sparkSession.createDataFrame(rows, "bucket int, bucket_low double, bucket_high double")


def edge_buckets(frame: DataFrame, looks: int = 1) -> DataFrame:
    """Claimed edge against result per bucket; empty buckets keep a row."""
    rows = frame.filter(F.col("edge").isNotNull()).withColumn("bucket", bucket_index(F.col("edge"), EDGE_EDGES))
    # Counts and intervals read the rows, and making them is most of the work.
    rows = session.cut_lineage(rows.select("bucket", "event_id", "slate_date", "won", "edge", "model_implied", "market_implied", "profit_units"))
    per = rows.groupBy("bucket").agg(
        F.count("*").alias("rows"), F.countDistinct("event_id").alias("games"), F.sum("won").alias("wins"), F.avg("edge").alias("claimed_edge"),
        F.avg("model_implied").alias("model_implied"), F.avg("market_implied").alias("market_implied"))
    low, high = P.wilson(F.col("wins"), F.col("rows"))
    realised = F.col("wins") / F.col("rows")
    per = per.withColumns({"realised": realised, "wilson_low": low, "wilson_high": high,
                           "gap_to_model": realised - F.col("model_implied"), "gap_to_market": realised - F.col("market_implied")})
    roi = I.interval(rows, [["bucket"]], {"game": "event_id", "day": "slate_date"}, "profit_units", looks).select(
        "bucket", "roi", F.col("adjusted_low").alias("roi_low"), F.col("adjusted_high").alias("roi_high"))
    out = F.broadcast(_bucket_table(frame, EDGE_EDGES)).join(per, "bucket", "left").join(roi, "bucket", "left")
    return out.withColumns({"rows": F.coalesce("rows", F.lit(0)), "games": F.coalesce("games", F.lit(0))}).withColumn("enough", F.col("rows") >= MINIMUM_BUCKET)


def overconfidence_slope(buckets: DataFrame) -> DataFrame:
    """Lowest against highest usable bucket: does the gap widen with the claim?"""
    b = buckets.filter("enough").agg(
        F.count("*").alias("usable_buckets"),
        F.min_by(F.struct("bucket_low", "rows", "gap_to_model", "roi"), "bucket").alias("lo"),
        F.max_by(F.struct("bucket_low", "rows", "gap_to_model", "roi"), "bucket").alias("hi"))
    return b.select("usable_buckets", (F.col("usable_buckets") >= 2).alias("measurable"), F.col("lo.bucket_low").alias("lowest"), F.col("hi.bucket_low").alias("highest"),
                    F.col("lo.gap_to_model").alias("gap_lowest"), F.col("hi.gap_to_model").alias("gap_highest"),
                    (F.col("hi.gap_to_model") < F.col("lo.gap_to_model")).alias("widens"), (F.col("lo.gap_to_model") - F.col("hi.gap_to_model")).alias("widens_by"),
                    (F.col("hi.roi") - F.col("lo.roi")).alias("return_change"))


def calibration_table(frame: DataFrame, probability: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Ten bins of predicted against observed; the last is closed; empty ones stay."""
    edges = [i / 10 for i in range(11)]
    rows = frame.filter(F.col(probability).isNotNull() & F.col("won").isNotNull())
    # Compare with the printed edges: multiplying by ten would misplace 0.3 and 0.7.
    per = rows.withColumn("bucket", bucket_index(F.col(probability), edges)).groupBy(*by, "bucket").agg(
        F.count("*").alias("n"), F.sum("won").alias("wins"), F.avg(probability).alias("predicted"))
    low, high = P.wilson(F.col("wins"), F.col("n"))
    per = per.withColumns({"observed": F.col("wins") / F.col("n"), "wilson_low": low, "wilson_high": high})
    if not by:
        per = F.broadcast(_bucket_table(frame, edges)).join(per, "bucket", "left")
    return per.withColumns({"n": F.coalesce("n", F.lit(0)), "gap": F.col("observed") - F.col("predicted")}).withColumn("enough", F.col("n") >= MINIMUM_BUCKET)


def overconfidence(table: DataFrame) -> DataFrame:
    use = table.filter("enough")
    return use.agg(F.try_divide(F.sum((F.col("predicted") - F.col("observed")) * F.col("n")), F.sum("n")).alias("points"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("buckets"))


def calibration_by_decile(frame: DataFrame, probability: str, wager: Sequence[str]) -> DataFrame:
    """Deciles with rows and distinct wagers; means only from 30 wagers."""
    edges = [i / 10 for i in range(11)]
    per = frame.filter(F.col(probability).isNotNull()).withColumn("bucket", bucket_index(F.col(probability), edges)).groupBy("bucket").agg(
        F.count("*").alias("rows"), F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wager])).alias("wagers"),
        F.avg(probability).alias("__p"), F.avg("won").alias("__w"))
    out = F.broadcast(_bucket_table(frame, edges)).join(per, "bucket", "left")
    enough = F.coalesce(F.col("wagers") >= MINIMUM_BUCKET, F.lit(False))
    return out.select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("wagers", F.lit(0)).alias("wagers"), enough.alias("enough"),
                      F.when(enough, F.col("__p")).alias("predicted"), F.when(enough, F.col("__w")).alias("realised"),
                      F.when(enough, 100.0 * (F.col("__p") - F.col("__w"))).alias("gap_points"))


def advantage_interval(frame: DataFrame, value: str, cells: Sequence[Sequence[str]], looks: int = 1) -> DataFrame:
    """Three-way interval of a loss difference; below 30 clusters there is no verdict."""
    out = I.interval(frame, cells, {"game": "event_id", "day": "slate_date", "athlete": "subject"}, value, looks)
    return out.withColumn("below_floor", F.col("clusters") < MINIMUM_CLUSTERS).withColumn(
        "verdict", F.when(F.col("below_floor"), "not enough evidence").otherwise(F.col("verdict")))


def coverage_by_rung(frame: DataFrame) -> DataFrame:
    paired = F.col("market_implied").isNotNull()
    per = frame.filter("rungs_from_the_money is not null").groupBy(F.col("rungs_from_the_money").cast("long").alias("rungs")).agg(
        F.count("*").alias("rows"), F.count_if(paired).alias("two_sided"))
    return per.withColumns({"share": F.col("two_sided") / F.col("rows"), "benchmarked": F.col("rungs") <= BENCHMARKED_RUNGS})


def overround_summary(frame: DataFrame) -> DataFrame:
    """Spread of the margin over pairs. Margins are continuous: exact split quantile."""
    from closeline.operators.segments import exact_quantiles

    rows = frame.filter(F.col("overround").isNotNull()).select(F.col("overround").cast("double").alias("overround"))
    median = exact_quantiles(rows, [], "overround", [0.5], "median")
    rest = rows.agg((F.count("*") / 2).alias("pairs"), F.avg("overround").alias("mean"), F.min("overround").alias("low"), F.max("overround").alias("high"))
    return rest.crossJoin(F.broadcast(median))


def ols_clustered(frame: DataFrame, response: str, features: Sequence[str], clusters: dict[str, str], nulls: Sequence[float], looks: int = 1) -> DataFrame:
    """Least squares with sandwich errors by each cluster unit; the wider error is kept.

    Two passes of sums: the normal equations, and the summed scores per cluster. What
    reaches the driver is k by k, whatever the number of rows. Both read the columns they
    need from a checkpoint: the rows are worked out once.
    """
    frame = session.cut_lineage(frame.select(*dict.fromkeys([response, *features, *clusters.values()])))
    names = ["intercept", *features]
    k = len(names)
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(response).cast("double")
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    first = frame.agg(F.count("*").alias("n"), *sums, *[F.sum(x[i] * y).alias(f"y{i}") for i in range(k)]).first()
    spark = frame.sparkSession
    schema = "name string, estimate double, standard_error double, cluster_unit string, rows long, clusters long, null_value double, low double, high double, excludes_null boolean"
    n = first["n"]
    if n <= k:
        return spark.createDataFrame([], schema)
    xtx = np.array([[first[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    if np.linalg.matrix_rank(xtx) < k:
        return spark.createDataFrame([], schema)
    bread = np.linalg.inv(xtx)
    beta = bread @ np.array([first[f"y{i}"] for i in range(k)])
    residual = y - sum((F.lit(float(b)) * xi for b, xi in zip(beta, x)), F.lit(0.0))
    ways = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(c).cast("string").alias("cluster")) for u, c in clusters.items()]))
    scored = frame.select(*[(residual * xi).alias(f"s{i}") for i, xi in enumerate(x)], ways.alias("w"))
    per = scored.groupBy("w.unit", "w.cluster").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    meats = per.groupBy("unit").agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
    errors, counts = {}, {}
    for row in meats:
        g = row["g"]
        if g < 2:
            return spark.createDataFrame([], schema)
        meat = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        cov = bread @ meat @ bread * (g / (g - 1)) * ((n - 1) / (n - k))
        errors[row["unit"]], counts[row["unit"]] = np.sqrt(np.clip(np.diag(cov), 0, None)), g
    z = I.adjusted_z(looks)
    rows = []
    for i, name in enumerate(names):
        unit = list(clusters)[0]
        for u in clusters:
            if errors[u][i] > errors[unit][i] * (1 + 1e-12):
                unit = u
        b, se = float(beta[i]), float(errors[unit][i])
        low, high = b - z * se, b + z * se
        rows.append((name, b, se, unit, n, counts[unit], float(nulls[i]), low, high, bool(high > low and not low <= nulls[i] <= high)))
    return spark.createDataFrame(rows, schema)
