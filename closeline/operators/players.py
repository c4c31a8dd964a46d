"""Player rates, trailing evidence and the constants fitted from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from closeline import session
from closeline.functions import prices as P, times as C
from closeline.operators import history as H, segments as G

BUCKET_EDGES = (8.0, 12.0, 16.0, 20.0, 24.0, 28.0, 32.0, 36.0)
HALF_LIFE = 4.0
HALF_LIVES = (2.0, 4.0, 8.0, 16.0)
MIN_GAMES, MIN_MINUTES = 4, 60.0
BAND_ROWS, STABLE_WITHIN = 500, 2.0
STATS = ("points", "rebounds", "assists", "steals", "blocks", "turnovers")
# Two blocks back the weight is 2**-256 of the newest row's: below double precision.
_BLOCK_HALF_LIVES = 128


def game_features(players: DataFrame) -> DataFrame:
    """Usage, shares and per-40 rates of each player against his team's game totals.

    A team's game is one box score, so its window is a handful of rows.
    """
    c = F.col
    rows = players.filter(F.coalesce(c("minutes"), F.lit(0.0)) > 0)
    team = W.partitionBy("game_id", "team_id")
    total = lambda n: F.sum(n).over(team)
    f = rows.withColumns({f"__{n}": total(n) for n in ("minutes", "field_goals_attempted", "field_goals_made", "free_throws_attempted", "turnovers", "offensive_rebounds", "defensive_rebounds")})
    r = H.rate
    share = r(c("minutes") * 5.0, c("__minutes"))
    used = c("field_goals_attempted") + 0.44 * c("free_throws_attempted") + c("turnovers")
    team_used = c("__field_goals_attempted") + 0.44 * c("__free_throws_attempted") + c("__turnovers")
    return f.withColumn("minutes_share", share).withColumns({
        "usage_rate": r(used, team_used * c("minutes_share")), "shot_share": r(c("field_goals_attempted"), c("__field_goals_attempted") * c("minutes_share")),
        "assist_rate": r(c("assists"), (c("__field_goals_made") - c("field_goals_made")) * c("minutes_share")), "turnover_rate": r(c("turnovers"), used),
        "assist_to_turnover": r(c("assists"), c("turnovers")), "off_reb_rate": r(c("offensive_rebounds"), c("__offensive_rebounds") * c("minutes_share")),
        "def_reb_rate": r(c("defensive_rebounds"), c("__defensive_rebounds") * c("minutes_share")), "block_rate": 40.0 * r(c("blocks"), c("minutes")),
        "steal_rate": 40.0 * r(c("steals"), c("minutes")), "free_throw_rate": r(c("free_throws_attempted"), c("field_goals_attempted")),
        "fouls_per_40": 40.0 * r(c("fouls"), c("minutes")), "points_per_40": 40.0 * r(c("points"), c("minutes")),
        "true_shooting_pct": r(c("points"), 2.0 * (c("field_goals_attempted") + 0.44 * c("free_throws_attempted"))),
        "game_score": c("points") + 0.4 * c("field_goals_made") - 0.7 * c("field_goals_attempted") - 0.4 * (c("free_throws_attempted") - c("free_throws_made"))
        + 0.7 * c("offensive_rebounds") + 0.3 * c("defensive_rebounds") + c("steals") + 0.7 * c("assists") + 0.7 * c("blocks") - 0.4 * c("fouls") - c("turnovers"),
    }).drop(*[n for n in f.columns if n.startswith("__")])


def roster_features(features: DataFrame) -> DataFrame:
    """Bench shares and usage concentration of a team's game."""
    bench = ~F.coalesce("starter", F.lit(False))
    total = W.partitionBy("game_id", "team_id")
    rows = features.withColumn("__u", F.sum("usage_rate").over(total))
    return rows.groupBy("game_id", "team_id").agg(
        H.rate(F.sum(F.when(bench, F.col("minutes")).otherwise(0.0)), F.sum("minutes")).alias("bench_minutes_share"),
        (F.sum(F.when(bench, F.col("points")).otherwise(0)) / F.greatest(F.sum("points"), F.lit(1))).alias("bench_points_share"),
        F.sum(F.pow(F.try_divide(F.col("usage_rate"), F.col("__u")), 2)).alias("usage_concentration"))


def feature_calibration(features: DataFrame) -> DataFrame:
    """Season means and the sums that must hold: shares to 5, weighted usage to 1."""
    per = features.groupBy("season", "game_id", "team_id").agg(
        F.sum("minutes_share").alias("shares"), (F.sum(F.col("usage_rate") * F.col("minutes_share"))).alias("usage"))
    sums = per.groupBy("season").agg(F.count("*").alias("team_games"), F.avg("shares").alias("mean_shares"), F.avg("usage").alias("mean_weighted_usage"))
    means = features.groupBy("season").agg(F.count("*").alias("player_games"), *[F.avg(n).alias(n) for n in ("true_shooting_pct", "points_per_40", "game_score")])
    return means.join(sums, "season")


def with_trailing(players: DataFrame, keys: Sequence[str] = ("season", "athlete_id"), half_lives: Sequence[float] = (HALF_LIFE,), banks: Sequence[str] = STATS) -> DataFrame:
    """Weighted trailing minutes and prior sums from earlier rows only.

    Keys are persons, or seasons of persons: a career is a few hundred rows, so plain
    windows over the keys do, all on one shuffle. Weights halve every ``half_life``
    played games. The count of games played before a row cuts the history into blocks
    of 128 half lives, inside which growing weights stay in range, and the two blocks
    before carry all that double precision can hold.
    """
    keys = list(keys)
    played = ~F.coalesce("did_not_play", F.lit(False)) & (F.col("minutes") > 0)
    sums = {"prior_games": F.when(played, 1), "prior_minutes": F.when(played, F.col("minutes"))}
    sums.update({f"bank_{b}": F.when(played, F.col(b)) for b in banks})
    past = W.partitionBy(*keys).orderBy("slate_date", "row_key").rowsBetween(W.unboundedPreceding, -1)
    counted = players.select("*", played.alias("played"), *[F.coalesce(F.sum(e).over(past), F.lit(0)).alias(n) for n, e in sums.items()])
    work = counted.withColumn("half_life", F.explode(F.array(*[F.lit(float(h)) for h in half_lives]))) if len(half_lives) > 1 else counted.withColumn("half_life", F.lit(float(half_lives[0])))
    size = _BLOCK_HALF_LIVES * F.col("half_life")
    p = F.col("prior_games").cast("double")
    work = work.withColumn("__block", F.floor(p / size)).withColumn("__at", p - F.col("__block") * size)
    grown = F.when(F.col("played"), F.col("minutes") * F.pow(F.lit(2.0), F.col("__at") / F.col("half_life")))
    key = [*keys, "half_life"]
    inside = W.partitionBy(*key, "__block").orderBy("slate_date", "row_key").rowsBetween(W.unboundedPreceding, -1)
    blocks = W.partitionBy(*key).orderBy("__block")
    work = work.withColumn("__grown", grown)
    before = lambda w: F.coalesce(F.sum("__grown").over(w), F.lit(0.0))
    block = F.lit(2.0 ** -_BLOCK_HALF_LIVES)
    work = work.withColumn("__sum", before(inside) + before(blocks.rangeBetween(-1, -1)) * block + before(blocks.rangeBetween(-2, -2)) * block * block)
    decay = lambda n: F.pow(F.lit(0.5), n / F.col("half_life"))
    bottom = (1.0 - decay(p)) / (1.0 - decay(F.lit(1.0)))
    work = work.withColumn("projected_minutes", F.when(p > 0, F.col("__sum") * decay(F.col("__at") - 1) / bottom))
    return work.withColumn("bucket", C.minutes_bucket(F.round("projected_minutes", 9), BUCKET_EDGES)).drop("__block", "__at", "__sum", "__grown")


def priced(trailing: DataFrame) -> DataFrame:
    """Played rows with enough history to be priced."""
    return trailing.filter(F.col("played") & (F.col("prior_games") >= MIN_GAMES) & (F.col("prior_minutes") >= MIN_MINUTES))


def latest_evidence(trailing: DataFrame, keys: Sequence[str] = ("season", "athlete_id")) -> DataFrame:
    """The last row of each player's trailing evidence."""
    fields = [c for c in trailing.columns if c not in keys]
    return trailing.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct("slate_date", "row_key")).alias("r")).select(*keys, "r.*")


def prior_roster(players: DataFrame, day: str, season: int, teams: DataFrame) -> DataFrame:
    """Rows before a day, this and last season, of the given teams."""
    past = H.before(players, day).filter(F.col("season").isin(season - 1, season))
    return past.join(teams.select("team_id"), "team_id", "left_semi")


def half_life_curve(players: DataFrame, half_lives: Sequence[float] = HALF_LIVES) -> DataFrame:
    """Error of trailing minutes by half-life, and of the flat mean (half_life null)."""
    rows = priced(with_trailing(players, half_lives=half_lives, banks=()))
    curve = rows.groupBy("half_life").agg(F.sqrt(F.avg(F.pow(F.col("minutes") - F.col("projected_minutes"), 2))).alias("rmse"), F.count("*").alias("rows"))
    flat = rows.filter(F.col("half_life") == float(half_lives[0])).agg(
        F.sqrt(F.avg(F.pow(F.col("minutes") - F.col("prior_minutes") / F.col("prior_games"), 2))).alias("rmse"), F.count("*").alias("rows"))
    return curve.unionByName(flat.select(F.lit(None).cast("double").alias("half_life"), "rmse", "rows"))


def role_priors(rows: DataFrame, stats: Sequence[str] = STATS) -> DataFrame:
    """Stat per minute by bucket of projected minutes, as ratios of sums."""
    return rows.groupBy("bucket").agg(F.count("*").alias("rows"), *[F.try_divide(F.sum(s), F.sum("minutes")).alias(s) for s in stats])


def absence_rates(trailing: DataFrame) -> DataFrame:
    """Share of rows that did not play, by bucket, among players with history."""
    return trailing.filter(F.col("prior_games") >= MIN_GAMES).groupBy("bucket").agg(F.count("*").alias("rows"), F.avg((~F.col("played")).cast("double")).alias("absent_share"))


def _grid(sums: DataFrame, ks: Sequence[float]) -> DataFrame:
    """One row per k. ``best`` is told within the row of sums: a second pass over the rows may add them in another order."""
    least = F.array_min(F.array(*[F.col(f"l{i}") for i in range(len(ks))]))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"l{i}").alias("loss"), (F.col(f"l{i}") == least).alias("best")) for i, k in enumerate(ks)])))


def credibility_losses(rows: DataFrame, priors: DataFrame, stat: str, ks: Sequence[float]) -> DataFrame:
    """Weighted squared error of the shrunk rate for each k, all in one aggregate.

    Each k is one more sum over the same rows; rows are not repeated per k.
    """
    work = rows.join(F.broadcast(priors.select("bucket", F.col(stat).alias("__prior"))), "bucket")
    m, pm = F.col("minutes"), F.col("prior_minutes")
    gap = F.col(f"bank_{stat}") / pm - F.col("__prior")
    r0 = F.col(stat) / m - F.col("__prior")
    loss = lambda k: F.sum(m * F.pow(r0 - pm / (pm + k) * gap, 2)) / F.sum(m)
    return _grid(work.agg(*[loss(float(k)).alias(f"l{i}") for i, k in enumerate(ks)]), ks)


def credibility_sums(rows: DataFrame, priors: DataFrame, stat: str) -> DataFrame:
    """What the loss of any k is made of: sums per value of prior minutes (to nine places).

    The weight that k gives a row depends on its prior minutes alone, so with
    w = p / (p + k) the loss is (sum rr - 2 sum w rg + sum w w gg) / sum m over these.
    """
    work = rows.join(F.broadcast(priors.select("bucket", F.col(stat).alias("__prior"))), "bucket")
    m, pm = F.col("minutes"), F.col("prior_minutes")
    gap, r0 = F.col(f"bank_{stat}") / pm - F.col("__prior"), F.col(stat) / m - F.col("__prior")
    use = work.filter((pm > 0) & (m > 0)).select(F.round(pm, 9).alias("p"), m.alias("m"), r0.alias("r"), gap.alias("g")).filter("r is not null and g is not null")
    return use.groupBy("p").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("m") * F.col("r") * F.col("g")).alias("rg"), F.sum(F.col("m") * F.col("g") * F.col("g")).alias("gg"))


def credibility(rows: DataFrame, priors: DataFrame, stat: str, tolerance: float = 1e-4, points: int = 25, low: float = 0.1, high: float = 10_000.0) -> tuple[float, float]:
    """(k, loss) of the least loss, k to the given part of itself.

    The rows are read once, into their sums; each round tries a log grid of k on these and
    narrows it around the best. A round brings one row to the driver. Null where there are no rows.
    """
    sums = session.cut_lineage(credibility_sums(rows, priors, stat))
    w = lambda k: F.col("p") / (F.col("p") + float(k))
    least, most = low, high
    while True:
        step = (high / low) ** (1.0 / (points - 1))
        ks = [low * step**i for i in range(points)]
        losses = [(F.sum(F.col("rr") - 2.0 * w(k) * F.col("rg") + w(k) * w(k) * F.col("gg")) / F.sum("m")).alias(f"l{i}") for i, k in enumerate(ks)]
        found = sums.agg(*losses).first()
        if found[0] is None:
            return float("nan"), float("nan")
        best = min(range(points), key=lambda i: found[i])
        if step <= 1.0 + tolerance:
            return ks[best], found[best]
        low, high = max(least, ks[best] / step), min(most, ks[best] * step)


def credibility_by_band(rows: DataFrame, priors: DataFrame, stat: str, ks: Sequence[float], bands: Sequence[float]) -> DataFrame:
    """Best k of the grid per band of prior minutes, from one grouped pass."""
    work = rows.join(F.broadcast(priors.select("bucket", F.col(stat).alias("__prior"))), "bucket").withColumn("band", C.minutes_bucket("prior_minutes", tuple(bands)))
    m, pm = F.col("minutes"), F.col("prior_minutes")
    gap, r0 = F.col(f"bank_{stat}") / pm - F.col("__prior"), F.col(stat) / m - F.col("__prior")
    sums = work.groupBy("band").agg(F.count("*").alias("rows"), *[(F.sum(m * F.pow(r0 - pm / (pm + float(k)) * gap, 2)) / F.sum(m)).alias(f"l{i}") for i, k in enumerate(ks)])
    cells = F.array(*[F.struct(F.col(f"l{i}").alias("loss"), F.lit(float(k)).alias("k")) for i, k in enumerate(ks)])
    return sums.select("band", "rows", F.array_min(cells).alias("b")).select("band", "rows", F.col("b.k").alias("k"), F.col("b.loss").alias("loss"), (F.col("rows") >= BAND_ROWS).alias("enough"))


def value_pmf(players: DataFrame) -> DataFrame:
    """Shares of one-, two- and three-point scoring events, with mean and variance."""
    one, three = F.sum("free_throws_made"), F.sum("three_made")
    two = F.sum(F.greatest(F.col("field_goals_made") - F.col("three_made"), F.lit(0)))
    s = players.filter(~F.col("did_not_play")).agg(one.alias("a"), two.alias("b"), three.alias("c"))
    n = F.col("a") + F.col("b") + F.col("c")
    out = s.select((F.col("a") / n).alias("ones"), (F.col("b") / n).alias("twos"), (F.col("c") / n).alias("threes"), n.alias("events"))
    mean = F.col("ones") + 2 * F.col("twos") + 3 * F.col("threes")
    return out.withColumn("mean", mean).withColumn("variance", F.col("ones") + 4 * F.col("twos") + 9 * F.col("threes") - F.pow(mean, 2))


def value_mix_losses(trailing: DataFrame, pmf: DataFrame, ks: Sequence[float]) -> DataFrame:
    """Mean multinomial deviance of the shrunk value mix for each prior size k."""
    rows = trailing.crossJoin(F.broadcast(pmf.select(F.col("ones").alias("p1"), F.col("twos").alias("p2"), F.col("threes").alias("p3"))))
    bank = [F.col("bank_ones"), F.col("bank_twos"), F.col("bank_threes")]
    n = bank[0] + bank[1] + bank[2]

    def loss(k: float) -> Column:
        parts = [F.col(c) * F.ln(F.greatest((b + k * F.col(p)) / (n + k), F.lit(1e-12))) for c, b, p in zip(("ones", "twos", "threes"), bank, ("p1", "p2", "p3"))]
        return -2.0 * F.avg(parts[0] + parts[1] + parts[2])

    return _grid(rows.agg(*[loss(float(k)).alias(f"l{i}") for i, k in enumerate(ks)]), ks)


def with_values(players: DataFrame) -> DataFrame:
    return players.withColumns({"ones": F.col("free_throws_made"), "threes": F.col("three_made"), "twos": F.greatest(F.col("field_goals_made") - F.col("three_made"), F.lit(0))})


def pooled_vmr(rows: DataFrame, stats: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Within-cell variance over mean per stat, from two moments per cell."""
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("x")) for s in stats])))
    cells = long.groupBy("stat", *keys).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.var_pop("x").alias("v")).filter("n >= 2")
    out = cells.groupBy("stat").agg(F.sum("n").alias("used"), F.count("*").alias("cells"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("v")).alias("sse"))
    dof, mean = F.col("used") - F.col("cells"), F.col("s") / F.col("used")
    return out.select("stat", "used", "cells", F.when((dof > 0) & (mean > 0), F.col("sse") / dof / mean).alias("vmr"))


def pearson_dispersion(rows: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Quasi-Poisson dispersion against a player-season rate per minute."""
    long = rows.filter("minutes > 0").select("season", "athlete_id", "minutes", F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("x")) for s in stats])))
    per = long.groupBy("stat", "season", "athlete_id").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("minutes").alias("sm"), F.sum(F.col("x") * F.col("x") / F.col("minutes")).alias("sxxm")).filter("n >= 2 and sx > 0")
    r = F.col("sx") / F.col("sm")
    out = per.groupBy("stat").agg(F.sum("n").alias("used"), F.count("*").alias("cells"), F.sum(F.col("sxxm") / r - 2 * F.col("sx") + r * F.col("sm")).alias("chi"))
    dof = F.col("used") - F.col("cells")
    return out.select("stat", "used", F.when(dof > 0, F.col("chi") / dof).alias("phi"))


def residual_correlations(rows: DataFrame, stats: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Correlation of within-cell residuals per pair of stats, from cell cross sums."""
    pairs = [(a, b) for i, a in enumerate(stats) for b in stats[i + 1:]]
    cells = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.var_pop(s).alias(f"v_{s}") for s in stats],
        *[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{a}_{b}") for a, b in pairs]).filter("n >= 2")
    sums = cells.agg(F.sum("n").alias("rows"), *[F.sum(F.col("n") * F.col(f"v_{s}")).alias(f"s_{s}") for s in stats], *[F.sum(F.col("n") * F.col(f"c_{a}_{b}")).alias(f"p_{a}_{b}") for a, b in pairs])
    return sums.select("rows", F.inline(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"),
        F.try_divide(F.col(f"p_{a}_{b}"), F.nullif(F.sqrt(F.col(f"s_{a}") * F.col(f"s_{b}")), F.lit(0.0))).alias("correlation")) for a, b in pairs])))


def compound_targets(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dispersion of points implied by scoring events and their values, against measured."""
    work = with_values(rows).withColumn("events", F.col("ones") + F.col("twos") + F.col("threes")).withColumn("scored", F.col("ones") + 2 * F.col("twos") + 3 * F.col("threes"))
    vmr = pooled_vmr(work, ["events", "scored"], keys).groupBy().agg(
        F.max(F.when(F.col("stat") == "events", F.col("vmr"))).alias("events_vmr"), F.max(F.when(F.col("stat") == "scored", F.col("vmr"))).alias("measured"))
    value = value_pmf(rows).select("mean", "variance")
    out = vmr.crossJoin(F.broadcast(value))
    implied = F.col("variance") / F.col("mean") + F.col("events_vmr") * F.col("mean")
    return out.withColumn("implied", implied).withColumn("ratio", F.col("measured") / implied)


def settled_sum(value: Column) -> Column:
    """Sum of doubles rounded once, so that it is the same in whatever order rows are added.

    A value is split into two whole numbers, of 2**-20 and of 2**-60; values they can't hold
    are added as they are.
    """
    fits = F.abs(value) < 2.0 ** 20
    held = F.when(fits, value)
    high = F.floor(held * 2.0 ** 20)
    low = F.floor((held - high * 2.0 ** -20) * 2.0 ** 60)
    return F.when(F.bool_and(fits), F.sum(high) * 2.0 ** -20 + F.sum(low) * 2.0 ** -60).otherwise(F.sum(value))


def roster_totals(players: DataFrame) -> DataFrame:
    return players.filter(~F.coalesce("did_not_play", F.lit(False))).groupBy("season", "team_id", "athlete_id").agg(
        settled_sum(F.coalesce("minutes", F.lit(0.0))).alias("minutes"), F.min(F.when(F.col("minutes") > 0, F.col("slate_date"))).alias("first_day"))


def main_team(totals: DataFrame) -> DataFrame:
    """Each athlete's team with most minutes in a season; highest id on ties."""
    return totals.groupBy("season", "athlete_id").agg(F.max_by("team_id", F.struct("minutes", "team_id")).alias("main_team"), F.sum("minutes").alias("season_minutes"))


def roster_evidence(players: DataFrame) -> DataFrame:
    """Current appearances with last season's minutes and main team."""
    totals = roster_totals(players)
    last = main_team(totals).select((F.col("season") + 1).alias("season"), "athlete_id", F.col("main_team").alias("previous_team_id"), F.col("season_minutes").alias("previous_minutes"))
    seasons = totals.select((F.col("season") + 1).alias("season")).distinct()
    now = totals.filter("first_day is not null").join(seasons, "season", "left_semi")
    out = now.join(last, ["season", "athlete_id"], "left")
    return out.select("season", "team_id", "athlete_id", F.col("first_day").alias("first_slate_date"), F.coalesce("previous_minutes", F.lit(0.0)).alias("previous_minutes"), "previous_team_id")


def roster_turnover(players: DataFrame) -> DataFrame:
    """Mean and median share of minutes that return, and that arrive, by season."""
    totals = roster_totals(players).select("season", "team_id", "athlete_id", "minutes")
    now = totals.select("season", "team_id", "athlete_id", F.lit(True).alias("__here"))
    back = totals.withColumn("season", F.col("season") + 1).join(now, ["season", "team_id", "athlete_id"], "left")
    returning = back.groupBy("season", "team_id").agg(F.sum("minutes").alias("t"), F.sum(F.when(F.col("__here"), F.col("minutes")).otherwise(0.0)).alias("r")).filter("t > 0")
    played_seasons = totals.select("season").distinct()
    returning = returning.join(played_seasons, "season", "left_semi").withColumn("returning", F.col("r") / F.col("t"))
    before = main_team(totals).select((F.col("season") + 1).alias("season"), "athlete_id", "main_team")
    arrived = totals.join(before, ["season", "athlete_id"], "left")
    incoming = arrived.groupBy("season", "team_id").agg(F.sum("minutes").alias("t2"), F.sum(F.when(F.col("main_team") != F.col("team_id"), F.col("minutes")).otherwise(0.0)).alias("i")).filter("t2 > 0").withColumn("incoming", F.col("i") / F.col("t2"))
    both = returning.join(incoming, ["season", "team_id"], "left")
    # One value per team: the median is over teams.
    return both.groupBy("season").agg(F.count("*").alias("teams"), F.avg("returning").alias("returning_mean"), F.percentile("returning", F.lit(0.5)).alias("returning_median"), F.avg("incoming").alias("incoming_mean"))


def refusal_census(projections: DataFrame) -> DataFrame:
    return projections.groupBy("refusal").agg(F.count("*").alias("athletes"))


def resolution_census(projections: DataFrame) -> DataFrame:
    """Resolved and priceable share by tier, with the gap to the best tier in points."""
    per = projections.groupBy("tier").agg(F.count("*").alias("athletes"), F.avg(F.col("resolved").cast("double")).alias("resolved_share"), F.avg((F.col("refusal") == "").cast("double")).alias("priceable_share"))
    best = per.agg(F.max("priceable_share").alias("__best"))
    return per.crossJoin(F.broadcast(best)).withColumn("points_behind", 100.0 * (F.col("__best") - F.col("priceable_share"))).drop("__best")
