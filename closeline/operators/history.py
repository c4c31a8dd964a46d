"""Team history: per-game rates, leakage-free trailing values, form, rest, luck."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from closeline.functions import prices as P, times as C
from closeline.operators import segments as G

FORM_GAMES, FORM_SHRINK, FORM_CLAMP = 5, 15.0, 3.0
REST_SHRINK, REST_CLAMP, REST_TIER_GAMES = 300.0, 2.0, 150
ROTATION_WINDOW, ROTATION_APPEARANCES, ROTATION_MINUTES = 8, 3, 18.0
AVAILABILITY_SHARE, AVAILABILITY_FLOOR = 0.5, 0.92
LUCK_SHARE, LUCK_GAMES, LUCK_CLAMP = 0.5, 5, 3.0


def before(frame: DataFrame, day: str, column: str = "slate_date") -> DataFrame:
    """Rows strictly before a day; the filter reaches the scan."""
    return frame.filter(F.col(column) < F.lit(day).cast("date"))


def by_month(day: str = "slate_date") -> list[Column]:
    """Segments for ordered scans over games: the month of the day."""
    return [F.trunc(day, "month")]


OPPONENT = ("team_score", "field_goals_made", "field_goals_attempted", "three_made", "three_attempted", "free_throws_attempted",
            "offensive_rebounds", "defensive_rebounds", "turnovers", "steals", "possessions")


def with_opponent(games: DataFrame, columns: Sequence[str] = OPPONENT) -> DataFrame:
    """Each side's row with the other side's columns (suffix ``_opp``).

    A game has two rows, so both meet in one aggregate per game instead of a self-join
    that reads and shuffles the table twice. Every column is its own aggregate and its
    own output expression, so what a query does not use is pruned down to the scan.
    """
    fields = [c for c in games.columns if c not in ("game_id", "home_away")]
    home = F.col("home_away") == "home"
    side = lambda cond, tag: [F.max(F.when(cond, F.col(c))).alias(f"{tag}_{c}") for c in fields]
    pair = games.groupBy("game_id").agg(F.count_if(home).alias("__h"), F.count_if(~home).alias("__a"), *side(home, "__h"), *side(~home, "__a"))
    both = pair.filter("__h > 0 and __a > 0").withColumn("home_away", F.explode(F.array(F.lit("home"), F.lit("away"))))
    own = lambda c, x, y: F.when(F.col("home_away") == "home", F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}"))
    return both.select("game_id", "home_away", *[own(c, "__h", "__a").alias(c) for c in fields], *[own(c, "__a", "__h").alias(f"{c}_opp") for c in columns])


def rate(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b.cast("double"), F.lit(0.0)))


def game_features(games: DataFrame) -> DataFrame:
    """Per-game rates of a side and what it allowed."""
    c = F.col
    f = with_opponent(games)
    feats = {
        "efg_pct": rate(c("field_goals_made") + 0.5 * c("three_made"), c("field_goals_attempted")),
        "turnover_rate": rate(c("turnovers"), c("possessions")),
        "off_reb_pct": rate(c("offensive_rebounds"), c("offensive_rebounds") + c("defensive_rebounds_opp")),
        "def_reb_pct": rate(c("defensive_rebounds"), c("defensive_rebounds") + c("offensive_rebounds_opp")),
        "free_throw_rate": rate(c("free_throws_attempted"), c("field_goals_attempted")),
        "efg_pct_allowed": rate(c("field_goals_made_opp") + 0.5 * c("three_made_opp"), c("field_goals_attempted_opp")),
        "turnover_rate_forced": rate(c("turnovers_opp"), c("possessions_opp")),
        "free_throw_rate_allowed": rate(c("free_throws_attempted_opp"), c("field_goals_attempted_opp")),
        "non_steal_turnover_rate": rate(c("turnovers") - c("steals_opp"), c("possessions")),
        "off_efficiency": 100.0 * rate(c("team_score"), c("possessions")),
        "def_efficiency": 100.0 * rate(c("opponent_score"), c("possessions_opp")),
        "tempo": c("possessions"),
        "true_shooting_pct": rate(c("team_score"), 2.0 * (c("field_goals_attempted") + 0.44 * c("free_throws_attempted"))),
        "three_point_rate": rate(c("three_attempted"), c("field_goals_attempted")),
        "three_point_rate_allowed": rate(c("three_attempted_opp"), c("field_goals_attempted_opp")),
        "two_point_pct": rate(c("field_goals_made") - c("three_made"), c("field_goals_attempted") - c("three_attempted")),
        "three_point_pct": rate(c("three_made"), c("three_attempted")),
        "free_throw_pct": rate(c("free_throws_made"), c("free_throws_attempted")),
        "assist_rate": rate(c("assists"), c("field_goals_made")),
        "points_per_shot": rate(c("team_score"), c("field_goals_attempted")),
        "points_share_three": rate(3 * c("three_made"), c("team_score")),
        "points_share_free_throw": rate(c("free_throws_made"), c("team_score")),
        "block_rate": rate(c("blocks"), c("field_goals_attempted_opp") - c("three_attempted_opp")),
        "steal_rate": rate(c("steals"), c("possessions_opp")),
    }
    out = f.select("game_id", "team_id", "opponent_id", "season", "slate_date", "home_away", "margin", *[e.alias(n) for n, e in feats.items()])
    return out.withColumns({"net_efficiency": c("off_efficiency") - c("def_efficiency"),
                            "points_share_two": 1 - c("points_share_three") - c("points_share_free_throw")})


def prior_means(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], minimum: int = 1, order: Sequence[str] = ("slate_date", "game_id")) -> DataFrame:
    """Mean of each column over the earlier rows of its key: row values never enter.

    Uses segmented running sums, so a key with most of the rows is still many tasks.
    """
    sums = {}
    for c in columns:
        sums[f"__s_{c}"], sums[f"__n_{c}"] = F.col(c).cast("double"), F.when(F.col(c).isNotNull(), 1)
    run = G.running_before(frame, keys, order, sums, by_month(order[0]))
    means = {f"prior_{c}": F.when(F.col(f"__n_{c}") >= minimum, F.col(f"__s_{c}") / F.col(f"__n_{c}")) for c in columns}
    return run.withColumns(means).drop(*sums)


def collinearity(features: DataFrame, columns: Sequence[str], reference: str) -> DataFrame:
    """Correlation of every feature with a reference, strongest first."""
    one = features.agg(*[F.corr(F.col(c).cast("double"), F.col(reference).cast("double")).alias(c) for c in columns])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])))
    return long.orderBy(F.abs("correlation").desc_nulls_last(), "feature")


def net_rating(games: DataFrame) -> DataFrame:
    """Rows with shared possessions of the game and net points per 100."""
    f = with_opponent(games)
    poss = (F.col("possessions") + F.col("possessions_opp")) / 2.0
    return f.withColumn("game_possessions", poss).withColumn("net", 100.0 * F.col("margin") / F.col("game_possessions")).filter("game_possessions > 0")


def last_games(frame: DataFrame, n: int, key: str = "team_id") -> DataFrame:
    """The last n rows of each key; a top-n filter, cut before the shuffle too."""
    w = W.partitionBy(key).orderBy(F.col("slate_date").desc(), F.col("game_id").desc())
    return frame.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def form(games: DataFrame, ratings: DataFrame, n: int | None = FORM_GAMES, shrink: float = FORM_SHRINK, limit: float = FORM_CLAMP) -> DataFrame:
    """Mean residual net rating over the last games, shrunk and clamped.

    ``ratings``: team_id, offence, defence, and optionally home (net points at home).
    """
    rows = net_rating(games)
    rows = last_games(rows, n) if n is not None else rows
    own = ratings.select("team_id", F.col("offence").alias("o1"), F.col("defence").alias("d1"))
    other = ratings.select(F.col("team_id").alias("opponent_id"), F.col("offence").alias("o2"), F.col("defence").alias("d2"))
    joined = rows.join(own, "team_id", "left").join(other, "opponent_id", "left").na.fill(0.0, ["o1", "d1", "o2", "d2"])
    residual = F.col("net") - (F.col("o1") + F.col("d2") - F.col("o2") - F.col("d1"))
    out = joined.groupBy("team_id").agg(F.count("*").alias("games"), F.avg(residual).alias("mean"))
    return out.withColumn("form", P.clamp(F.col("mean") * F.col("games") / (F.col("games") + shrink), -limit, limit))


def pace_form(games: DataFrame, ratings: DataFrame, n: int = FORM_GAMES, shrink: float = 5.0, limit: float = 6.0) -> DataFrame:
    """Residual of shared possessions against the two tempo ratings, shrunk and clamped."""
    rows = last_games(net_rating(games), n)
    own = ratings.select("team_id", F.col("tempo").alias("t1"))
    other = ratings.select(F.col("team_id").alias("opponent_id"), F.col("tempo").alias("t2"))
    joined = rows.join(own, "team_id").join(other, "opponent_id")
    out = joined.groupBy("team_id").agg(F.count("*").alias("games"), F.avg(F.col("game_possessions") - (F.col("t1") + F.col("t2")) / 2.0).alias("mean"))
    return out.withColumn("pace", P.clamp(F.col("mean") * F.col("games") / (F.col("games") + shrink), -limit, limit))


def days_since_last(games: DataFrame, day: str) -> DataFrame:
    past = before(games, day)
    d = F.lit(day).cast("date")
    return past.groupBy("team_id").agg(F.datediff(d, F.max("slate_date")).alias("days"), F.datediff(d, F.min("slate_date")).alias("season_day"), F.count("*").alias("games"))


def rest_effects(games: DataFrame, tiers: DataFrame) -> DataFrame:
    """Effect of each rest bucket against ordinary rest, for the league and per tier.

    After the gap to the game before is known, only sums per season, team, side and
    bucket are kept; both demeanings and all effects follow from that small table.
    """
    rows = net_rating(games).select("game_id", "season", "team_id", "slate_date", "net", "venue_state", "home_away")
    gap = G.previous_row(rows, ["season", "team_id"], ["slate_date", "game_id"], {"__prev": F.col("slate_date")}, F.col("slate_date"))
    gap = gap.withColumn("bucket", C.rest_bucket(F.datediff("slate_date", "__prev"))).filter("bucket is not null")
    sums = gap.groupBy("season", "team_id", "venue_state", "home_away", "bucket").agg(F.sum("net").alias("s"), F.count("*").alias("n"))
    team = W.partitionBy("season", "team_id")
    side = W.partitionBy("venue_state", "home_away")
    sums = sums.withColumn("r", F.col("s") - F.col("n") * F.sum("s").over(team) / F.sum("n").over(team))
    sums = sums.withColumn("e", F.col("r") - F.col("n") * F.sum("r").over(side) / F.sum("n").over(side))
    work = sums.join(tiers.select("team_id", "tier"), "team_id", "left").withColumn("tier", F.coalesce("tier", F.lit("unplaced")))
    both = work.withColumn("scope", F.explode(F.array(F.lit("league"), F.col("tier")))).groupBy("scope", "bucket").agg(F.sum("e").alias("s"), F.sum("n").alias("n")).filter("scope <> 'unplaced'")
    # A handful of rows per scope from here on.
    scope = W.partitionBy("scope")
    ordinary = F.col("bucket") == C.REST_REFERENCE
    base = F.max(F.when(ordinary, F.col("s") / F.col("n"))).over(scope)
    held = F.max(F.when(ordinary, F.col("n"))).over(scope)
    out = both.withColumns({"base": F.coalesce(base, F.lit(0.0)), "held": F.coalesce(held, F.lit(0))}).filter(~ordinary)
    big = (F.col("scope") == "league") | ((F.col("held") >= REST_TIER_GAMES) & (F.col("n") >= REST_TIER_GAMES))
    raw = F.col("s") / F.col("n") - F.col("base")
    return out.filter(big).select("scope", "bucket", "n", P.clamp(raw * F.col("n") / (F.col("n") + REST_SHRINK), -REST_CLAMP, REST_CLAMP).alias("effect"))


def missing_rotation(players: DataFrame, games: DataFrame, missed: int = 1, by_minutes: bool = False) -> DataFrame:
    """Rotation players of the last games who did not play the latest ones, and the
    factor their share takes off the team's attack."""
    recent = last_games(games.select("team_id", "game_id", "slate_date"), ROTATION_WINDOW)
    rows = players.join(recent.select("team_id", "game_id", "recency"), ["team_id", "game_id"])
    on = ~F.col("did_not_play") & (F.col("minutes") > 0)
    rows = rows.withColumns({"__on": on, "__m": F.when(on, F.col("minutes")).otherwise(0.0), "__p": F.when(on, F.col("points")).otherwise(0)})
    per = rows.groupBy("team_id", "athlete_name").agg(
        F.count_if("__on").alias("appearances"), F.sum("__m").alias("minutes"), F.sum("__p").alias("points"),
        F.max(F.col("__on") & (F.col("recency") <= missed)).alias("played_last"))
    team = per.groupBy("team_id").agg(F.sum("points").alias("team_points"), F.sum("minutes").alias("team_minutes")).filter("team_points > 0")
    held = recent.groupBy("team_id").agg(F.count("*").alias("held")).filter(F.col("held") >= missed)
    out = per.filter((F.col("appearances") >= ROTATION_APPEARANCES) & (F.col("minutes") / F.col("appearances") >= ROTATION_MINUTES) & ~F.col("played_last"))
    out = out.join(team, "team_id").join(held.select("team_id"), "team_id", "left_semi")
    share = F.col("minutes") / F.col("team_minutes") if by_minutes else F.col("points") / F.col("team_points")
    return out.groupBy("team_id").agg(F.count("*").alias("missing"), F.sum(share).alias("share")).withColumn(
        "factor", F.greatest(F.lit(AVAILABILITY_FLOOR), 1.0 - AVAILABILITY_SHARE * F.col("share")))


def _luck(rows: DataFrame, excess: Column) -> DataFrame:
    out = rows.groupBy("team_id").agg(F.count("*").alias("games"), F.sum("game_possessions").alias("poss"), F.sum(excess).alias("excess"))
    out = out.filter((F.col("games") >= LUCK_GAMES) & (F.col("poss") > 0))
    return out.select("team_id", "games", P.clamp(LUCK_SHARE * 100.0 * F.col("excess") / F.col("poss"), -LUCK_CLAMP, LUCK_CLAMP).alias("luck"))


def _league(rows: DataFrame, **ratios: tuple[str, str]) -> DataFrame:
    return rows.agg(*[F.try_divide(F.sum(a), F.sum(b)).alias(n) for n, (a, b) in ratios.items()])


def three_point_luck(games: DataFrame) -> DataFrame:
    """Three-point points conceded above the league rate, per 100, halved and clamped."""
    rows = net_rating(games)
    league = _league(rows, rate3=("three_made", "three_attempted"))
    return _luck(rows.crossJoin(F.broadcast(league)), 3.0 * (F.col("three_made_opp") - F.col("rate3") * F.col("three_attempted_opp")))


def shooting_luck(games: DataFrame) -> DataFrame:
    """Own three-point and free-throw points above the league rates."""
    rows = net_rating(games)
    league = _league(rows, rate3=("three_made", "three_attempted"), rate1=("free_throws_made", "free_throws_attempted"))
    excess = 3.0 * (F.col("three_made") - F.col("rate3") * F.col("three_attempted")) + F.col("free_throws_made") - F.col("rate1") * F.col("free_throws_attempted")
    return _luck(rows.crossJoin(F.broadcast(league)), excess)


def shot_quality(games: DataFrame, zones: DataFrame) -> DataFrame:
    """Two-point points above the league rate of the same zones, own and allowed."""
    rows = net_rating(games).select("game_id", "team_id", "opponent_id", "game_possessions").join(zones, ["game_id", "team_id"])
    league = _league(rows, rim=("makes_rim", "attempts_rim"), mid=("makes_mid", "attempts_mid"))
    excess = sum((2.0 * F.col(f"makes_{z}") - 2.0 * F.col(z) * F.col(f"attempts_{z}") for z in ("rim", "mid")), F.lit(0.0))
    own = rows.crossJoin(F.broadcast(league)).select("game_id", "team_id", "opponent_id", "game_possessions", excess.alias("excess"))
    allowed = own.select("game_id", F.col("team_id").alias("opponent_id"), F.col("excess").alias("allowed"))
    joined = own.join(allowed, ["game_id", "opponent_id"], "left")
    out = joined.groupBy("team_id").agg(F.count("*").alias("games"), F.sum("game_possessions").alias("poss"), F.sum("excess").alias("e"), F.sum(F.coalesce("allowed", F.lit(0.0))).alias("a"))
    out = out.filter((F.col("games") >= LUCK_GAMES) & (F.col("poss") > 0))
    scaled = lambda c: P.clamp(LUCK_SHARE * 100.0 * F.col(c) / F.col("poss"), -LUCK_CLAMP, LUCK_CLAMP)
    return out.select("team_id", "games", scaled("e").alias("attack"), scaled("a").alias("defence"))


def four_factor_rows(games: DataFrame) -> DataFrame:
    """Numerators and denominators of the four factors per game."""
    c = F.col
    f = net_rating(games)
    out = f.select("game_id", "team_id", "opponent_id", "season", "slate_date", (c("field_goals_made") + 0.5 * c("three_made")).alias("fgm3"), c("field_goals_attempted").alias("fga"),
                   c("turnovers").alias("tov_n"), c("game_possessions").alias("poss"), c("offensive_rebounds").alias("orb_n"),
                   (c("offensive_rebounds") + c("defensive_rebounds_opp")).alias("orb_d"), c("free_throws_made").alias("ftm"), (100.0 * c("team_score") / c("game_possessions")).alias("ppp"))
    return out.filter("fga > 0 and poss > 0 and orb_d > 0")


def factor_rates(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    ratio = lambda a, b, n: F.try_divide(F.sum(a), F.sum(b)).alias(n)
    return rows.groupBy(*by).agg(ratio("fgm3", "fga", "efg"), ratio("tov_n", "poss", "tov"), ratio("orb_n", "orb_d", "orb"), ratio("ftm", "fga", "ftr"))


def resume(games: DataFrame, ratings: DataFrame, bubble_rank: int = 45, home_points: float = 3.0, margin_sd: float = 11.0) -> DataFrame:
    """Wins above a bubble team and luck, from ratings and the venue of each game."""
    nets = ratings.select("team_id", (F.col("offence") - F.col("defence")).alias("net"), "tempo")
    top = nets.orderBy(F.col("net").desc(), "team_id").limit(bubble_rank).agg(F.min("net").alias("bubble"))
    rows = games.select("game_id", "team_id", "opponent_id", "home_away", "neutral_site", "margin")
    rows = rows.join(nets.select("team_id", F.col("net").alias("n1"), F.col("tempo").alias("t1")), "team_id").join(
        nets.select(F.col("team_id").alias("opponent_id"), F.col("net").alias("n2"), F.col("tempo").alias("t2")), "opponent_id").crossJoin(F.broadcast(top))
    poss = (F.col("t1") + F.col("t2")) / 2.0
    sign = F.when(F.col("neutral_site"), 0.0).when(F.col("home_away") == "home", 1.0).otherwise(-1.0)
    site = sign * home_points * 100.0 / F.greatest(poss, F.lit(1.0))
    win = lambda n: P.normal_cdf((F.col(n) - F.col("n2") + site) * poss / 100.0 / margin_sd)
    out = rows.groupBy("team_id").agg(F.count("*").alias("games"), F.sum(win("bubble")).alias("bubble_wins"), F.sum(win("n1")).alias("own_wins"), F.count_if(F.col("margin") > 0).alias("wins"))
    g = F.col("games")
    shrunk = (F.col("wins") - F.col("own_wins")) / g * g / (g + 10.0)
    return out.withColumns({"wins_above_bubble": F.round(F.col("wins") - F.col("bubble_wins"), 2), "luck": F.when(g >= 5, P.clamp(0.5 * 10.0 * shrunk, -2.0, 2.0))})


def pythagorean(games: DataFrame, k: float = 8.0) -> DataFrame:
    """Expected share of wins from points, and luck: actual minus expected."""
    out = games.groupBy("season", "team_id").agg(
        F.sum("team_score").cast("double").alias("f"), F.sum("opponent_score").cast("double").alias("a"), F.avg((F.col("margin") > 0).cast("double")).alias("actual"), F.count("*").alias("games"))
    # (f/a)**k keeps the power small where f**k would overflow on long histories.
    expected = 1.0 / (1.0 + F.pow(F.col("a") / F.col("f"), k))
    return out.select("season", "team_id", "games", expected.alias("expected"), (F.col("actual") - expected).alias("luck"))


def decay_rises(daily: DataFrame, keys: Sequence[str], value: str, tolerance: float, month: str = "month") -> DataFrame:
    """Days on which a series that should fall rose by more than the tolerance."""
    stepped = G.previous_row(daily, keys, ["slate_date"], {"__before": F.col(value)}, F.trunc("slate_date", month))
    return stepped.filter(F.col(value) - F.col("__before") > tolerance).withColumn("rise", F.col(value) - F.col("__before")).drop("__before")
