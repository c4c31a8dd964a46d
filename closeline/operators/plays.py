"""Play-by-play: shots, zones, possessions, first baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from closeline.functions import text as T
from closeline.operators import segments as G

# Floor geometry in feet, labels, limits.
HOOP_X, BASELINE_X, ON_FLOOR = 41.75, 47.0, 1000.0
ARC, CORNER_Y, DEEP, RIM, SHORT = 22.146, 21.0, 26.0, 4.0, 6.0
RIM_TYPES = ("LayUpShot", "DunkShot", "TipShot")
FREE_THROWS = ("madefreethrow", "missedfreethrow")
ZONES = ("rim", "mid", "three")
FLOOR_ZONES = ("rim", "short_paint", "mid_range", "corner_three", "above_break_three", "deep_three")
RANK_ATTEMPTS = 25
PLAY_RANGE = 1 << 16


def is_free_throw(c: str = "type_text") -> Column:
    return T.letters_key(c).isin(*FREE_THROWS)


def is_made_goal() -> Column:
    return F.coalesce("scoring_play", F.lit(False)) & (F.coalesce("score_value", F.lit(0)) > 0) & ~is_free_throw()


def _segment() -> Column:
    return F.floor(F.col("play_no") / PLAY_RANGE)


def with_possession_ends(plays: DataFrame) -> DataFrame:
    """Add ``ends``: made goal, defensive rebound, turnover, last made free throw of a trip."""
    marked = G.next_row(plays, ["game_id"], ["play_no"], {"__nft": is_free_throw(), "__nteam": F.col("team_id")}, _segment())
    text = F.lower(F.coalesce("type_text", F.lit("")))
    same_trip = F.coalesce(F.col("__nft") & (F.col("__nteam") == F.col("team_id")), F.lit(False))
    last_free = is_free_throw() & F.coalesce("scoring_play", F.lit(False)) & ~same_trip
    ends = is_made_goal() | text.contains("defensive rebound") | text.contains("turnover") | last_free
    return marked.withColumn("ends", ends).drop("__nft", "__nteam")


def possession_numbers(plays: DataFrame) -> DataFrame:
    """Number of possessions that ended before each play of its game."""
    marked = with_possession_ends(plays)
    return G.running_before(marked, ["game_id"], ["play_no"], {"possession": F.col("ends").cast("int")}, [_segment()])


def zone_label() -> Column:
    t = F.coalesce("type_text", F.lit(""))
    return F.when(F.col("score_value") == 3, "three").when(t.isin(*RIM_TYPES), "rim").when(t == "JumpShot", "mid")


def attempts(plays: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Field goal attempts with a zone; the job fails when over 1% have none."""
    shots = plays.filter(F.coalesce("shooting_play", F.lit(False)) & ~is_free_throw()).withColumn("zone", zone_label()).withColumn("made", F.coalesce("scoring_play", F.lit(False)))
    share = shots.agg(F.avg(F.col("zone").isNull().cast("int")).alias("__share"))
    checked = shots.crossJoin(F.broadcast(share))
    return checked.filter(F.when(F.coalesce("__share", F.lit(0.0)) <= tolerance, True).otherwise(F.raise_error(F.lit("too many shots without a zone")))).drop("__share")


def team_game_zones(plays: DataFrame) -> DataFrame:
    """Attempts and makes by zone per game and team, own and allowed.

    Zones are counted with conditional sums, and both sides of a game are brought
    together by one more aggregate on the game, so there is no self-join.
    """
    shots = attempts(plays)
    sums = [F.count_if(F.col("zone") == z).alias(f"attempts_{z}") for z in ZONES] + [F.count_if((F.col("zone") == z) & F.col("made")).alias(f"makes_{z}") for z in ZONES]
    wide = shots.groupBy("game_id", "team_id").agg(*sums)
    names = [c for c in wide.columns if c not in ("game_id", "team_id")]
    row = F.struct("team_id", *names)
    pair = wide.groupBy("game_id").agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count("*").alias("n")).filter("n = 2")
    side = lambda x, y: F.struct(F.col(f"{x}.team_id").alias("team_id"), *[F.col(f"{x}.{c}").alias(c) for c in names], *[F.col(f"{y}.{c}").alias(f"{c}_allowed") for c in names])
    out = pair.select("game_id", F.inline(F.array(side("a", "b"), side("b", "a"))))
    fga = F.col("attempts_rim") + F.col("attempts_mid") + F.col("attempts_three")
    makes = F.col("makes_rim") + F.col("makes_mid") + F.col("makes_three")
    out = out.withColumn("fga", fga)
    rates = {f"{z}_rate": F.try_divide(F.col(f"attempts_{z}"), F.col("fga")) for z in ZONES}
    rates["efg_pct"] = F.try_divide(makes + 0.5 * F.col("makes_three"), F.col("fga"))
    return out.withColumns(rates)


def on_floor() -> Column:
    return (F.abs("coordinate_x") <= ON_FLOOR) & (F.abs("coordinate_y") <= ON_FLOOR)


def geometry(shots: DataFrame) -> DataFrame:
    """Coordinates turned to one basket, distance and floor zone."""
    home = F.col("team_id") == F.col("home_team_id")
    turn = lambda c: F.when(home, F.col(c)).otherwise(-F.col(c))
    out = shots.filter(on_floor()).withColumns({
        "offense_id": F.col("team_id"), "defense_id": F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")),
        "x": turn("coordinate_x"), "y": turn("coordinate_y"),
        "points": F.when(F.coalesce("scoring_play", F.lit(False)), F.col("score_value")).otherwise(0).cast("double")})
    out = out.withColumns({"baseline_feet": BASELINE_X - F.col("x"), "distance": F.hypot(HOOP_X - F.col("x"), F.col("y"))})
    return out.withColumn("floor_zone", floor_zone())


def floor_zone() -> Column:
    d, side = F.col("distance"), F.abs("y")
    beyond = d >= ARC
    return (
        F.when(beyond & (side >= CORNER_Y), "corner_three").when(beyond & (d < DEEP), "above_break_three").when(beyond, "deep_three")
        .when(d <= RIM, "rim").when(d <= SHORT, "short_paint").otherwise("mid_range")
    )


def geometry_agreement(shots: DataFrame) -> DataFrame:
    implied = F.when(F.col("distance") >= ARC, 3).otherwise(2)
    use = shots.filter(F.col("score_value").isin(2, 3))
    return use.agg(F.count("*").alias("attempts"), F.count_if(implied == F.col("score_value")).alias("agree"), F.avg((implied == F.col("score_value")).cast("double")).alias("share"))


def zone_baseline(shots: DataFrame) -> DataFrame:
    """Share of attempts and points per attempt by floor zone."""
    per = shots.groupBy("floor_zone").agg(F.count("*").alias("attempts"), F.sum("points").alias("points"))
    total = shots.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("floor_zone", "attempts", (F.col("attempts") / F.col("total")).alias("share"), (F.col("points") / F.col("attempts")).alias("points_per_attempt"))


def zone_profile(shots: DataFrame, side: str = "offense", minimum: int = RANK_ATTEMPTS) -> DataFrame:
    """Attempts, share and points per attempt of each team by zone, with its rank among
    the teams that have enough attempts; the best attack and the best defence are 1."""
    team = f"{side}_id"
    per = shots.groupBy(team, "floor_zone").agg(F.count("*").alias("attempts"), F.sum("points").alias("points"))
    total = shots.groupBy(team).agg(F.count("*").alias("total"))
    ppa = F.col("points") / F.col("attempts")
    rows = per.join(total, team).withColumns({"share": F.col("attempts") / F.col("total"), "points_per_attempt": ppa, "ranked": F.when(F.col("attempts") >= minimum, ppa)})
    out = G.ranked(rows, ["floor_zone"], "ranked", descending=side == "offense")
    return out.select(F.col(team).alias("team_id"), "floor_zone", "attempts", "share", "points_per_attempt", "rank", "field")


def charted_share(plays: DataFrame, schedule: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """Scheduled games with at least one shot on the floor."""
    charted = plays.filter(F.coalesce("shooting_play", F.lit(False))).groupBy("game_id").agg(F.bool_or(on_floor()).alias("charted"))
    joined = schedule.join(charted, "game_id", "left")
    return joined.groupBy(*by).agg(F.count("*").alias("games"), F.count_if("charted").alias("charted")).withColumn("share", F.col("charted") / F.col("games"))


def attribution_census(plays: DataFrame) -> DataFrame:
    shots = plays.filter(F.coalesce("shooting_play", F.lit(False)))
    own = F.col("team_id") == F.col("home_team_id")
    return shots.agg(F.count("*").alias("shots"), F.count_if(own).alias("home"), F.count_if(F.col("team_id") == F.col("away_team_id")).alias("away"),
                     F.count_if(~F.coalesce(own | (F.col("team_id") == F.col("away_team_id")), F.lit(False))).alias("neither"))


def game_segments(plays: DataFrame) -> DataFrame:
    """Periods, first-half scores and first scorers, all as ordered aggregates.

    The running score of a side is the sum of its made points up to the end of the first
    period. First scorers keep a null id: unattributed is not the next one.
    """
    made = is_made_goal()
    home = F.col("team_id") == F.col("home_team_id")
    points = F.when(F.coalesce("scoring_play", F.lit(False)), F.col("score_value")).otherwise(0)
    half = F.col("period_number") == 1
    first = lambda cond: F.min_by(F.struct(F.col("athlete_id").alias("athlete"), F.col("team_id").alias("team")), F.when(made & cond, F.col("play_no")))
    out = plays.groupBy("game_id").agg(
        F.max("period_number").alias("periods"), F.sum(F.when(half & home, points).otherwise(0)).alias("home_score_h1"), F.sum(F.when(half & ~home, points).otherwise(0)).alias("away_score_h1"),
        first(F.lit(True)).alias("f"), first(home).alias("h"), first(~home).alias("a"))
    return out.select("game_id", "periods", (F.col("periods") > 2).alias("overtime"), "home_score_h1", "away_score_h1", F.col("f.athlete").alias("first_basket_athlete_id"),
                      F.col("f.team").alias("first_basket_team_id"), F.col("h.athlete").alias("home_first_basket_athlete_id"), F.col("a.athlete").alias("away_first_basket_athlete_id"))


def possession_validation(estimated: DataFrame, plays: DataFrame) -> DataFrame:
    """Estimated possessions against counted ends, per game and team."""
    counted = with_possession_ends(plays).groupBy("game_id").agg(F.count_if("ends").alias("counted"))
    rows = estimated.join(counted, "game_id").withColumn("gap", F.col("estimated") - F.col("counted"))
    median = G.exact_quantiles(rows.select(F.round("gap", 6).alias("gap")), [], "gap", [0.5], "median_gap")
    return rows.agg(
        F.count("*").alias("games"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd_gap"),
        F.corr("estimated", F.col("counted").cast("double")).alias("correlation")).crossJoin(F.broadcast(median))
