"""Settlement: one wager against the row of its game or player.

A fixed table maps each market to the quantity it settles on; each quantity is one
expression. Unknown is never a loss: what cannot be graded says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from closeline.functions import prices as P, text as T

# Market, segment, quantity, whether level is a push.
TEAM_MARKETS = (
    ("moneyline", "game", "game_margin", False),
    ("spread", "game", "game_margin", True),
    ("alternate_spread", "game", "game_margin", True),
    ("total_points", "game", "game_total", True),
    ("alternate_total_points", "game", "game_total", True),
    ("team_total", "game", "team_score", True),
    ("alternate_team_total", "game", "team_score", True),
    ("moneyline_h1", "h1", "half_margin", True),
    ("spread_h1", "h1", "half_margin", True),
    ("total_points_h1", "h1", "half_total", True),
    ("team_total_h1", "h1", "half_team_score", True),
    ("moneyline_h2", "h2", "half_margin", True),
    ("spread_h2", "h2", "half_margin", True),
    ("total_points_h2", "h2", "half_total", True),
    ("team_total_h2", "h2", "half_team_score", True),
)
# Player market and the sum of columns it settles on.
PLAYER_STATS = {
    "player_points": ("points",),
    "player_rebounds": ("rebounds",),
    "player_assists": ("assists",),
    "player_threes": ("three_made",),
    "player_blocks": ("blocks",),
    "player_steals": ("steals",),
    "player_turnovers": ("turnovers",),
    "player_field_goals": ("field_goals_made",),
    "player_frees_made": ("free_throws_made",),
    "player_frees_attempts": ("free_throws_attempted",),
    "player_pra": ("points", "rebounds", "assists"),
    "player_points_rebounds": ("points", "rebounds"),
    "player_points_assists": ("points", "assists"),
    "player_rebounds_assists": ("rebounds", "assists"),
    "player_blocks_steals": ("blocks", "steals"),
}
DOUBLE_FIGURES = {"player_double_double": 2, "player_triple_double": 3}
DOUBLE_COLUMNS = ("points", "rebounds", "assists", "steals", "blocks")
FIRST_BASKET = ("player_first_basket", "player_first_team_basket")
NO_LINE_MARKETS = ("moneyline", "moneyline_h1", "moneyline_h2")


def markets(spark: SparkSession) -> DataFrame:
    """The registry as a table: market, segment, quantity, push."""
    rows = [*TEAM_MARKETS,
            *[(m, "game", "player_stat", True) for m in PLAYER_STATS],
            *[(m, "game", "double_figures", False) for m in DOUBLE_FIGURES],
            *[(m, "game", m.removeprefix("player_"), False) for m in FIRST_BASKET]]
    return spark.createDataFrame(rows, "market string, market_segment string, quantity string, push boolean")


def _graded(adjusted: Column, push: Column, positive_wins: Column | None = None) -> Column:
    """Outcome from the signed distance to the line."""
    won = F.when(adjusted > 0, "won").when(adjusted < 0, "lost")
    return F.when(adjusted.isNull(), "unsettleable").when(adjusted == 0, F.when(push, "push").otherwise("unsettleable")).otherwise(won)


def _side() -> Column:
    s = F.col("selection")
    return F.when(s.startswith("home"), "home").when(s.startswith("away"), "away")


def _direction() -> Column:
    s = F.col("selection")
    return F.when(s.endswith("over"), 1.0).when(s.endswith("under"), -1.0)


def _own_row(cols: set[str]) -> Column:
    """Why the joined row isn't that of the side the selection names; null if it is.

    The price provider's home and the schedule's are two vocabularies: on neutral ground
    they often differ. So a known ``expected_team_id`` (the provider's team on the named
    side) decides alone; only where it is missing does the label, turned round for an event
    that the schedule files the other way (``flipped``).
    """
    side = _side()
    if "flipped" in cols:
        side = F.when(F.col("flipped"), F.when(side == "home", "away").when(side == "away", "home")).otherwise(side)
    by_label = F.when(~F.coalesce(F.col("home_away") == side, F.lit(False)), "row is not the named side")
    if "expected_team_id" not in cols:
        return by_label
    by_team = F.when(F.col("team_id").isNull(), "row names no team").when(F.col("team_id") != F.col("expected_team_id"), "row is another team's")
    return F.when(F.col("expected_team_id").isNotNull(), by_team).otherwise(by_label)


def settle_team(asks: DataFrame) -> DataFrame:
    """Grade team wagers joined to a side's row of the game.

    Needs market, segment, selection, line and home_away, team_score, opponent_score,
    team_score_h1, opponent_score_h1; optional are expected_team_id with team_id, flipped,
    and orientation (``orient``). Adds outcome, actual and note.
    """
    table = asks.join(F.broadcast(markets(asks.sparkSession).filter(~F.col("market").startswith("player_"))), "market", "left")
    q, line = F.col("quantity"), P.number("line")
    half = lambda c: F.when(F.col("market_segment") == "h1", F.col(f"{c}_h1")).when(F.col("market_segment") == "h2", F.col(c) - F.col(f"{c}_h1"))
    team = F.when(q.startswith("half"), half("team_score")).otherwise(F.col("team_score"))
    other = F.when(q.startswith("half"), half("opponent_score")).otherwise(F.col("opponent_score"))
    kind = F.when(q.endswith("margin"), "margin").when(q.endswith("total"), "total").when(q.endswith("team_score"), "score")
    actual = F.when(kind == "margin", team - other).when(kind == "total", team + other).when(kind == "score", team).cast("double")
    handicap = F.when(F.col("market").isin(*NO_LINE_MARKETS), F.lit(0.0)).otherwise(line)
    adjusted = F.when(kind == "margin", actual + handicap).otherwise((actual - line) * _direction())
    own_row = _own_row(set(asks.columns))
    refused = F.col("orientation") == "refused" if "orientation" in asks.columns else F.lit(False)
    note = (
        F.when(q.isNull(), "not a wired market")
        .when(F.coalesce(F.col("segment"), F.lit("")) != F.col("market_segment"), "wrong segment")
        .when((kind != "total") & _side().isNull(), "selection names no side")
        .when((kind != "margin") & _direction().isNull(), "selection names no direction")
        .when(refused, "event not placed")
        .when((kind != "total") & own_row.isNotNull(), own_row)
        .when(F.when(kind == "margin", handicap).otherwise(line).isNull(), "no line")
        .when(actual.isNull(), "no score")
        .when((adjusted == 0) & ~F.col("push"), "level where level cannot be")
    )
    graded = F.when(note.isNotNull(), "unsettleable").otherwise(_graded(adjusted, F.col("push")))
    return table.select(*asks.columns, graded.alias("settled"), F.when(graded != "unsettleable", actual).alias("actual_value"), note.alias("note"))


def settle_player(asks: DataFrame) -> DataFrame:
    """Grade player wagers joined to the player's row of the game.

    Needs market, segment, selection, line, did_not_play, the stat columns; for first
    baskets also athlete_id, team_id, home_away and the game's first scorers.
    """
    cols = set(asks.columns)
    line, d = P.number("line"), _direction()
    stat = F.lit(None).cast("double")
    for market, parts in PLAYER_STATS.items():
        if set(parts) <= cols:
            stat = F.when(F.col("market") == market, sum((F.col(p) for p in parts[1:]), F.col(parts[0])).cast("double")).otherwise(stat)
    if set(DOUBLE_COLUMNS) <= cols:
        complete = F.col(DOUBLE_COLUMNS[0]).isNotNull()
        for c in DOUBLE_COLUMNS[1:]:
            complete = complete & F.col(c).isNotNull()
        tens = sum((F.when(F.col(c) >= 10, 1).otherwise(0) for c in DOUBLE_COLUMNS), F.lit(0))
        for market, needed in DOUBLE_FIGURES.items():
            stat = F.when(F.col("market") == market, F.when(complete, (tens >= needed).cast("double"))).otherwise(stat)
    if "first_basket_athlete_id" in cols:
        game_first = (F.col("athlete_id") == F.col("first_basket_athlete_id")).cast("double")
        own = F.when(F.col("home_away") == "home", F.col("home_first_basket_athlete_id")).otherwise(F.col("away_first_basket_athlete_id"))
        same_team = F.col("team_id") == F.col("first_basket_team_id")
        contradiction = same_team & (own != F.col("first_basket_athlete_id"))
        team_first = F.when(own.isNotNull(), F.when(~F.coalesce(contradiction, F.lit(False)), (F.col("athlete_id") == own).cast("double"))).when(same_team, game_first)
        stat = F.when(F.col("market") == FIRST_BASKET[0], game_first).when(F.col("market") == FIRST_BASKET[1], team_first).otherwise(stat)
    known = F.col("market").isin(*PLAYER_STATS, *DOUBLE_FIGURES, *FIRST_BASKET)
    push = F.col("market").isin(*PLAYER_STATS)
    # In steps: each is used several times, and written out in full they make too long a method.
    staged = asks.withColumns({"__line": line, "__turn": d, "__stat": stat})
    line, d, stat = F.col("__line"), F.col("__turn"), F.col("__stat")
    staged = staged.withColumn("__adjusted", (stat - line) * d)
    adjusted = F.col("__adjusted")
    staged = staged.withColumn("__note", (
        F.when(~known, "not a wired market").when(F.coalesce(F.col("segment"), F.lit("")) != "game", "wrong segment")
        .when(F.col("did_not_play").isNull(), "no player row")
        .when(F.col("did_not_play"), "did not play")
        .when(d.isNull(), "not over or under").when(line.isNull(), "no line").when(stat.isNull(), "stat not recorded")
        .when((adjusted == 0) & ~push, "level where level cannot be")
    ))
    note = F.col("__note")
    graded = staged.withColumn("__settled", F.when(note == "did not play", "void").when(note.isNotNull(), "unsettleable").otherwise(_graded(adjusted, push)))
    settled = F.col("__settled")
    return graded.select(*asks.columns, settled.alias("settled"), F.when(~settled.isin("unsettleable", "void"), stat).alias("actual_value"), note.alias("note"))


def orient(quotes: DataFrame, events: DataFrame) -> DataFrame:
    """Quotes with their event's place on the schedule.

    ``events`` (event_id, game_id, flipped, home_id, away_id: ``schedules.resolve_fixtures``
    with the provider's teams) adds game_id, flipped, expected_team_id (the provider's team
    on the side the selection names, null for totals and unknown teams) and orientation:
    as filed, flipped, or refused where no one game fits.
    """
    placed = events.select("event_id", "game_id", "flipped", F.col("home_id").alias("__home"), F.col("away_id").alias("__away"))
    orientation = F.when(F.col("game_id").isNull() | F.col("flipped").isNull(), "refused").when(F.col("flipped"), "flipped").otherwise("as filed")
    expected = F.when(_side() == "home", F.col("__home")).when(_side() == "away", F.col("__away"))
    return quotes.join(placed, "event_id", "left").withColumns({"expected_team_id": expected, "orientation": orientation}).drop("__home", "__away")


def grade_against_games(quotes: DataFrame, games: DataFrame, profit: bool = True, events: DataFrame | None = None) -> DataFrame:
    """Join team wagers to the row of their side (home row for totals), grade, price.

    The quotes meet only the columns grading needs, on the game and the side. With
    ``events`` each quote goes to the game its event was placed on, to the side that the
    schedule gives the provider's team; orientation and expected_team_id stay in the result.
    """
    side = F.coalesce(_side(), F.lit("home"))
    scores = ["team_score", "opponent_score", "team_score_h1", "opponent_score_h1"]
    if events is None:
        need = games.select(F.col("game_id").alias("event_id"), "home_away", *scores)
        joined = quotes.withColumn("home_away", side).join(need, ["event_id", "home_away"], "left")
        graded = settle_team(joined).drop("home_away", *scores)
    else:
        oriented = orient(quotes, events).withColumn("home_away", F.when(F.col("flipped"), F.when(side == "home", "away").otherwise("home")).otherwise(side))
        joined = oriented.join(games.select("game_id", "home_away", "team_id", *scores), ["game_id", "home_away"], "left")
        graded = settle_team(joined).drop("home_away", "team_id", "flipped", *scores)
    return graded.withColumn("settled_profit", P.profit_units("settled", "american_odds")) if profit else graded


def grade_pick() -> Column:
    """win, loss or push of a published pick against the final score."""
    pick, line = F.col("pick"), F.coalesce(P.number("line"), F.lit(0.0))
    home, away = F.col("home_score"), F.col("away_score")
    margin = F.when(pick == "home", home - away + line).when(pick == "away", away - home + line).when(
        pick == "over", home + away - line).when(pick == "under", line - home - away)
    return F.when(margin > 0, "win").when(margin < 0, "loss").when(margin == 0, "push")
