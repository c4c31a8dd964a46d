"""Nested payloads to tables: quotes, box scores, line scores, rating tables.

Everything is ``from_json`` with a declared schema and ``inline``/``explode``; nothing
is parsed in Python, and a payload never leaves the task that read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from closeline.functions import prices as P, text as T, times as C
from closeline.operators import settle as X

QUOTE_SCHEMA = (
    "id string, commence_time string, home_team string, away_team string, bookmakers array<struct<key: string, title: string, "
    "markets: array<struct<key: string, outcomes: array<struct<name: string, description: string, price: string, point: string>>>>>>"
)
LINESCORE_SCHEMA = "array<struct<value: double, period: int>>"
BOX_SCHEMA = (
    "struct<teams: array<struct<team: struct<id: string, displayName: string>, homeAway: string, statistics: array<struct<name: string, displayValue: string>>>>, "
    "players: array<struct<team: struct<id: string>, statistics: array<struct<names: array<string>, labels: array<string>, "
    "athletes: array<struct<athlete: struct<id: string, displayName: string>, starter: boolean, didNotPlay: boolean, stats: array<string>>>>>>>>"
)
SCORED_PERIODS = "array<struct<value: double, displayValue: string, period: int>>"
_STATE = "struct<type: struct<name: string, completed: boolean>>"
SCOREBOARD_SCHEMA = (
    f"struct<events: array<struct<id: string, date: string, status: {_STATE}, competitions: array<struct<neutralSite: boolean, status: {_STATE}, competitors: array<struct<"
    f"homeAway: string, score: string, winner: boolean, team: struct<id: string, displayName: string>, linescores: {SCORED_PERIODS}>>>>>>>"
)
POWER_SCHEMA = (
    "struct<categories: array<struct<name: string, names: array<string>>>, teams: array<struct<team: struct<id: string, displayName: string>, "
    "categories: array<struct<name: string, values: array<double>>>>>>"
)

# Provider key of each market (player markets also have "_alternate").
TEAM_KEYS = {
    "moneyline": ("h2h",),
    "spread": ("spreads",),
    "total_points": ("totals",),
    "team_total": ("team_totals",),
    "alternate_spread": ("alternate_spreads",),
    "alternate_total_points": ("alternate_totals",),
    "alternate_team_total": ("alternate_team_totals",),
    "moneyline_h1": ("h2h_h1",),
    "spread_h1": ("spreads_h1", "alternate_spreads_h1"),
    "total_points_h1": ("totals_h1", "alternate_totals_h1"),
    "team_total_h1": ("team_totals_h1", "alternate_team_totals_h1"),
    "moneyline_h2": ("h2h_h2",),
    "spread_h2": ("spreads_h2", "alternate_spreads_h2"),
    "total_points_h2": ("totals_h2", "alternate_totals_h2"),
    "team_total_h2": ("team_totals_h2", "alternate_team_totals_h2"),
}
PLAYER_KEYS = {"player_pra": "player_points_rebounds_assists"}
NO_ALTERNATE = ("player_field_goals", "player_frees_made", "player_frees_attempts", "player_blocks_steals",
                "player_double_double", "player_triple_double", "player_first_basket", "player_first_team_basket")
YES_NO = ("player_double_double", "player_triple_double", "player_first_basket", "player_first_team_basket")
EFFICIENCY_RANGE, TEMPO_RANGE = (85.0, 125.0), (55.0, 80.0)


def provider_keys(spark: SparkSession) -> DataFrame:
    """The registry by provider key: provider_key, market, segment, rule."""
    registry = {m: (seg, q) for m, seg, q, _ in X.TEAM_MARKETS}
    rows = []
    for market, keys in TEAM_KEYS.items():
        segment, quantity = registry[market]
        rule = "team_total" if quantity.endswith("team_score") else "total" if quantity.endswith("total") else "side"
        rows += [(k, market, segment, rule) for k in keys]
    for market in (*X.PLAYER_STATS, *X.DOUBLE_FIGURES, *X.FIRST_BASKET):
        key = PLAYER_KEYS.get(market, market)
        rule = "yes_no" if market in YES_NO else "player"
        rows.append((key, market, "game", rule))
        if market not in NO_ALTERNATE:
            rows.append((f"{key}_alternate", market, "game", rule))
    return spark.createDataFrame(rows, "provider_key string, market string, segment string, rule string")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Saved payload files, one JSON document per line or file."""
    return spark.read.schema(QUOTE_SCHEMA).json(path)


def parse_payloads(frame: DataFrame, column: str = "payload") -> DataFrame:
    return frame.select(F.from_json(column, QUOTE_SCHEMA).alias("p")).select("p.*")


def _markets(payloads: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per market of each book; what an event or a book says is cleaned before its rows are made."""
    e = T.clean_text
    event = ["event_id", "commence_time", "home_team", "away_team", "slate_date", "__placeable", *carry]
    # Outer explodes with filters after them: else the optimizer parses the document again for each.
    cleaned = payloads.select(e("id").alias("event_id"), e("commence_time").alias("commence_time"), e("home_team").alias("home_team"), e("away_team").alias("away_team"), *carry, "bookmakers")
    placeable = (F.col("event_id") != "") & (F.col("commence_time") != "") & (F.col("home_team") != "") & (F.col("away_team") != "")
    cleaned = cleaned.withColumns({"slate_date": C.slate_date(F.col("commence_time").try_cast("timestamp")), "__placeable": placeable})
    books = cleaned.select(*event, F.explode_outer("bookmakers").alias("b"))
    book = F.when(e("b.key") != "", e("b.key")).otherwise(e("b.title"))
    blocks = books.select(*event, book.alias("book"), F.explode_outer("b.markets").alias("m"))
    return blocks.select(*event, "book", e("m.key").alias("provider_key"), F.col("m.outcomes").alias("outcomes"))


def outcomes(payloads: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per outcome of each market of each book."""
    rows = _markets(payloads, carry).withColumn("o", F.explode_outer("outcomes"))
    return rows.filter("o is not null").select("event_id", "commence_time", "home_team", "away_team", *carry, "book", "provider_key", "o.*")


def classify_outcomes(payloads: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Outcomes with market, selection, line, price and the first refusal ('' = staged)."""
    markets = _markets(payloads, carry).join(F.broadcast(provider_keys(payloads.sparkSession)), "provider_key", "left")
    rows = markets.withColumn("o", F.explode_outer("outcomes")).filter("o is not null")
    rows = rows.withColumns({"__name": T.clean_text("o.name"), "__of": T.clean_text("o.description")})
    word = F.lower("__name")
    over = F.when(word.isin("over", "o"), "over").when(word.isin("under", "u"), "under")
    side = lambda c: F.when(F.col(c) == F.col("home_team"), "home").when(F.col(c) == F.col("away_team"), "away")
    rule = F.col("rule")
    selection = (
        F.when(rule == "side", F.when(F.col("__name") != "", side("__name")))
        .when(rule.isin("player", "total"), over)
        .when(rule == "team_total", F.concat(side("__of"), F.lit("_"), over))
        .when(rule == "yes_no", F.when(word == "yes", "over").when(word == "no", "under"))
    )
    point = F.when(rule == "yes_no", F.lit(0.5)).otherwise(P.number("o.point"))
    # Generated, not projected: a filter on the refusal would else work all of it out a second time.
    said = F.struct(F.when(rule.isin("player", "yes_no"), F.col("__of")).otherwise("").alias("player"), selection.alias("selection"), point.alias("line"), P.number("o.price").alias("american_odds"))
    staged = rows.withColumn("s", F.explode(F.array(said))).select(
        *carry, "event_id", "commence_time", "slate_date", "home_team", "away_team", "market", "segment", "s.player", "s.selection", "s.line", "s.american_odds", "book", "provider_key", "__placeable")
    refusal = (
        F.when(~F.col("__placeable"), "unplaceable event").when(F.col("market").isNull(), "unwired market").when(F.col("selection").isNull(), "unknown selection")
        .when(F.col("american_odds").isNull() | (F.abs("american_odds") < 100), "unreadable price").otherwise("")
    )
    return staged.withColumn("refusal", refusal).drop("__placeable")


def stage(payloads: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The thirteen-column board of staged outcomes, with carried columns in front."""
    return classify_outcomes(payloads, carry).filter("refusal = ''").drop("refusal")


def staging_counts(payloads: DataFrame) -> DataFrame:
    return classify_outcomes(payloads).groupBy("refusal").agg(F.count("*").alias("outcomes"))


def stage_capture(payloads: DataFrame, captured_at: Column) -> DataFrame:
    return stage(payloads).withColumn("captured_at", captured_at)


def key_census(payloads: DataFrame) -> DataFrame:
    """Rows and distinct books per provider key."""
    return outcomes(payloads).filter("provider_key <> ''").groupBy("provider_key").agg(
        F.count("*").alias("rows"), F.countDistinct(F.when(F.col("book") != "", F.col("book"))).alias("books"))


def line_scores(cell: Column) -> Column:
    """Period scores from JSON text, or from any text that spells ``'value': n``."""
    parsed = F.transform(F.from_json(cell, LINESCORE_SCHEMA), lambda s: s["value"])
    matched = F.transform(F.regexp_extract_all(cell, F.lit(r"'value':\s*([0-9.]+)"), F.lit(1)), lambda v: v.cast("double"))
    return F.when(cell.startswith("[{\""), parsed).otherwise(matched)


def schedule_segments(schedule: DataFrame, home: str = "home_linescores", away: str = "away_linescores") -> DataFrame:
    """Periods and first-half scores out of schedule line scores; under two periods drops."""
    rows = schedule.select("game_id", line_scores(F.col(home)).alias("h"), line_scores(F.col(away)).alias("a"))
    rows = rows.withColumn("periods", F.least(F.size("h"), F.size("a"))).filter("periods >= 2")
    return rows.select("game_id", "periods", (F.col("periods") > 2).alias("overtime"), F.col("h")[0].alias("home_score_h1"), F.col("a")[0].alias("away_score_h1"))


def made_attempted(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "-")
    return F.try_element_at(parts, F.lit(1)).try_cast("long"), F.try_element_at(parts, F.lit(2)).try_cast("long")


# Statistic labels of a box score.
PLAYER_LABELS = {"MIN": "minutes", "PTS": "points", "REB": "rebounds", "AST": "assists", "STL": "steals", "BLK": "blocks", "TO": "turnovers"}
TEAM_LABELS = {"totalRebounds": "rebounds", "offensiveRebounds": "offensive_rebounds", "defensiveRebounds": "defensive_rebounds", "assists": "assists", "steals": "steals", "blocks": "blocks",
               "turnovers": "turnovers", "fouls": "fouls"}
TEAM_SPLITS = {"fieldGoalsMade-fieldGoalsAttempted": "field_goals", "threePointFieldGoalsMade-threePointFieldGoalsAttempted": "three", "freeThrowsMade-freeThrowsAttempted": "free_throws"}
SPLIT_LABELS = {"FG": "field_goals", "3PT": "three", "FT": "free_throws"}


def _labelled(labels: Column, values: Column, label: str) -> Column:
    at = F.array_position(labels, label)
    return F.when(at > 0, F.try_element_at(values, at.cast("int")))


def box_players(frame: DataFrame, column: str = "boxscore") -> DataFrame:
    """Player rows of box-score JSON: one per athlete of each team block."""
    box = frame.select("game_id", F.from_json(column, BOX_SCHEMA).alias("b"))
    teams = box.select("game_id", F.explode("b.players").alias("t"))
    groups = teams.select("game_id", F.col("t.team.id").try_cast("long").alias("team_id"), F.explode("t.statistics").alias("g"))
    rows = groups.select("game_id", "team_id", F.coalesce("g.names", "g.labels").alias("labels"), F.explode("g.athletes").alias("a"))
    cols = [_labelled(F.col("labels"), F.col("a.stats"), k).try_cast("double").alias(v) for k, v in PLAYER_LABELS.items()]
    for label, stem in SPLIT_LABELS.items():
        made, tried = made_attempted(_labelled(F.col("labels"), F.col("a.stats"), label))
        cols += [made.alias(f"{stem}_made"), tried.alias(f"{stem}_attempted")]
    return rows.select("game_id", "team_id", F.col("a.athlete.id").try_cast("long").alias("athlete_id"), F.col("a.athlete.displayName").alias("athlete_name"),
                       F.coalesce("a.starter", F.lit(False)).alias("starter"), F.coalesce("a.didNotPlay", F.lit(False)).alias("did_not_play"), *cols)


def box_teams(frame: DataFrame, column: str = "boxscore") -> DataFrame:
    """Team rows of box-score JSON, statistics by name; each beside its opponent's id."""
    box = frame.select("game_id", F.from_json(column, BOX_SCHEMA).alias("b"))
    ids = F.transform("b.teams", lambda t: t["team"]["id"].try_cast("long"))
    teams = box.select("game_id", ids.alias("ids"), F.explode("b.teams").alias("t"))
    named = F.map_from_entries(F.transform("t.statistics", lambda s: F.struct(s["name"], s["displayValue"])))
    team = F.col("t.team.id").try_cast("long")
    rows = teams.select("game_id", team.alias("team_id"), F.filter("ids", lambda i: i != team).alias("others"), F.col("t.homeAway").alias("home_away"), named.alias("s"))
    cols = []
    for label, stem in TEAM_SPLITS.items():
        made, tried = made_attempted(F.try_element_at("s", F.lit(label)))
        cols += [made.alias(f"{stem}_made"), tried.alias(f"{stem}_attempted")]
    cols += [F.try_element_at("s", F.lit(k)).try_cast("long").alias(v) for k, v in TEAM_LABELS.items()]
    return rows.select("game_id", "team_id", F.when(F.size("others") == 1, F.col("others")[0]).alias("opponent_id"), "home_away", *cols)


def completed_games(frame: DataFrame, column: str = "payload") -> DataFrame:
    """Finished games of scoreboard JSON, one document a day: game_id, home and away.

    The state of the competition counts, or else that of the event; a game needs exactly
    one home and one away side.
    """
    events = frame.select(F.explode(F.from_json(column, SCOREBOARD_SCHEMA)["events"]).alias("e"))
    rows = events.select(F.col("e.id").try_cast("long").alias("game_id"), F.try_element_at("e.competitions", F.lit(1)).alias("c"), F.col("e.status").alias("s"))
    done = F.coalesce("c.status.type.completed", "s.type.completed", F.lit(False))
    side = lambda name: F.filter("c.competitors", lambda x: x["homeAway"] == name)
    both = rows.filter(done & (F.size("c.competitors") == 2)).select("game_id", side("home").alias("h"), side("away").alias("a"))
    return both.filter((F.size("h") == 1) & (F.size("a") == 1)).select("game_id", F.col("h")[0].alias("home"), F.col("a")[0].alias("away"))


def _scores(side: str) -> Column:
    return F.transform(F.coalesce(f"{side}.linescores", F.array().cast(SCORED_PERIODS)), lambda x: F.coalesce(x["value"], x["displayValue"].try_cast("double")))


def scoreboard_segments(games: DataFrame) -> DataFrame:
    """Periods played and first-half scores; null where a side has no line score."""
    n = F.least(F.size(_scores("home")), F.size(_scores("away")))
    known = n > 0
    return games.select("game_id", F.when(known, n).alias("periods"), F.when(known, n > 2).alias("overtime"),
                        *[F.when(known, F.try_element_at(_scores(s), F.lit(1))).alias(f"{s}_score_h1") for s in ("home", "away")])


def scoreboard_periods(games: DataFrame) -> DataFrame:
    """One row per game, side and period: the score in it, and the running score up to its end."""
    sides = games.select("game_id", F.explode(F.array(*[F.struct(F.lit(s).alias("home_away"), F.col(f"{s}.team.id").try_cast("long").alias("team_id"), _scores(s).alias("scores")) for s in ("home", "away")])).alias("x"))
    rows = sides.select("game_id", "x.home_away", "x.team_id", "x.scores", F.posexplode("x.scores").alias("at", "score"))
    upto = F.aggregate(F.slice("scores", 1, F.col("at") + 1), F.lit(0.0), lambda a, v: a + v)
    return rows.select("game_id", "home_away", "team_id", (F.col("at") + 1).alias("period"), "score", upto.alias("score_so_far"))


def recognise_columns(table: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Which column holds team, offence, defence, tempo, told by what its values are.

    One aggregate over the table; its single row decides. Text with nearly one value
    per row is the team, numbers in a range are efficiencies or tempo.
    """
    parts = [F.count("*").alias("n")]
    for c in columns:
        v = P.number(F.trim(F.col(c)))
        parts += [F.count(v).alias(f"{c}__num"), F.avg(v).alias(f"{c}__mean"), F.approx_count_distinct(F.trim(F.col(c)), 0.01).alias(f"{c}__kinds")]
    row = table.agg(*parts).first()
    n = max(row["n"], 1)
    numeric = {c: row[f"{c}__num"] / n for c in columns}
    team = next((c for c in columns if numeric[c] < 0.2 and row[f"{c}__kinds"] >= 0.85 * n), None)
    inside = lambda c, r: numeric[c] > 0.9 and r[0] <= row[f"{c}__mean"] <= r[1]
    efficiency = [c for c in columns if inside(c, EFFICIENCY_RANGE)]
    tempo = [c for c in columns if inside(c, TEMPO_RANGE)]
    if team is None or len(efficiency) < 2 or not tempo:
        raise ValueError("the table's columns cannot be told apart")
    return {"team": team, "adj_off": efficiency[0], "adj_def": efficiency[1], "tempo": tempo[0]}


def rating_table(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Team, offence, defence and tempo of a table without a header; odd rows drop."""
    at = recognise_columns(table, columns)
    out = table.select(F.trim(at["team"]).alias("team"), *[P.number(F.trim(F.col(at[k]))).alias(k) for k in ("adj_off", "adj_def", "tempo")])
    wide = lambda c, r, by: F.col(c).between(r[0] - by, r[1] + by)
    return out.filter((F.col("team") != "") & wide("adj_off", EFFICIENCY_RANGE, 15) & wide("adj_def", EFFICIENCY_RANGE, 15) & wide("tempo", TEMPO_RANGE, 10))


def power_index(frame: DataFrame, column: str = "payload", possessions: float = 70.0) -> DataFrame:
    """Team ratings out of power-index JSON: points per game become points per 100."""
    doc = frame.select(F.from_json(column, POWER_SCHEMA).alias("d"))
    names = F.filter("d.categories", lambda c: c["name"] == "bpi")[0]["names"]
    rows = doc.select(names.alias("names"), F.explode("d.teams").alias("t"))
    values = F.filter("t.categories", lambda c: c["name"] == "bpi")[0]["values"]
    rows = rows.select("names", "t.team", values.alias("v"))
    off, de = _labelled(F.col("names"), F.col("v"), "bpioffense"), _labelled(F.col("names"), F.col("v"), "bpidefense")
    out = rows.select(F.col("team.displayName").alias("team"), F.col("team.id").try_cast("long").alias("team_id"), (100.0 + off * 100.0 / possessions).alias("adj_off"), (100.0 - de * 100.0 / possessions).alias("adj_def"))
    return out.filter("team_id is not null and adj_off is not null and adj_def is not null")
