"""Settlement: laws that hold on every game, and refusals with a reason."""

from pyspark.sql import functions as F

from closeline.operators import settle as X
from closeline.plans.views import Tables

SMALL = "/root/testdata/sf0.001"


def test_a_spread_at_minus_the_margin_pushes_on_every_game(spark):
    games = Tables(spark, SMALL).team_games
    asks = games.withColumns({"market": F.lit("spread"), "segment": F.lit("game"), "selection": F.col("home_away"), "line": -F.col("margin").cast("double")})
    assert [r[0] for r in X.settle_team(asks).select("settled").distinct().collect()] == ["push"]
    nudged = asks.withColumn("line", F.col("line") + 0.5)
    assert [r[0] for r in X.settle_team(nudged).select("settled").distinct().collect()] == ["won"]


def test_a_total_at_the_total_pushes_on_every_game(spark):
    games = Tables(spark, SMALL).team_games
    asks = games.withColumns({"market": F.lit("total_points"), "segment": F.lit("game"), "selection": F.lit("over"), "line": F.col("total").cast("double")})
    assert [r[0] for r in X.settle_team(asks).select("settled").distinct().collect()] == ["push"]


def ask(market, segment, selection, line, side="home", score=(80, 70), half=(40, 30)):
    return (market, segment, selection, line, side, *score, *half)


SCHEMA = "market string, segment string, selection string, line double, home_away string, team_score long, opponent_score long, team_score_h1 long, opponent_score_h1 long"


def test_team_cases(spark):
    rows = [
        ask("moneyline", "game", "home", None), ask("moneyline", "game", "home", None, score=(70, 70)), ask("moneyline_h1", "h1", "home", None, half=(30, 30)),
        ask("spread", "game", "away", 3.0), ask("spread", "game", "home", None), ask("team_total", "game", "home_over", 79.5), ask("total_points_h2", "h2", "under", 80.5),
        ask("spread_h2", "h2", "home", -0.5), ask("spread", "h1", "home", 1.0), ask("corners", "game", "home", 1.0), ask("total_points", "game", "draw", 1.0), ask("spread", "game", "home", 1.0, score=(None, 1))]
    got = [(r["settled"], r["note"]) for r in X.settle_team(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()]
    assert got == [
        ("won", None), ("unsettleable", "level where level cannot be"), ("push", None), ("unsettleable", "row is not the named side"), ("unsettleable", "no line"), ("won", None), ("won", None),
        ("lost", None), ("unsettleable", "wrong segment"), ("unsettleable", "not a wired market"), ("unsettleable", "selection names no direction"), ("unsettleable", "no score")]


def test_a_missing_stat_is_not_a_loss(spark):
    schema = "market string, segment string, selection string, line double, did_not_play boolean, points long, rebounds long, assists long, steals long, blocks long"
    rows = [
        ("player_points", "game", "over", 9.5, False, 10, 1, 1, 1, 1), ("player_points", "game", "over", 9.5, False, None, 1, 1, 1, 1), ("player_points", "game", "over", 9.5, True, 0, 0, 0, 0, 0),
        ("player_points", "game", "under", 10.0, False, 10, 1, 1, 1, 1), ("player_double_double", "game", "over", 0.5, False, 10, 11, 0, 0, 0), ("player_double_double", "game", "over", 0.5, False, 10, 11, None, 0, 0),
        ("player_triple_double", "game", "over", 0.5, False, 10, 11, 9, 0, 0), ("player_pra", "game", "over", 20.5, False, 10, 6, 5, 0, 0), ("player_points", "game", "over", 9.5, None, 10, 1, 1, 1, 1)]
    got = [(r["settled"], r["note"]) for r in X.settle_player(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == [("won", None), ("unsettleable", "stat not recorded"), ("void", "did not play"), ("push", None), ("won", None), ("unsettleable", "stat not recorded"), ("lost", None), ("won", None), ("unsettleable", "no player row")]


def test_grading_follows_the_teams_not_the_labels(spark):
    """Team 1 won 80 to 70. The provider filed event 2 the other way round, event 3 on another game, event 4 nowhere."""
    games = spark.createDataFrame([(1, 1, "home", 80, 70, 40, 30), (1, 2, "away", 70, 80, 30, 40)], "game_id long, team_id long, home_away string, team_score long, opponent_score long, team_score_h1 long, opponent_score_h1 long")
    events = spark.createDataFrame([(1, 1, False, 1, 2), (2, 1, True, 2, 1), (3, 1, False, 7, 2), (4, None, None, 8, 9), (5, 1, True, None, 1), (6, 1, False, 1, None)], "event_id long, game_id long, flipped boolean, home_id long, away_id long")
    asks = [("moneyline", "game", "home", None), ("spread", "game", "away", 5.5), ("team_total", "game", "home_over", 75.5), ("team_total_h1", "h1", "away_under", 35.5), ("total_points", "game", "over", 149.5)]
    quotes = spark.createDataFrame([(e, *a, 100.0) for e in range(1, 8) for a in asks], "event_id long, market string, segment string, selection string, line double, american_odds double")
    got = {(r["event_id"], r["market"]): (r["settled"], r["note"], r["orientation"]) for r in X.grade_against_games(quotes, games, events=events).collect()}
    of = lambda e: [got[e, a[0]][0] for a in asks]
    assert of(1) == ["won", "lost", "won", "won", "won"]
    assert of(2) == ["lost", "won", "lost", "lost", "won"] and got[2, "spread"][2] == "flipped"
    assert got[3, "moneyline"][:2] == ("unsettleable", "row is another team's") and got[3, "spread"][0] == "lost" and got[3, "total_points"][0] == "won"
    assert {got[e, a[0]] for e in (4, 7) for a in asks} == {("unsettleable", "event not placed", "refused")}
    assert of(5) == ["lost", "won", "lost", "lost", "won"] and of(6) == of(1)


def test_a_joined_row_of_another_team_is_refused(spark):
    rows = [("spread", "game", "home", 1.0, "home", 80, 70, 40, 30, 5, 5), ("spread", "game", "home", 1.0, "home", 80, 70, 40, 30, 6, 5), ("spread", "game", "home", 1.0, "home", 80, 70, 40, 30, None, 5),
            ("spread", "game", "home", 1.0, "away", 80, 70, 40, 30, 5, 5), ("spread", "game", "home", 1.0, "away", 80, 70, 40, 30, 5, None)]
    got = [r["note"] for r in X.settle_team(spark.createDataFrame(rows, SCHEMA + ", team_id long, expected_team_id long").coalesce(1)).collect()]
    assert got == [None, "row is another team's", "row names no team", None, "row is not the named side"]


def test_the_stat_of_a_wager_is_worked_out_once(spark):
    rows = spark.createDataFrame([("player_points", "game", "over", 9.5, False, 12)], "market string, segment string, selection string, line double, did_not_play boolean, points long")
    out = X.settle_player(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("= player_points)") == 1
    assert [(r["settled"], r["actual_value"], r["note"]) for r in out.collect()] == [("won", 12.0, None)]
