"""Quote, capture, name and accounting operators on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from closeline import plans, pricers
from closeline.operators import captures as M, ledger as L, names as N, players as R, plays as Y, quotes as Q, schedules as D

QUOTE = "captured_at date, slate_date date, commence_time date, event_id long, market string, segment string, player string, selection string, line double, book string, american_odds double"


def quote(day, event=1, market="spread", selection="home", line=-2.5, book="a", odds=-110.0, start=20):
    return (date(2024, 1, day), date(2024, 1, day), date(2024, 1, start), event, market, "game", "", selection, line, book, odds)


def test_survival_has_three_values(spark):
    rows = [quote(1), quote(1, odds=-115.0), quote(1, event=2), quote(2), quote(2, event=1, odds=-120.0), quote(3, event=2)]
    out = {(r["captured_at"].day): (r["survived"], r["gone"], r["unknown"], r["rate"]) for r in M.survival(spark.createDataFrame(rows, QUOTE)).collect()}
    assert out == {1: (1, 1, 1, 0.5), 2: (0, 0, 2, None)}


def board_rows(day, fair_book_odds, best=None):
    rows = []
    for book, (a, b) in fair_book_odds.items():
        rows += [quote(day, selection="home", line=-2.5, book=book, odds=a), quote(day, selection="away", line=2.5, book=book, odds=b)]
    return rows


def test_fair_board_needs_three_books_and_pairs_handicaps(spark):
    three = {"a": (-110.0, -110.0), "b": (-110.0, -110.0), "c": (130.0, -150.0)}
    board = Q.fair_board(spark.createDataFrame(board_rows(1, three) + board_rows(2, {k: three[k] for k in "ab"}), QUOTE))
    rows = {r["selection"]: r for r in board.collect()}
    assert board.count() == 2 and rows["home"]["pair_line"] == rows["away"]["pair_line"] == -2.5
    assert rows["home"]["best_book"] == "c" and rows["home"]["best_decimal"] == pytest.approx(2.3) and rows["home"]["books"] == 3
    assert rows["home"]["fair"] + rows["away"]["fair"] == pytest.approx(1.0)


def test_alerts_are_new_since_the_capture_before(spark):
    even = {"a": (-110.0, -110.0), "b": (-110.0, -110.0), "d": (-110.0, -110.0)}
    long = {**even, "c": (150.0, -180.0)}
    both = spark.createDataFrame(board_rows(1, long) + board_rows(2, long), QUOTE)
    fresh = spark.createDataFrame(board_rows(1, even) + board_rows(2, long), QUOTE)
    for store, expected in ((both, 0), (fresh, 1)):
        board = Q.fair_board(store)
        assert Q.alerts(board, Q.shops(board)).count() == expected


def test_devig_refuses_by_reason(spark):
    rows = [quote(1), quote(1, selection="away", line=2.5, odds=-105.0), quote(1, event=2), quote(1, event=3), quote(1, event=3, book="b"), quote(1, event=4, odds=200.0), quote(1, event=4, selection="away", line=2.5, odds=150.0),
            quote(1, event=5, selection="draw"), quote(1, event=6, odds=0.0)]
    out = Q.devig(spark.createDataFrame(rows, QUOTE), power=True)
    got = {(r["event_id"], r["refusal"]): r["n"] for r in out.groupBy("event_id", "refusal").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, ""): 2, (2, "no complement"): 1, (3, "not two sided"): 2, (4, "overround not above one"): 2, (5, "unknown selection"): 1, (6, "unreadable price"): 1}
    fair = [r for r in out.filter("event_id = 1").collect()]
    assert sum(r["market_implied"] for r in fair) == pytest.approx(1.0) and sum(r["fair_power"] for r in fair) == pytest.approx(1.0)


def test_best_price_ignores_spelling_and_breaks_ties_by_order(spark):
    schema = "slate_date string, event_id long, market string, segment string, player string, selection string, line double, book string, american_odds double, pos long"
    rows = [("d", 1, "m", "game", "Ann", "over", 1.0, "a", 110.0, 1), ("d", 1, "m", "game", "ANN ", "over", 1.0, "b", 110.0, 2), ("d", 1, "m", "game", "Ann", "over", 1.0, "c", None, 3)]
    frame = spark.createDataFrame(rows, schema)
    best = Q.best_price_per_wager(frame, "pos").collect()
    assert len(best) == 1 and best[0]["book"] == "a"
    assert Q.dedupe_prices(frame, "pos").count() == 3
    with pytest.raises(Exception, match="more than one window"):
        Q.one_bet_per_wager(frame.withColumn("phase", F.col("book")), "pos", "phase").collect()


def test_dominated_rungs(spark):
    rows = [quote(1, market="total_points", selection="over", line=140.5, odds=120.0), quote(1, market="total_points", selection="over", line=141.5, odds=110.0), quote(1, market="total_points", selection="over", line=142.5, odds=130.0),
            quote(1, selection="home", line=3.5, odds=-105.0), quote(1, selection="home", line=2.5, odds=-110.0)]
    out = {(r["market"], r["line"], r["easier_line"]) for r in Q.dominated_quotes(spark.createDataFrame(rows, QUOTE)).collect()}
    assert out == {("total_points", 141.5, 140.5), ("spread", 2.5, 3.5)}


def test_exposure_caps(spark):
    schema = "slate_date string, event_id long, market string, segment string, player string, selection string, line double, edge double, bar string"
    rows = [("d", e, "m", "game", "", "home", float(k), 0.1 * e + 0.01 * k, "") for e in range(5) for k in range(3)] + [("d", 9, "m", "game", "", "home", 0.0, 9.0, "no_opinion")]
    out = Q.exposure_caps(spark.createDataFrame(rows, schema), 1, 3).orderBy("slate_rank").collect()
    assert [(r["event_id"], r["line"]) for r in out] == [(4, 2.0), (3, 2.0), (2, 2.0)]


def test_names_resolve_to_one_id_or_refuse(spark):
    named = spark.createDataFrame([(1, "Michigan State"), (2, "Michigan"), (3, "Saint Mary's"), (4, "Miami"), (5, "Miami")], "id long, name string")
    asks = spark.createDataFrame([(1, "Michigan St."), (2, "MICHIGAN"), (3, "St. Mary's University"), (4, "Miami"), (5, "Nowhere")], "k long, spelled string")
    out = {r["k"]: (r["resolution"], r["resolved_id"]) for r in N.resolve(asks, "k", "spelled", N.alias_index(named, "name", "id")).collect()}
    assert out == {1: ("one", 1), 2: ("one", 2), 3: ("one", 3), 4: ("many", None), 5: ("none", None)}


def test_possession_ends(spark):
    rows = [(1, 1, 10, "MadeFreeThrow", True, 1), (1, 2, 10, "MadeFreeThrow", True, 1), (1, 3, 11, "MissedFreeThrow", False, 1), (1, 4, 10, "Defensive Rebound", False, 0), (1, 5, 10, "JumpShot", True, 2), (1, 6, 11, "JumpShot", False, 2), (2, 1, 11, "Lost Ball Turnover", False, 0)]
    frame = spark.createDataFrame(rows, "game_id long, play_no long, team_id long, type_text string, scoring_play boolean, score_value int")
    out = {(r["game_id"], r["play_no"]): r["ends"] for r in Y.with_possession_ends(frame).collect()}
    assert [k for k, v in sorted(out.items()) if v] == [(1, 2), (1, 4), (1, 5), (2, 1)]
    numbers = {(r["game_id"], r["play_no"]): r["possession"] for r in Y.possession_numbers(frame).collect()}
    assert numbers[(1, 6)] == 3 and numbers[(1, 1)] == 0


def test_unzoned_shots_stop_the_job(spark):
    frame = spark.createDataFrame([(1, "HookShot", True, False, 2)], "game_id long, type_text string, shooting_play boolean, scoring_play boolean, score_value int")
    with pytest.raises(Exception, match="without a zone"):
        Y.attempts(frame).collect()


def test_tiers_and_unplaced_teams(spark):
    rows = [(g, 2024, "d", 1, 2, 1, 2, 80, 60, "STATUS_FINAL") for g in range(9)] + [(100, 2024, "d", 3, 2, 3, 2, 70, 60, "STATUS_FINAL")]
    frame = spark.createDataFrame(rows, "game_id long, season int, slate_date string, home_id long, away_id long, home_conference_id long, away_conference_id long, home_score long, away_score long, status_name string")
    out = {r["team_id"]: r["tier"] for r in D.tier_table(frame).collect()}
    assert out == {1: "high_major", 2: "low_major", 3: "unplaced"}


def test_walk_forward_stamp_is_enforced(spark):
    bad = spark.createDataFrame([("2024-01-02", "2024-01-02")], "slate_date string, priced_through string")
    with pytest.raises(Exception, match="priced through its own day"):
        L.assert_walk_forward(bad).collect()
    assert L.assert_walk_forward(bad.withColumn("priced_through", F.lit("2024-01-01"))).count() == 1


def test_pricer_arguments_are_checked(spark):
    with pytest.raises(KeyError):
        pricers.resolve("nobody")
    with pytest.raises(TypeError, match="does not take"):
        pricers.walk_forward(None, None, pricers.resolve("base_rate"), players=None)


def test_replication_states(spark):
    cols = "market string, tier string, roi double, bets long, verdict string"
    claims = spark.createDataFrame([("a", "t", 0.1, 9000, "demonstrated edge"), ("b", "t", 0.0, 9000, "no demonstrated edge"), ("c", "t", 0.1, 9000, "demonstrated edge"), ("d", "t", -0.1, 9000, "demonstrated deficit"), ("e", "t", 0.1, 9, "demonstrated edge")], cols)
    held = spark.createDataFrame([("a", "t", 0.2, 3000, "demonstrated edge"), ("b", "t", 0.2, 3000, "demonstrated edge"), ("c", "t", 0.0, 3000, "no demonstrated edge"), ("d", "t", 0.2, 3000, "demonstrated edge"), ("x", "t", 0.2, 3000, "demonstrated edge")], cols).withColumn("season", F.lit(2024))
    out = {r["market"]: r["state"] for r in L.replication(claims, held).collect()}
    assert out == {"a": "replicated", "b": "nothing to replicate", "c": "did not replicate", "d": "reversed", "e": "untestable"}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_dealt_by_market(spark):
    rows = spark.createDataFrame([quote(1), quote(2, market="chess")], QUOTE).withColumns({"home_team": F.lit("A"), "away_team": F.lit("B")})
    out = Q.refusal_reason(rows, spark.createDataFrame([("spread",), ("moneyline",)], "market string"))
    assert "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" in _plan(out)
    assert {r["market"]: r["refusal"] for r in out.collect()} == {"spread": "", "chess": "unknown market"}


def test_tiers_of_a_survivor_are_asked_in_one_pass(spark):
    rows = [(*quote(1), "high"), (*quote(1), "low"), (*quote(1, odds=-115.0), "low"), (*quote(2), "mid"), (*quote(1, event=2), "low")]
    out = M.survival(spark.createDataFrame(rows, QUOTE + ", tier string"), ["tier"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_set(") == 1
    assert {r["tier"]: (r["survived"], r["gone"], r["unknown"]) for r in out.filter("captured_at = date '2024-01-01'").collect()} == {"high": (1, 0, 0), "low": (1, 1, 1)}


def test_labels_come_from_one_join_on_the_identity(spark):
    store = spark.createDataFrame([quote(1), quote(2), quote(3, odds=120.0), quote(1, event=2, odds=105.0)], QUOTE)
    bets = spark.createDataFrame([quote(1), quote(2), quote(3, odds=120.0), quote(1, event=2, odds=105.0), quote(1, odds=400.0)], QUOTE).withColumn("captured_at", F.when((F.col("american_odds") > -200) & (F.col("captured_at") != F.lit("2024-01-01")), F.col("captured_at")))
    out = M.label_bets(bets, store)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4  # identity, market, and the stamps with their months
    got = sorted((r["event_id"], r["american_odds"], str(r["captured_at"]), r["reachability"]) for r in out.collect())
    assert got == [("1", "-110", "2024-01-01", "survived"), ("1", "-110", "2024-01-02", "gone"), ("1", "120", "2024-01-03", "unknown"), ("1", "400", "None", "unknown"), ("2", "105", "2024-01-01", "unknown")]


def test_main_team_does_not_depend_on_the_order_of_rows(spark):
    # Equal minutes whose plain sums differ by the order they come in: the higher id has the smaller sum.
    a, b, c = minutes = [29 * 0.8, 11 * 0.8, 7 * 0.8]
    rows = [(2020, team, 1, False, m, date(2020, 1, 1)) for team, ms in ((9, minutes), (1, minutes[::-1])) for m in ms]
    assert (a + b) + c < (c + b) + a
    frame = spark.createDataFrame(rows, "season int, team_id int, athlete_id int, did_not_play boolean, minutes double, slate_date date").coalesce(1)
    assert R.main_team(R.roster_totals(frame)).first().main_team == 9
    odd = frame.withColumn("minutes", F.when(F.col("team_id") == 1, F.lit(2.0 ** 70)).otherwise(F.lit(float("nan"))))
    assert {r.team_id: str(r.minutes) for r in R.roster_totals(odd).collect()} == {9: "nan", 1: str(3 * 2.0 ** 70)}


def test_ladders_are_made_of_the_quotes_alone(spark):
    plan = _plan(plans.queries()["prop_population"](spark, "/root/testdata/sf0.001"))
    assert "percentile" not in plan and plan.count("FileScan parquet") == 3


def test_a_rung_is_placed_by_its_exact_median(spark):
    # Rung 1.5 has the prices 0.5, 0.5 and 0.8 and an unreadable one; 2.5 the median of 0.4 and 0.7; 3.5 no price.
    odds = [(1.5, 100.0), (1.5, 100.0), (1.5, -400.0), (1.5, None), (2.5, 150.0), (2.5, -700.0 / 3), (3.5, None)]
    rows = [(1, "points", "A", "over", line, o) for line, o in odds]
    frame = spark.createDataFrame(rows, "event_id int, market string, player string, selection string, line double, american_odds double")
    steps = {r["__line"]: r.rungs for r in Q.ladder_steps(frame).collect()}
    assert steps == {1.5: 0.0, 2.5: 1.0, 3.5: 2.0}
    assert Q.rungs_from_the_money(frame).filter("rungs_from_the_money is null").count() == 0
