"""Writes: what is appended once stays once."""

import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F, types as T

from closeline.sources import payloads as J, rebuild as B, stores as S

SCHEMA = T.StructType([
    T.StructField("slate_date", T.DateType()), T.StructField("captured_at", T.DateType()), T.StructField("event_id", T.LongType()), T.StructField("market", T.StringType()),
    T.StructField("segment", T.StringType()), T.StructField("player", T.StringType()), T.StructField("selection", T.StringType()), T.StructField("line", T.DoubleType()),
    T.StructField("book", T.StringType()), T.StructField("american_odds", T.DoubleType())])


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def quote(day=1, capture=1, event=1, line=2.5, odds=110.0, book="b"):
    return (date(2024, 1, day), date(2024, 1, capture), event, "spread", "game", "", "home", line, book, odds)


def test_append_is_idempotent(spark, folder):
    path = f"{folder}/captures"
    batch = spark.createDataFrame([quote(), quote(), quote(odds=115.0)], SCHEMA)
    assert S.append_capture(batch, path, SCHEMA) == 2
    assert S.append_capture(batch, path, SCHEMA) == 0
    assert S.append_capture(spark.createDataFrame([quote(), quote(day=2, capture=2)], SCHEMA), path, SCHEMA) == 1
    assert S.read_store(spark, path, SCHEMA).count() == 3


def test_a_frozen_row_is_never_priced_again(spark):
    day = lambda d: d.withColumnRenamed("slate_date", "snapshot_date")
    frozen = day(spark.createDataFrame([quote()], SCHEMA))
    later = day(spark.createDataFrame([quote(odds=300.0), quote(event=2), quote(event=2, book="c", odds=105.0)], SCHEMA))
    out = S.freeze(later, frozen).collect()
    assert [(r["event_id"], r["american_odds"]) for r in out] == [(2, 105.0)]


def test_undeclared_data_stops_the_read(spark):
    schema = T.StructType(SCHEMA.fields[:3])
    frame = spark.createDataFrame([quote()], SCHEMA).select("slate_date", "event_id", F.lit(None).cast("string").alias("empty"))
    out = S.declared(frame, schema)
    assert out.columns == ["slate_date", "captured_at", "event_id"] and out.first()["captured_at"] is None
    with pytest.raises(Exception, match="undeclared column stray"):
        S.declared(frame.withColumn("stray", F.lit("x")), schema).collect()


def test_seasons_that_shrink_are_refused(spark, folder):
    big = spark.range(100).select(F.col("id").alias("game_id"), F.lit(2024).alias("season"))
    assert S.build_processed({"games": big}, folder) == {"games": {2024: "written"}}
    small = big.limit(10).unionByName(big.withColumn("season", F.lit(2025)))
    assert S.build_processed({"games": small}, folder)["games"] == {2024: "refused: shrank", 2025: "written"}
    assert S.load_season(spark, folder, "games", 2024, ["game_id"]).count() == 100
    with pytest.raises(FileNotFoundError):
        S.load_season(spark, folder, "games", 2030)
    plan = S.load_season(spark, folder, "games", 2024, ["game_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "ReadSchema: struct<game_id:bigint>" in plan


def test_version_verdicts(spark):
    new = spark.createDataFrame([("f", 1, 100, "a"), ("f", 2, 40, "b"), ("f", 3, 60, "c"), ("f", 4, 5, "d")], "feed string, season int, rows long, content string")
    old = spark.createDataFrame([("f", 1, 100, "a"), ("f", 2, 100, "x"), ("f", 3, 100, "y")], "feed string, season int, rows long, content string")
    got = {r["season"]: (r["verdict"], r["restated"]) for r in S.judge_version(new, old).collect()}
    assert got == {1: ("unchanged", False), 2: ("refused: shrank", False), 3: ("accepted", True), 4: ("accepted", False)}


PAYLOAD = """{"id": "e1", "commence_time": "2025-01-02T01:00:00Z", "home_team": "A", "away_team": "B", "bookmakers": [{"key": "bk", "markets": [
 {"key": "h2h", "outcomes": [{"name": "A", "price": -120}, {"name": "Draw", "price": 200}, {"name": "B", "price": "x"}]},
 {"key": "team_totals", "outcomes": [{"name": "Over", "description": "B", "price": 105, "point": 70.5}]},
 {"key": "player_double_double", "outcomes": [{"name": "Yes", "description": "P. One", "price": 240}]},
 {"key": "corners", "outcomes": [{"name": "A", "price": 100}]}]}]}""".replace("\n", " ")


def test_staging_accounts_for_every_outcome(spark):
    rows = J.parse_payloads(spark.createDataFrame([(PAYLOAD,), ('{"id": "", "bookmakers": [{"key": "b", "markets": [{"key": "h2h", "outcomes": [{"name": "A"}]}]}]}',)], "payload string"))
    counts = {r["refusal"]: r["outcomes"] for r in J.staging_counts(rows).collect()}
    assert counts == {"": 3, "unknown selection": 1, "unreadable price": 1, "unwired market": 1, "unplaceable event": 1}
    staged = {r["market"]: r for r in J.stage(rows).collect()}
    assert staged["moneyline"]["slate_date"] == date(2025, 1, 1) and staged["team_total"]["selection"] == "away_over"
    assert (staged["player_double_double"]["player"], staged["player_double_double"]["line"]) == ("P. One", 0.5)
    assert len(J.stage(rows).columns) == 13


def test_scoreboard_games_need_two_sides_and_an_end(spark):
    side = lambda where, team, *v: '{"homeAway": "%s", "team": {"id": "%s"}, "linescores": [%s]}' % (where, team, ", ".join(v))
    game = lambda i, sides, inner='"status": {"type": {"completed": true}}, ', outer="": '{"id": "%s", %s"competitions": [{%s"competitors": [%s]}]}' % (i, outer, inner, ", ".join(sides))
    two = [side("away", 8, '{"value": 31.0, "period": 1}', '{"displayValue": "40"}', '{"value": 9}'), side("home", 7, '{"value": 30.0}', '{"value": 41.0}', '{"value": 5}')]
    games = [game(1, two), game(2, two, inner='"status": {"type": {"completed": false}}, '), game(3, two[:1]), game(4, [two[0], two[0]]), game(5, two, inner="", outer='"status": {"type": {"completed": true}}, '),
             game(6, [side("home", 1), side("away", 2, '{"value": 3}')]), game(7, two, inner="")]
    day = '{"events": [%s]}' % ", ".join(games)
    rows = J.completed_games(spark.createDataFrame([(day,), ("not json",), (None,), ('{"events": []}',)], "payload string"))
    seg = {r["game_id"]: tuple(r)[1:] for r in J.scoreboard_segments(rows).collect()}
    assert seg == {1: (3, True, 30.0, 31.0), 5: (3, True, 30.0, 31.0), 6: (None, None, None, None)}
    per = sorted(tuple(r) for r in J.scoreboard_periods(rows).filter("game_id = 1").collect())
    assert per == [(1, "away", 8, 1, 31.0, 31.0), (1, "away", 8, 2, 40.0, 71.0), (1, "away", 8, 3, 9.0, 80.0), (1, "home", 7, 1, 30.0, 30.0), (1, "home", 7, 2, 41.0, 71.0), (1, "home", 7, 3, 5.0, 76.0)]
    assert J.scoreboard_periods(rows).filter("game_id = 6").count() == 1


def test_box_teams_split_made_and_attempted(spark):
    doc = '{"teams": [{"team": {"id": "7"}, "homeAway": "home", "statistics": [{"name": "fieldGoalsMade-fieldGoalsAttempted", "displayValue": "21-70"}, {"name": "turnovers", "displayValue": "9"}]}]}'
    row = J.box_teams(spark.createDataFrame([(1, doc)], "game_id long, boxscore string")).first()
    assert (row["team_id"], row["field_goals_made"], row["field_goals_attempted"], row["turnovers"], row["rebounds"]) == (7, 21, 70, 9, None)


KEYS = ("event_id", "market", "player", "selection", "line", "book")


def wave(spark, *rows):
    return lambda: spark.createDataFrame([quote(event=e, odds=o) for e, o in rows], SCHEMA)


def held(spark, root):
    return sorted((r["part"], r["event_id"], r["american_odds"]) for r in B.read(spark, root).collect())


def test_a_rebuild_goes_on_where_it_stopped(spark, folder):
    """Killed in its second segment and started again it gives the store of a run that was not."""
    import glob
    import os

    stop = f"{folder}/stop"
    open(stop, "w").close()

    def second():
        @F.udf("double")
        def fails(x):
            if x > 100 and os.path.exists(stop):
                raise RuntimeError("executor lost")
            return x

        rows = wave(spark, (3, 120.0), (4, 130.0))()
        return rows.withColumn("american_odds", fails("american_odds"))

    segments = {"a": wave(spark, (1, 110.0), (1, 105.0), (2, 110.0)), "b": second, "c": wave(spark, (5, 110.0))}
    with pytest.raises(Exception, match="executor lost"):
        B.rebuild(spark, f"{folder}/s", "v1", segments, KEYS, ["american_odds"])
    with pytest.raises(FileNotFoundError):
        B.read(spark, f"{folder}/s")
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/s/versions/v1/a/*")}
    os.remove(stop)
    calls = []
    counted = {n: (lambda n=n, f=f: (calls.append(n), f())[1]) for n, f in segments.items()}
    made = B.rebuild(spark, f"{folder}/s", "v1", counted, KEYS, ["american_odds"])
    assert calls == ["b", "c"] and before == {f: os.stat(f).st_mtime_ns for f in before}
    whole = B.rebuild(spark, f"{folder}/t", "v1", segments, KEYS, ["american_odds"])
    assert made == whole and held(spark, f"{folder}/s") == held(spark, f"{folder}/t")
    assert held(spark, f"{folder}/s") == [("a", 1, 105.0), ("a", 2, 110.0), ("b", 3, 120.0), ("b", 4, 130.0), ("c", 5, 110.0)]
    assert B.rebuild(spark, f"{folder}/s", "v1", counted, KEYS, ["american_odds"]) == made and calls == ["b", "c"]


def test_a_rebuild_that_shrinks_or_is_empty_changes_nothing(spark, folder):
    first = {"a": wave(spark, (1, 110.0), (2, 110.0)), "b": wave(spark, (3, 110.0))}
    B.rebuild(spark, folder, "v1", first, KEYS)
    was = held(spark, folder)
    less = {"a": wave(spark, (1, 110.0))}
    with pytest.raises(B.RebuildRefused, match="2 fewer"):
        B.rebuild(spark, folder, "v2", less, KEYS)
    with pytest.raises(B.RebuildRefused, match="no rows"):
        B.rebuild(spark, folder, "v3", {"a": lambda: first["a"]().filter("false")}, KEYS, allow_shrink="wanted")
    with pytest.raises(B.RebuildRefused):
        B.rebuild(spark, folder, "v2", less, KEYS, allow_unreadable="that is another guard")
    assert held(spark, folder) == was and B.manifest(spark, folder)["version"] == "v1"
    made = B.rebuild(spark, folder, "v2", less, KEYS, allow_shrink="the source withdrew two events")
    assert made["reasons"] == {"shrink": "the source withdrew two events"} and held(spark, folder) == [("a", 1, 110.0)]


def test_a_store_that_cannot_be_read_is_not_replaced_in_silence(spark, folder):
    B.rebuild(spark, folder, "v1", {"a": wave(spark, (1, 110.0))}, KEYS)
    with open(f"{folder}/_manifests/00000002.json", "w") as f:
        f.write("{ torn")
    two = {"a": wave(spark, (1, 110.0), (2, 110.0))}
    for reason in ({}, {"allow_shrink": "another guard"}):
        with pytest.raises(B.RebuildRefused, match="can't be read"):
            B.rebuild(spark, folder, "v2", two, KEYS, **reason)
    assert B.rebuild(spark, folder, "v2", two, KEYS, allow_unreadable="manifest torn")["rows"] == 2
    assert len(held(spark, folder)) == 2


def test_capture_files_by_name(spark, folder):
    files = {"a": "event_id,market,american_odds,line\n007,spread,110,2.5\n008,spread,abc,1\n009,spread,120\n\n010,spread,-105,3,9\n",
             "b": "\ufeffAmerican_Odds,note,MARKET,event_id\r\n-110,\"x, y\",moneyline,0011\r\n115,,moneyline,12\r\n", "c": "13,spread,110\n"}
    for name, text in files.items():
        with open(f"{folder}/{name}.csv", "w", newline="") as f:
            f.write(text)
    schema = T.StructType([SCHEMA["event_id"], SCHEMA["market"], SCHEMA["american_odds"], SCHEMA["line"], SCHEMA["captured_at"]])
    rows = S.read_captures(spark, folder, schema).collect()
    good = sorted(tuple(r[c] for c in ("event_id", "market", "american_odds", "line", "captured_at")) for r in rows if r["bad_record"] is None)
    assert good == [("0011", "moneyline", -110.0, None, None), ("007", "spread", 110.0, 2.5, None), ("12", "moneyline", 115.0, None, None)]
    assert sorted(r["bad_record"] for r in rows if r["bad_record"] is not None) == ["008,spread,abc,1", "009,spread,120", "010,spread,-105,3,9", "13,spread,110"]
    counts = {r["file"][-5:]: (r["rows"], r["bad"]) for r in S.capture_counts(S.read_captures(spark, folder, schema)).collect()}
    assert counts == {"a.csv": (1, 3), "b.csv": (2, 0), "c.csv": (0, 1)}


def test_lines_are_not_dealt_by_file(spark):
    lines = spark.createDataFrame([("a", "event_id,market"), ("a", "1,spread"), ("b", "market,event_id"), ("b", "total,2"), ("c", "3,spread")], "file string, value string")
    out = S.capture_lines(lines, T.StructType([T.StructField("event_id", T.StringType()), T.StructField("market", T.StringType())]))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["file"], r["event_id"], r["market"], r["bad_record"]) for r in out.collect() if r["file"] != "c") == [("a", "1", "spread", None), ("b", "2", "total", None)]
    assert [r["bad_record"] for r in out.collect() if r["file"] == "c"] == ["3,spread"]
