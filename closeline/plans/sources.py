"""Scans, staging and store operators over the given tables.

What writes (appends, freezes) is registered by the rows it would write; the tests run the
writes themselves. Only the store rebuild and the processed tables write, into the shared folder of
checkpoints.
"""

import functools
import uuid

from pyspark.sql import functions as F, types as T

from closeline import session
from closeline.sources import payloads as J, rebuild as B, stores as S
from closeline.plans.registry import query


@query("season_feed_scan", "game_id:i home_score:i away_score:i", "select game_id, home_score, away_score from schedule where season = 1998")
def _(t):
    return S.season_rows(t.schedule, 1998, ["game_id", "home_score", "away_score"])


def versions(t):
    """The feed, and the version before it: one season shorter, one longer, one changed."""
    new = t.schedule.select("season", "game_id", "home_score", "away_score")
    season, key = F.col("season"), F.col("game_id")
    old = new.withColumn("home_score", F.when((season == 1997) & (key % 10 == 0), F.col("home_score") + 1).otherwise(F.col("home_score")))
    old = old.filter(~((season == 1999) & (F.col("home_score") >= 100)) & (season != 2001))
    repeat = old.filter(season == 1996).withColumn("game_id", -key - 1)
    return new, old.unionByName(repeat).unionByName(repeat.withColumn("game_id", key - 10_000_000))


OLD = """new as (select season, game_id, home_score, away_score from schedule), o1 as (select season, game_id, case when season = 1997 and game_id % 10 = 0 then home_score + 1 else home_score end as home_score, away_score from new where not (season = 1999 and home_score >= 100) and season <> 2001),
 old as (select * from o1 union all select season, -game_id - 1, home_score, away_score from o1 where season = 1996 union all select season, -game_id - 1 - 10000000, home_score, away_score from o1 where season = 1996)"""


@query("feed_version_guard", "feed:s season:i rows:i previous_rows:i verdict:s restated:b",
       f"""with {OLD}, n as (select season, count(*) as rows from new group by all), p as (select season, count(*) as previous_rows from old group by all)
       select 'schedules' as feed, season, rows, previous_rows, case when season in (1997, 1999) then 'accepted' when previous_rows is null then 'accepted' when rows < floor(previous_rows / 2) then 'refused: shrank' else 'unchanged' end as verdict, season in (1997, 1999) as restated from n left join p using (season)""")
def _(t):
    new, old = versions(t)
    mark = lambda d: S.fingerprint(d).withColumn("feed", F.lit("schedules"))
    return S.judge_version(mark(new), mark(old))


@query("restatement_check", "season:i game_id:i change:s",
       f"""with {OLD} select season, game_id, case when o.game_id is null then 'added' when n.game_id is null then 'dropped' else 'changed' end as change from old o full outer join new n using (season, game_id)
       where o.game_id is null or n.game_id is null or o.home_score <> n.home_score""")
def _(t):
    new, old = versions(t)
    return S.restatements(old, new, ["season", "game_id"])


@query("supplement_fill", "game_id:i home_score:i source:s", "select game_id, home_score, 'feed' as source from schedule where status_name = 'STATUS_FINAL' union all select game_id, away_score, 'supplement' from schedule where status_name <> 'STATUS_FINAL'")
def _(t):
    feed = t.schedule.filter("status_name = 'STATUS_FINAL'").select("game_id", "home_score", F.lit("feed").alias("source"))
    extra = t.schedule.select("game_id", F.col("away_score").alias("home_score"), F.lit("supplement").alias("source"))
    return S.supplemented(feed, extra)


LS = "ls as (select game_id, home_score // 2 as h1, home_score - home_score // 2 as h2, away_score // 2 as a1, case when game_id % 11 = 0 then 1 when game_id % 13 = 0 then 3 else 2 end as n from schedule)"


def scored(t):
    """Line scores as the feed writes them: JSON text, or the text of a list."""
    half = lambda c: F.floor(F.col(c) / 2)
    n = F.when(F.col("game_id") % 11 == 0, 1).when(F.col("game_id") % 13 == 0, 3).otherwise(2)
    values = lambda c: F.slice(F.array(half(c), F.col(c) - half(c), F.lit(7)), 1, n)
    as_json = lambda c: F.to_json(F.transform(values(c), lambda v: F.struct(v.cast("double").alias("value"))))
    as_text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(values(c), lambda v: F.concat(F.lit("{'value': "), v.cast("double").cast("string"), F.lit("}"))), ", "), F.lit("]"))
    pick = lambda c: F.when(F.col("game_id") % 2 == 0, as_json(c)).otherwise(as_text(c))
    return t.schedule.select("game_id", pick("home_score").alias("home_linescores"), pick("away_score").alias("away_linescores"))


@query("nested_line_score_read", "game_id:i periods:i overtime:b home_score_h1:d away_score_h1:d", f"with {LS} select game_id, n as periods, n > 2 as overtime, h1 as home_score_h1, a1 as away_score_h1 from ls where n >= 2")
def _(t):
    return J.schedule_segments(scored(t))


@query("three_source_segment_fill", "game_id:i source:s periods:i",
       f"""with {LS}, p as (select distinct game_id from plays), b as (select game_id from schedule where status_name = 'STATUS_FINAL' and game_id not in (select game_id from p))
       select game_id, 'plays' as source, cast(null as bigint) as periods from p union all select game_id, 'box', 2 from b union all select game_id, 'line scores', n from ls where n >= 2 and game_id not in (select game_id from p) and game_id not in (select game_id from b)""")
def _(t):
    tag = lambda d, n, p: d.select("game_id", F.lit(n).alias("source"), p.alias("periods"))
    plays = tag(t.plays.select("game_id").distinct(), "plays", F.lit(None).cast("long"))
    box = tag(t.schedule.filter("status_name = 'STATUS_FINAL'"), "box", F.lit(2).cast("long"))
    return S.supplemented(plays, box, tag(J.schedule_segments(scored(t)), "line scores", F.col("periods").cast("long")))


def payload_rows(t, where="true"):
    """One payload per event row: a book with three markets, written as JSON text."""
    e = F.col("event_id")
    home, away = F.concat(F.lit("Home "), (F.col("user_id") % 50).cast("string")), F.concat(F.lit("Away "), (F.col("user_id") % 41).cast("string"))
    out = lambda name, desc, price, point: F.struct(name.alias("name"), F.lit(desc).cast("string").alias("description"), price.cast("string").alias("price"), point.cast("string").alias("point"))
    up, down = F.lit(110) + e % 90, -(F.lit(110) + e % 70)
    line = (e % 15 - 7) * 0.5
    none = F.lit(None).cast("string")
    market = lambda key, *outs: F.struct(key.alias("key"), F.array(*outs).alias("outcomes"))
    markets = F.array(
        market(F.lit("h2h"), out(home, None, up, none), out(F.when(e % 9 == 0, F.lit("Draw")).otherwise(away), None, down, none)),
        market(F.lit("spreads"), out(home, None, F.when(e % 17 == 0, F.lit(50)).otherwise(down), line), out(away, None, up, -line)),
        market(F.when(e % 5 == 0, F.lit("player_points")).otherwise(F.lit("corner_kicks")), out(F.lit("Over"), "A. Player", up, F.lit(12.5)), out(F.lit("Under"), "A. Player", down, F.lit(12.5))))
    books = F.array(F.struct(F.concat(F.lit("book"), (e % 4).cast("string")).alias("key"), F.lit("Book").alias("title"), markets.alias("markets")))
    doc = F.struct(F.when(e % 23 == 0, F.lit("")).otherwise(e.cast("string")).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"), home.alias("home_team"), away.alias("away_team"), books.alias("bookmakers"))
    return J.parse_payloads(t.events.filter(where).select(F.to_json(doc).alias("payload")))


OUTS = """ev as (select event_id as e, user_id as u, ts, 'Home ' || cast(user_id % 50 as varchar) as home, 'Away ' || cast(user_id % 41 as varchar) as away, 110 + event_id % 90 as up, -(110 + event_id % 70) as dn, (event_id % 15 - 7) * 0.5e0 as ln from events),
 outs as (select e, ts, 'h2h' as provider_key, 'moneyline' as market, 'home' as selection, cast(null as double) as line, up as odds, '' as player from ev
  union all select e, ts, 'h2h', 'moneyline', case when e % 9 = 0 then null else 'away' end, null, dn, '' from ev
  union all select e, ts, 'spreads', 'spread', 'home', ln, case when e % 17 = 0 then 50 else dn end, '' from ev union all select e, ts, 'spreads', 'spread', 'away', -ln, up, '' from ev
  union all select e, ts, case when e % 5 = 0 then 'player_points' else 'corner_kicks' end, case when e % 5 = 0 then 'player_points' end, 'over', 12.5, up, 'A. Player' from ev
  union all select e, ts, case when e % 5 = 0 then 'player_points' else 'corner_kicks' end, case when e % 5 = 0 then 'player_points' end, 'under', 12.5, dn, 'A. Player' from ev),
 ref as (select *, case when e % 23 = 0 then 'unplaceable event' when market is null then 'unwired market' when selection is null then 'unknown selection' when abs(odds) < 100 then 'unreadable price' else '' end as refusal from outs)"""


@query("quote_json_staging", "event_id:s slate_date:t market:s segment:s player:s selection:s line:d american_odds:d book:s",
       f"with {OUTS} select cast(e as varchar) as event_id, cast((ts at time zone 'UTC') at time zone 'America/New_York' as date) as slate_date, market, 'game' as segment, player, selection, line + 0e0 as line, odds as american_odds, 'book' || cast(e % 4 as varchar) as book from ref where refusal = ''")
def _(t):
    return J.stage(payload_rows(t)).withColumn("line", F.col("line") + 0.0)


@query("quote_staging_refusals", "refusal:s outcomes:i", f"with {OUTS} select refusal, count(*) as outcomes from ref group by all")
def _(t):
    return J.staging_counts(payload_rows(t))


@query("payload_key_census", "provider_key:s rows:i books:i", f"with {OUTS} select provider_key, count(*) as rows, count(distinct e % 4) as books from outs group by all")
def _(t):
    return J.key_census(payload_rows(t))


@query("store_rebuild_from_payloads", "season:i market:s slate_date:t quotes:i",
       f"with {OUTS} select year(ts) as season, market, cast((ts at time zone 'UTC') at time zone 'America/New_York' as date) as slate_date, count(*) as quotes from ref where refusal = '' group by all")
def _(t):
    """A store is built, season by season, in the shared folder, and read back."""
    keys = ["slate_date", "event_id", "market", "segment", "player", "selection", "line", "book"]
    years = [r[0] for r in t.events.select(F.year("ts")).distinct().collect()]  # seasons of the archive

    def staged(year):
        rows = J.stage(payload_rows(t, F.year("ts") == year))
        return rows.unionByName(rows.filter("market = 'spread'"))  # a payload that was polled twice

    root = f"{session.shared_folder(t.spark)}/store-{uuid.uuid4().hex}"
    B.rebuild(t.spark, root, "1", {str(y): functools.partial(staged, y) for y in sorted(years)}, keys)
    return B.read(t.spark, root).groupBy(F.col("part").alias("season"), "market", "slate_date").agg(F.count("*").alias("quotes"))


STORE = T.StructType([
    T.StructField("slate_date", T.DateType()), T.StructField("event_id", T.LongType()), T.StructField("market", T.StringType()), T.StructField("selection", T.StringType()),
    T.StructField("line", T.DoubleType()), T.StructField("book", T.StringType()), T.StructField("american_odds", T.DoubleType()), T.StructField("note", T.StringType())])


@query("price_store_read", "event_id:i market:s american_odds:d note:s n:i", "select event_id, market, american_odds, cast(null as varchar) as note, count(*) as n from quotes group by all")
def _(t):
    held = t.quotes.select("slate_date", "event_id", "market", "selection", "line", "book", "american_odds", F.lit(None).cast("string").alias("stray"))
    return S.declared(held, STORE).groupBy("event_id", "market", "american_odds", "note").agg(F.count("*").alias("n"))


IDK = ["event_id", "market", "player", "selection", "line", "book"]


@query("idempotent_append", "event_id:i market:s selection:s line:d book:s american_odds:d",
       """select event_id, market, selection, line, book, min(american_odds) as american_odds from quotes q where not exists (select 1 from quotes s where s.tier = 'high_major' and s.event_id = q.event_id and s.market = q.market and s.player = q.player and s.selection = q.selection and s.line is not distinct from q.line and s.book = q.book) group by event_id, market, player, selection, line, book""")
def _(t):
    cols = [*IDK, "american_odds"]
    store = t.quotes.filter("tier = 'high_major'").select(*cols)
    return S.unseen(t.quotes.select(*cols), store, IDK, ["american_odds"])


@query("capture_append", "captured_at:t event_id:i market:s selection:s line:d book:s american_odds:d",
       "select distinct captured_at, event_id, market, selection, line, book, american_odds from board where event_id % 3 <> 0")
def _(t):
    """Every capture is offered whole; a third of its events is in the store already."""
    keys = ("captured_at", "event_id", "market", "segment", "player", "selection", "line", "book", "american_odds")
    return S.unseen(t.board.select(*keys), t.board.filter("event_id % 3 = 0").select(*keys), keys)


@query("daily_freeze", "snapshot_date:t event_id:i market:s selection:s line:d american_odds:d book:s",
       """select slate_date as snapshot_date, event_id, market, selection, line, min((american_odds, book))[1] as american_odds, min((american_odds, book))[2] as book from quotes q
       where not exists (select 1 from quotes s where s.tier = 'low_major' and s.slate_date = q.slate_date and s.event_id = q.event_id and s.market = q.market and s.player = q.player and s.selection = q.selection and s.line is not distinct from q.line) group by slate_date, event_id, market, player, selection, line""")
def _(t):
    rows = t.quotes.select(F.col("slate_date").alias("snapshot_date"), "event_id", "market", "segment", "player", "selection", "line", "american_odds", "book", "tier")
    return S.freeze(rows.drop("tier"), rows.filter("tier = 'low_major'"))


@query("settled_ledger_append", "snapshot_date:t event_id:i market:s selection:s line:d book:s outcome:s",
       """select slate_date as snapshot_date, event_id, market, selection, line, book, min(outcome) as outcome from quotes q where not exists (select 1 from quotes s where s.tier = 'mid_major' and s.slate_date = q.slate_date and s.event_id = q.event_id and s.market = q.market and s.player = q.player and s.selection = q.selection and s.line is not distinct from q.line and s.book = q.book)
       group by slate_date, event_id, market, player, selection, line, book""")
def _(t):
    rows = t.quotes.select(F.col("slate_date").alias("snapshot_date"), "event_id", "market", "segment", F.upper("player").alias("player"), "selection", "line", "book", "outcome", "tier")
    held = rows.filter("tier = 'mid_major'").withColumn("player", F.lower("player"))
    return S.unseen(rows.drop("tier"), held, S.LEDGER_IDENTITY, ["outcome"])


@query("dated_snapshot_pick", "day:t team:i adj_off:d adj_def:d sources:i",
       """with tb as (select 's' || cast(game_id % 3 as varchar) as source, date_trunc('month', slate_date)::date + cast((dayofmonth(slate_date) - 1) // 10 * 10 as integer) as as_of, team_id as team, avg(team_score) as adj_off, avg(opponent_score) as adj_def, avg(possessions) as tempo from team_games group by all),
       dy as (select distinct date_trunc('month', slate_date)::date as day from team_games), nw as (select day, source, max(as_of) as as_of from dy join (select distinct source, as_of from tb) on as_of < day and as_of >= day - 14 group by all)
       select day, team, avg(adj_off) as adj_off, avg(adj_def) as adj_def, count(*) as sources from tb join nw using (source, as_of) group by all""")
def _(t):
    # Tables are dated the 1st, 11th, 21st and 31st.
    dated = F.date_add(F.trunc("slate_date", "month"), (F.floor((F.dayofmonth("slate_date") - 1) / 10) * 10).cast("int"))
    tables = t.team_games.groupBy(F.concat(F.lit("s"), (F.col("game_id") % 3).cast("string")).alias("source"), dated.alias("as_of"), F.col("team_id").alias("team")).agg(
        F.avg("team_score").alias("adj_off"), F.avg("opponent_score").alias("adj_def"), F.avg("possessions").alias("tempo"))
    days = t.team_games.select(F.trunc("slate_date", "month").alias("day")).distinct()
    return S.dated_consensus(tables, days, 14)


@query("processed_table_build", "name:s season:i game_id:i key:i value:d",
       "select 'team_games' as name, season, game_id, team_id as key, margin as value from team_games union all select 'player_games', season, game_id, row_key, minutes from player_games")
def _(t):
    """Both tables are written by season in the shared folder, and read back."""
    root = f"{session.shared_folder(t.spark)}/processed-{uuid.uuid4().hex}"
    S.build_processed({"team_games": t.team_games, "player_games": t.player_games}, root)
    part = lambda n, k, v: t.spark.read.parquet(f"{root}/{n}").select(F.lit(n).alias("name"), "season", "game_id", F.col(k).alias("key"), F.col(v).alias("value"))
    return part("team_games", "team_id", "margin").unionByName(part("player_games", "row_key", "minutes"))


@query("capture_csv_read", "file:s rows:i bad:i events:i odds:d",
       """select 'part' || (event_id % 3) as file, count(*) filter (linenumber <> 7) as rows, count(*) filter (linenumber = 7) as bad, count(distinct case when linenumber <> 7 then event_id end) as events, sum(case when linenumber <> 7 then american_odds end) as odds from board group by all""")
def _(t):
    """Files of three column orders; every seventh line of an order has a price that is none, or a field too many."""
    part = F.col("event_id") % 3
    price = F.when((F.col("linenumber") == 7) & (part != 2), "EVEN").otherwise(F.col("american_odds").cast("string"))
    more = F.when((F.col("linenumber") == 7) & (part == 2), ",stray").otherwise("")
    event = F.concat(F.lit("00"), F.col("event_id").cast("string"))
    line = F.when(part == 0, F.concat_ws(",", event, "market", price)).when(part == 1, F.concat_ws(",", price, F.lit('"a, b"'), "market", event)).otherwise(F.concat(F.concat_ws(",", "market", price, event), more))
    headers = t.spark.createDataFrame([("part0", "event_id,market,american_odds"), ("part1", '"american_odds",note,market,EVENT_ID'), ("part2", "market,american_odds,event_id")], "file string, value string")
    lines = t.board.select(F.concat(F.lit("part"), part.cast("string")).alias("file"), line.alias("value")).unionByName(headers)
    rows = S.capture_lines(lines, T.StructType([f for f in STORE.fields if f.name in ("event_id", "market", "american_odds", "note")]))
    good = F.col("bad_record").isNull() & F.col("event_id").startswith("00")
    return rows.groupBy("file").agg(F.count_if(good).alias("rows"), F.count("bad_record").alias("bad"), F.countDistinct("event_id").alias("events"), F.sum("american_odds").alias("odds"))


@query("box_score_json_staging", "game_id:i team_id:i athlete_id:i minutes:d points:d field_goals_made:i field_goals_attempted:i did_not_play:b n:i",
       "select game_id, team_id, athlete_id, floor(minutes) as minutes, points, field_goals_made, field_goals_attempted, did_not_play, count(*) as n from player_games group by all")
def _(t):
    text = lambda c: F.col(c).cast("string")
    stats = F.array(F.floor("minutes").cast("string"), F.concat(text("field_goals_made"), F.lit("-"), text("field_goals_attempted")), text("points"))
    athlete = F.struct(F.struct(text("athlete_id").alias("id"), F.col("athlete_name").alias("displayName")).alias("athlete"), "starter", F.col("did_not_play").alias("didNotPlay"), stats.alias("stats"))
    group = F.struct(F.array(F.lit("MIN"), F.lit("FG"), F.lit("PTS")).alias("labels"), F.array(athlete).alias("athletes"))
    doc = F.struct(F.array(F.struct(F.struct(text("team_id").alias("id")).alias("team"), F.array(group).alias("statistics"))).alias("players"))
    out = J.box_players(t.player_games.select("game_id", F.to_json(doc).alias("boxscore")))
    return out.groupBy("game_id", "team_id", "athlete_id", "minutes", "points", "field_goals_made", "field_goals_attempted", "did_not_play").agg(F.count("*").alias("n"))


BOX_TEAMS = ("field_goals_made field_goals_attempted three_made three_attempted free_throws_made free_throws_attempted offensive_rebounds defensive_rebounds assists steals blocks turnovers").split()


@query("box_team_json_staging", "game_id:i team_id:i opponent_id:i home_away:s rebounds:i " + " ".join(f"{c}:i" for c in BOX_TEAMS),
       f"select game_id, team_id, opponent_id, home_away, offensive_rebounds + defensive_rebounds as rebounds, {', '.join(BOX_TEAMS)} from team_games")
def _(t):
    text = lambda c: F.col(c).cast("string")
    split = lambda s: F.concat(text(f"{s}_made"), F.lit("-"), text(f"{s}_attempted"))
    named = [*[(k, split(v)) for k, v in J.TEAM_SPLITS.items()], ("totalRebounds", (F.col("offensive_rebounds") + F.col("defensive_rebounds")).cast("string")),
             *[(k, text(v)) for k, v in J.TEAM_LABELS.items() if v in BOX_TEAMS]]
    stats = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("displayValue")) for k, v in named])
    team = F.struct(F.struct(text("team_id").alias("id")).alias("team"), F.col("home_away").alias("homeAway"), stats.alias("statistics"))
    docs = t.team_games.groupBy("game_id").agg(F.collect_list(team).alias("teams")).select("game_id", F.to_json(F.struct("teams")).alias("boxscore"))
    return J.box_teams(docs)


def scoreboards(t):
    """One scoreboard document a day; games that are not over, and games in overtime or without line scores, too."""
    over = F.col("game_id") % 13 == 0
    half = lambda c: F.floor(F.col(c) / 2)
    lines = lambda c: F.when(F.col("game_id") % 11 == 0, F.array().cast(J.SCORED_PERIODS)).otherwise(F.transform(F.slice(F.array(half(c), F.col(c) - half(c), F.lit(7)), 1, F.when(over, 3).otherwise(2)),
        lambda v: F.struct(F.when(F.col("game_id") % 2 == 0, v).cast("double").alias("value"), v.cast("string").alias("displayValue"), F.lit(None).cast("int").alias("period"))))
    side = lambda s: F.struct(F.lit(s).alias("homeAway"), F.struct(F.col(f"{s}_id").cast("string").alias("id")).alias("team"), lines(f"{s}_score").alias("linescores"))
    state = F.struct(F.struct((F.col("status_name") == "STATUS_FINAL").alias("completed")).alias("type"))
    game = F.struct(F.col("game_id").cast("string").alias("id"), F.array(F.struct(state.alias("status"), F.array(side("away"), side("home")).alias("competitors"))).alias("competitions"))
    return t.schedule.groupBy("slate_date").agg(F.collect_list(game).alias("events")).select(F.to_json(F.struct("events")).alias("payload"))


BOARD_SCORES = "sc as (select *, game_id % 11 <> 0 as known, game_id % 13 = 0 as ot from schedule where status_name = 'STATUS_FINAL')"


@query("scoreboard_segments", "game_id:i periods:i overtime:b home_score_h1:d away_score_h1:d",
       f"with {BOARD_SCORES} select game_id, case when known then case when ot then 3 else 2 end end as periods, case when known then ot end as overtime, case when known then home_score // 2 end as home_score_h1, case when known then away_score // 2 end as away_score_h1 from sc")
def _(t):
    return J.scoreboard_segments(J.completed_games(scoreboards(t)))


@query("scoreboard_periods", "game_id:i home_away:s team_id:i period:i score:d score_so_far:d",
       f"""with {BOARD_SCORES}, s as (select game_id, 'home' as home_away, home_id as team_id, home_score as s, ot from sc where known union all select game_id, 'away', away_id, away_score, ot from sc where known),
       p as (select *, unnest(case when ot then [1, 2, 3] else [1, 2] end) as period from s)
       select game_id, home_away, team_id, period, case period when 1 then s // 2 when 2 then s - s // 2 else 7 end as score, case period when 1 then s // 2 when 2 then s else s + 7 end as score_so_far from p""")
def _(t):
    return J.scoreboard_periods(J.completed_games(scoreboards(t)))


@query("rating_site_tables", "team:s adj_off:d adj_def:d tempo:d", "select c_name as team, 95 + c_custkey % 25 as adj_off, 92 + c_custkey % 27 as adj_def, 62 + c_custkey % 12 as tempo from customer")
def _(t):
    key = F.col("c_custkey")
    table = t.customer.select(key.cast("string").alias("c0"), F.concat(F.lit(" "), "c_name").alias("c1"), (95 + key % 25).cast("string").alias("c2"), (92 + key % 27).cast("string").alias("c3"), (62 + key % 12).cast("string").alias("c4"), F.col("c_mktsegment").alias("c5"))
    return J.rating_table(table, ["c0", "c1", "c2", "c3", "c4", "c5"])


@query("power_index_json", "team:s team_id:i adj_off:d adj_def:d", "select s_name as team, s_suppkey as team_id, 100 + (s_suppkey % 15) * 100e0 / 70 as adj_off, 100 - (s_suppkey % 9) * 100e0 / 70 as adj_def from supplier")
def _(t):
    key = F.col("s_suppkey")
    names = F.array(F.struct(F.lit("bpi").alias("name"), F.array(F.lit("bpi"), F.lit("bpioffense"), F.lit("bpidefense")).alias("names")))
    values = F.array(F.lit(1.0), (key % 15).cast("double"), (key % 9).cast("double"))
    team = F.struct(F.struct(key.cast("string").alias("id"), F.col("s_name").alias("displayName")).alias("team"), F.array(F.struct(F.lit("bpi").alias("name"), values.alias("values"))).alias("categories"))
    return J.power_index(t.supplier.select(F.to_json(F.struct(names.alias("categories"), F.array(team).alias("teams"))).alias("payload")))
