"""Schedules, names, fixtures and settlement."""

from pyspark.sql import functions as F


from closeline.functions import text as T
from closeline.operators import names as N, schedules as D, settle as X
from closeline.plans.registry import query

IDS = "ids as (select distinct id from (select home_id as id from schedule where home_conference_id <> 4 union all select away_id from schedule where away_conference_id <> 4) where id is not null)"
VENUES = """vh as (select * from schedule where not coalesce(neutral_site, true) and home_id is not null),
 uv as (select home_id as id, venue_id as v from (select home_id, venue_id, count(*) as n from vh group by all) qualify row_number() over (partition by home_id order by n desc, venue_id) = 1),
 uc as (select home_id as id, venue_city as c from (select home_id, venue_city, count(*) as n from vh group by all) qualify row_number() over (partition by home_id order by n desc, venue_city) = 1),
 us as (select home_id as id, venue_state_code as s from (select home_id, venue_state_code, count(*) as n from vh group by all) qualify row_number() over (partition by home_id order by n desc, venue_state_code) = 1),
 usual as (select uv.id, v, c, s from uv join uc using (id) join us using (id))"""
CLASS = f"""{IDS}, {VENUES}, classified as (select g.*, case when lower(headline) like '%exhibition%' then 'exhibition' when home_id is null or away_id is null then 'unknown'
  when home_id not in (select id from ids) or away_id not in (select id from ids) then 'non_di_opponent'
  else case status_name when 'STATUS_FINAL' then 'countable' when 'STATUS_SCHEDULED' then 'scheduled' when 'STATUS_POSTPONED' then 'postponed' when 'STATUS_CANCELED' then 'cancelled' else 'unknown' end end as game_state,
  case when neutral_site is null then 'unknown' when not neutral_site then 'home' when h.v = g.venue_id or a.v = g.venue_id or (h.c = venue_city and h.s = venue_state_code) or (a.c = venue_city and a.s = venue_state_code) then 'quasi_neutral' else 'neutral' end as venue_state
  from schedule g left join usual h on h.id = home_id left join usual a on a.id = away_id)"""

# The same by season, and which side is local.
LOCAL = """sh as (select * from schedule where not coalesce(neutral_site, true) and home_id is not null),
 sv as (select season, home_id as id, venue_id as v from (select season, home_id, venue_id, count(*) as n from sh group by all) qualify row_number() over (partition by season, home_id order by n desc, venue_id) = 1),
 sc as (select season, home_id as id, venue_city as c from (select season, home_id, venue_city, count(*) as n from sh group by all) qualify row_number() over (partition by season, home_id order by n desc, venue_city) = 1),
 ss as (select season, home_id as id, venue_state_code as s from (select season, home_id, venue_state_code, count(*) as n from sh group by all) qualify row_number() over (partition by season, home_id order by n desc, venue_state_code) = 1),
 su as (select season, id, v, c, s from sv join sc using (season, id) join ss using (season, id)),
 near as (select g.*, coalesce(h.v = g.venue_id or (h.c = venue_city and h.s = venue_state_code), false) as hn, coalesce(a.v = g.venue_id or (a.c = venue_city and a.s = venue_state_code), false) as an
  from schedule g left join su h on h.id = home_id and h.season = g.season left join su a on a.id = away_id and a.season = g.season),
 loc as (select game_id, venue_id, case when neutral_site is null then 'unknown' when not neutral_site then 'home' when hn or an then 'quasi_neutral' else 'neutral' end as venue_state,
  case when neutral_site is null then null when not neutral_site then home_id when hn and not an then home_id when an and not hn then away_id end as local_team_id,
  case when neutral_site is null then 'venue unknown' when not neutral_site then case when home_id is null then 'host unknown' else 'host' end when hn and an then 'both local' when hn then 'home side local' when an then 'away side local' else 'nobody local' end as local_side from near)"""


def schedule(t):
    drop4 = lambda c: F.when(F.col(c) != 4, F.col(c))
    return t.schedule.withColumns({c: drop4(c) for c in ("home_conference_id", "away_conference_id")})


@query("division_ids", "team_id:i", f"with {IDS} select id as team_id from ids")
def _(t):
    return D.division_ids(schedule(t))


@query("usual_venue", "team_id:i usual_venue_id:i usual_venue_city:s usual_venue_state_code:s", f"with {VENUES} select id as team_id, v as usual_venue_id, c as usual_venue_city, s as usual_venue_state_code from usual")
def _(t):
    return D.usual_venues(t.schedule)


@query("game_state", "game_id:i game_state:s", f"with {CLASS} select game_id, game_state from classified")
def _(t):
    return D.classify(schedule(t))


@query("venue_state", "game_id:i venue_state:s", f"with {CLASS} select game_id, venue_state from classified")
def _(t):
    return D.classify(schedule(t))


@query("local_sides", "game_id:i venue_state:s venue_id:i local_team_id:i local_side:s", f"with {LOCAL} select game_id, venue_state, venue_id, local_team_id, local_side from loc")
def _(t):
    return D.local_sides(t.schedule)


@query("classify_and_count", "game_state:s venue_state:s games:i total:i", f"with {CLASS} select game_state, venue_state, count(*) as games, (select count(*) from schedule) as total from classified group by all")
def _(t):
    return D.state_counts(D.classify(schedule(t)))


@query("fittable", "game_id:i", f"with {CLASS} select game_id from classified where game_state = 'countable' and venue_state <> 'unknown'")
def _(t):
    return D.fittable(D.classify(schedule(t)))


@query("cardable", "game_id:i", f"with {CLASS} select game_id from classified where game_state in ('countable', 'scheduled') and venue_state <> 'unknown'")
def _(t):
    return D.cardable(D.classify(schedule(t)))


@query("played_games", "season:i n:i", "select season, count(*) as n from schedule where status_name = 'STATUS_FINAL' group by all")
def _(t):
    flagged = t.schedule.withColumn("completed", F.when(F.col("status_name") == "STATUS_FINAL", F.lit(" True ")).otherwise(F.lit("no")))
    return D.played(flagged).groupBy("season").agg(F.count("*").alias("n"))


TIERS = """long as (select home_id as team_id, home_conference_id as c, home_score - away_score as m from schedule where status_name = 'STATUS_FINAL' and home_id is not null and home_conference_id <> away_conference_id
  union all select away_id, away_conference_id, away_score - home_score from schedule where status_name = 'STATUS_FINAL' and home_id is not null and home_conference_id <> away_conference_id),
 pt as (select team_id, count(*) as games, avg(m) as margin, max(c) as c from long group by all), mem as (select distinct team_id, c from long),
 cm as (select mem.c, quantile_cont(margin, 0.5) as cmargin from mem join pt using (team_id) group by all),
 tiers as (select team_id, pt.c, games, margin, cmargin, case when games < 8 then 'unplaced' when coalesce(cmargin, margin) >= 8 then 'high_major' when coalesce(cmargin, margin) >= -3 then 'mid_major' else 'low_major' end as tier from pt left join cm using (c))"""


@query("tier_table", "team_id:i games:i margin:d conference_margin:d tier:s", f"with {TIERS} select team_id, games, margin, cmargin as conference_margin, tier from tiers")
def _(t):
    return D.tier_table(t.schedule)


@query("division_filter", "team_id:i n:i", f"with {IDS} select team_id, count(*) as n from sides where team_id in (select id from ids) and opponent_id in (select id from ids) group by all")
def _(t):
    return D.division_only(t.sides, D.division_ids(schedule(t))).groupBy("team_id").agg(F.count("*").alias("n"))


EVENTS = """ev as (select game_id as ask, slate_date, case when game_id % 3 = 0 then away_id else home_id end as home_id, case when game_id % 7 = 0 then null when game_id % 3 = 0 then home_id else away_id end as away_id from schedule),
 gm as (select game_id, slate_date, home_id, away_id from schedule where home_id is not null and away_id is not null),
 pr as (select slate_date, least(home_id, away_id) as lo, greatest(home_id, away_id) as hi, any_value(game_id) as g, any_value(home_id) as h from gm group by all having count(*) = 1),
 tm as (select slate_date, t, any_value(game_id) as g, any_value(home_id) as h from (select slate_date, home_id as t, game_id, home_id from gm union all select slate_date, away_id, game_id, home_id from gm) group by all having count(*) = 1),
 fx as (select ev.*, coalesce(pr.g, tm.g) as game_id, case when coalesce(pr.g, tm.g) is null then null when ev.home_id is not null then coalesce(pr.h, tm.h) <> ev.home_id else coalesce(pr.h, tm.h) = ev.away_id end as flipped,
  case when pr.g is not null then 'pair' when tm.g is not null then 'one side' else 'unresolved' end as how
  from ev left join pr on ev.slate_date = pr.slate_date and least(ev.home_id, ev.away_id) = lo and greatest(ev.home_id, ev.away_id) = hi and ev.home_id is not null and ev.away_id is not null
  left join tm on ev.slate_date = tm.slate_date and (ev.home_id is null or ev.away_id is null) and coalesce(ev.home_id, ev.away_id) = tm.t)"""


def asked(t):
    turned = F.col("game_id") % 3 == 0
    return t.schedule.select(
        F.col("game_id").alias("ask"), "slate_date", F.when(turned, F.col("away_id")).otherwise(F.col("home_id")).alias("home_id"),
        F.when(F.col("game_id") % 7 == 0, None).when(turned, F.col("home_id")).otherwise(F.col("away_id")).alias("away_id"))


@query("fixture_resolution", "ask:i game_id:i flipped:b how:s", f"with {EVENTS} select ask, game_id, flipped, how from fx")
def _(t):
    return D.resolve_fixtures(asked(t), t.schedule)


@query("event_to_game_join", "how:s flipped:b n:i", f"with {EVENTS} select how, flipped, count(*) as n from fx group by all")
def _(t):
    return D.resolve_fixtures(asked(t), t.schedule).groupBy("how", "flipped").agg(F.count("*").alias("n"))


def lines(t):
    return asked(t).withColumns({"close_spread": (F.col("ask") % 21 - 10) * 0.5, "close_total": 130.0 + F.col("ask") % 40})


@query("lined_games", "ask:i game_id:i market_margin:d market_total:d flipped:b",
       f"with {EVENTS} select ask, game_id, case when flipped then 1 else -1 end * ((ask % 21 - 10) * 0.5e0) as market_margin, 130e0 + ask % 40 as market_total, flipped from fx where game_id is not null")
def _(t):
    return D.lined_games(lines(t), t.schedule, key="ask")


@query("unique_match_fill", "ask:i filled:i",
       """with a as (select game_id as ask, slate_date, home_id, away_id, case when game_id % 4 = 0 then null else game_id end as eid from schedule),
       k as (select slate_date, home_id, away_id, min(eid) as lo, max(eid) as hi from a where eid is not null group by all)
       select ask, coalesce(eid, case when lo = hi then lo end) as filled from a left join k using (slate_date, home_id, away_id)""")
def _(t):
    rows = t.schedule.select(F.col("game_id").alias("ask"), "slate_date", "home_id", "away_id", F.when(F.col("game_id") % 4 == 0, None).otherwise(F.col("game_id")).alias("filled"))
    return D.unique_fill(rows, ["slate_date", "home_id", "away_id"], "filled")


@query("archive_gap", "slate_date:t", "with a as (select distinct slate_date from schedule where dayofweek(slate_date) <> 0) select distinct slate_date from schedule where slate_date > (select min(slate_date) from a) and slate_date < (select max(slate_date) from a) and slate_date not in (select slate_date from a)")
def _(t):
    return D.missing_days(t.schedule.filter(F.dayofweek("slate_date") != 1), t.schedule)


@query("slate_placement", "placement:s n:i",
       """with e as (select distinct slate_date, home_id, away_id from schedule where status_name <> 'STATUS_POSTPONED' union select slate_date, home_id, 99 from schedule where headline = '5-LOW' and home_id is not null),
       g as (select game_id, slate_date, home_id, away_id from schedule)
       select case when g.game_id is null then 'event without game' when e.slate_date is null then 'game without price' else 'placed' end as placement, count(*) as n
       from g full outer join e on g.slate_date = e.slate_date and g.home_id = e.home_id and g.away_id = e.away_id group by all""")
def _(t):
    priced = t.schedule.filter("status_name <> 'STATUS_POSTPONED'").select("slate_date", "home_id", "away_id")
    odd = t.schedule.filter("headline = '5-LOW' and home_id is not null").select("slate_date", "home_id", F.lit(99).cast("long").alias("away_id"))
    return D.placement(priced.unionByName(odd), t.schedule).groupBy("placement").agg(F.count("*").alias("n"))


@query("expected_vs_run_match", "job:s slot_day:t expected:i run_id:i minutes_late:d",
       """with cr as (select distinct event_type as job, cast(ts as date) as slot_day, date_trunc('hour', ts) as tick from events), rn as (select event_type as job, cast(ts as date) as slot_day, ts as tick, event_id as run_id from events),
       m as (select r.job, r.slot_day, r.run_id, r.tick, max(c.tick) as expected from rn r join cr c on r.job = c.job and r.slot_day = c.slot_day and c.tick <= r.tick group by all),
       k as (select job, slot_day, expected, arg_min(run_id, (tick, run_id)) as run_id, min(tick) as tick from m group by all)
       select c.job, c.slot_day, epoch_us(c.tick) as expected, k.run_id, (epoch_us(k.tick) - epoch_us(c.tick)) / 6e7 as minutes_late from cr c left join k on c.job = k.job and c.slot_day = k.slot_day and c.tick = k.expected""")
def _(t):
    stamp = F.col("ts").cast("timestamp")
    ev = t.events.select(F.col("event_type").alias("job"), F.to_date("ts").alias("slot_day"), stamp.alias("at"), F.col("event_id").alias("run_id"))
    crons = ev.select("job", "slot_day", F.date_trunc("hour", "at").alias("at")).distinct()
    out = D.expected_runs(ev, crons)
    return out.withColumn("expected", F.unix_micros("expected"))


@query("day_shape", "days:i low:i median:d p90:d high:i mean:d", "select count(*) as days, min(n) as low, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.9) as p90, max(n) as high, avg(n) as mean from (select slate_date, count(*) as n from schedule group by all)")
def _(t):
    return D.day_shape(t.schedule)


NAMES = """nm as (select id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) as f from named), ix as (select f, min(id) as lo, max(id) as hi from nm group by all),
 sp as (select row_key, trim(regexp_replace(regexp_replace(lower(spelled), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) as f from spelled),
 rs as (select row_key, sp.f, case when lo = hi then lo end as resolved_id, case when lo is null then 'none' when lo = hi then 'one' else 'many' end as resolution from sp left join ix using (f))"""


@query("name_to_id_join", "row_key:s resolved_id:i resolution:s", f"with {NAMES} select row_key, resolved_id, resolution from rs")
def _(t):
    return N.resolve(t.spelled, "row_key", "spelled", N.alias_index(t.named, "name", "id"))


@query("unresolved_top_list", "name:s n:i", f"with {NAMES} select f as name, count(*) as n from rs where resolution <> 'one' group by all order by n desc, name limit 40")
def _(t):
    from closeline.operators import ledger as L

    out = N.resolve(t.spelled, "row_key", "spelled", N.alias_index(t.named, "name", "id")).filter("resolution <> 'one'").withColumn("name", T.normalise_name("spelled"))
    return L.unresolved_top(out, "name")


@query("player_name_join", "row_key:i resolved_id:i resolution:s",
       """with rost as (select distinct game_id, athlete_id, 'jo' || cast(athlete_id % 40 as varchar) as fst, 'smith' || cast(athlete_id % 300 as varchar) as lst from player_games),
       ix as (select game_id, form, min(athlete_id) as lo, max(athlete_id) as hi from (select game_id, athlete_id, fst || ' ' || lst as form from rost union all select game_id, athlete_id, 'j ' || lst from rost) group by all),
       ask as (select row_key, game_id, case when row_key % 2 = 0 then 'j ' else 'jo' || cast(athlete_id % 40 as varchar) || ' ' end || 'smith' || cast((athlete_id + case when row_key % 5 = 0 then 7 else 0 end) % 300 as varchar) as form from (select row_key, game_id, min(athlete_id) as athlete_id from player_games group by all))
       select row_key, case when lo = hi then lo end as resolved_id, case when lo is null then 'none' when lo = hi then 'one' else 'many' end as resolution from ask left join ix using (game_id, form)""")
def _(t):
    first = F.concat(F.lit("Jo"), (F.col("athlete_id") % 40).cast("string"))
    roster = t.player_games.select("game_id", "athlete_id", F.concat(first, F.lit(" Smith"), (F.col("athlete_id") % 300).cast("string"), F.lit(" Jr.")).alias("name")).distinct()
    shift = F.when(F.col("row_key") % 5 == 0, 7).otherwise(0)
    asks = t.player_games.groupBy("row_key", "game_id").agg(F.min("athlete_id").alias("athlete_id")).select("row_key", "game_id", F.concat(
        F.when(F.col("row_key") % 2 == 0, F.lit("J.")).otherwise(first), F.lit(" SMITH"), ((F.col("athlete_id") + shift) % 300).cast("string")).alias("spelled"))
    index = N.alias_index(roster, "name", "athlete_id", ["game_id"], N.player_forms)
    return N.resolve(asks, "row_key", "spelled", index, ["game_id"], T.player_variants)


@query("external_table_resolve", "row_key:i resolved_id:i",
       """with a as (select c_custkey as row_key, case when c_custkey % 4 = 0 then c_custkey + 1 when c_custkey % 4 = 3 then null else c_custkey end as hit from customer), m as (select max(c_custkey) as top from customer),
       h as (select row_key, case when hit > top then null else hit end as hit from a, m)
       select row_key, case when (select count(*) from h x where x.hit = h.hit) = 1 then hit end as resolved_id from h""")
def _(t):
    index = N.alias_index(t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")), "name", "id")
    number = lambda c: F.concat(F.lit("customer "), F.lpad(c.cast("string"), 9, "0"))
    key = F.col("row_key")
    rows = t.customer.select(F.col("c_custkey").alias("row_key"))
    spelled = F.array(F.lit("nobody at all"), F.when(key % 4 == 0, number(key + 1)).when(key % 4 == 3, F.lit("unknown")).otherwise(number(key)))
    return N.resolve_ordered(rows, "row_key", spelled, index)


TEAM_ASKS = """asks as (select q.*, case when selection like 'home%' then 'home' when selection like 'away%' then 'away' else 'home' end as side from (select *, case when partkey % 10 = 9 then 'h1' else 'game' end as seg from quotes) q),
 joined as (select a.*, g.team_score, g.opponent_score, g.team_score_h1, g.opponent_score_h1 from asks a left join team_games g on a.event_id = g.game_id and a.side = g.home_away),
 graded as (select *, case when market = 'player_points' then null when seg = 'h1' then null when market = 'moneyline' then team_score - opponent_score when market = 'spread' then team_score - opponent_score + line
   when selection = 'over' then team_score + opponent_score - line else line - team_score - opponent_score end as adj from joined),
 settled as (select *, case when adj is null then 'unsettleable' when adj > 0 then 'won' when adj < 0 then 'lost' when market = 'moneyline' then 'unsettleable' else 'push' end as res,
   case when market = 'player_points' then 'not a wired market' when seg = 'h1' then 'wrong segment' when team_score is null then 'no score' when adj = 0 and market = 'moneyline' then 'level where level cannot be' end as note from graded)"""


def team_asks(t):
    return t.quotes.withColumn("segment", F.when(F.col("partkey") % 10 == 9, "h1").otherwise("game")).withColumn("line", F.when(F.col("market") != "moneyline", F.col("line")))


@query("settlement", "event_id:i partkey:i suppkey:i market:s selection:s settled:s settled_profit:d note:s",
       f"with {TEAM_ASKS} select event_id, partkey, suppkey, market, selection, res as settled, case res when 'won' then payout when 'lost' then -1 when 'push' then 0 end as settled_profit, note from settled")
def _(t):
    return X.grade_against_games(team_asks(t), t.team_games)


@query("backtest_grading", "market:s tier:s settled:s n:i profit:d",
       f"with {TEAM_ASKS} select market, tier, res as settled, count(*) as n, sum(case res when 'won' then payout when 'lost' then -1 when 'push' then 0 end) as profit from settled group by all")
def _(t):
    return X.grade_against_games(team_asks(t), t.team_games).groupBy("market", "tier", "settled").agg(F.count("*").alias("n"), F.sum("settled_profit").alias("profit"))


PLACED_ASKS = f"""{EVENTS}, {TEAM_ASKS.split(' joined as')[0]}
 placed as (select a.*, fx.game_id, fx.flipped, case side when 'home' then fx.home_id else fx.away_id end as provider, case when fx.game_id is null or flipped is null then 'refused' when flipped then 'flipped' else 'as filed' end as orientation,
   case when selection not in ('home', 'away') then null when selection = 'home' then fx.home_id else fx.away_id end as expected_team_id from asks a left join fx on fx.ask = a.event_id),
 pj as (select p.*, g.team_id, g.team_score, g.opponent_score from placed p left join team_games g on g.game_id = p.game_id and g.home_away = case when flipped then case side when 'home' then 'away' else 'home' end else side end),
 pg as (select *, case when market = 'player_points' then 'not a wired market' when seg = 'h1' then 'wrong segment' when orientation = 'refused' then 'event not placed' when expected_team_id is not null and team_id is null then 'row names no team' when team_id <> expected_team_id then 'row is another team''s' when expected_team_id is null and market <> 'total_points' and team_id is null then 'row is not the named side' when team_score is null then 'no score' end as why,
   case when market = 'moneyline' then team_score - opponent_score when market = 'spread' then team_score - opponent_score + line when selection = 'over' then team_score + opponent_score - line else line - team_score - opponent_score end as adj from pj),
 ps as (select *, case when why is not null then 'unsettleable' when adj > 0 then 'won' when adj < 0 then 'lost' when market = 'moneyline' then 'unsettleable' else 'push' end as res, coalesce(why, case when adj = 0 and market = 'moneyline' then 'level where level cannot be' end) as note from pg)"""


def placed_events(t):
    """Events under the provider's home and away, some turned round, some with a team unknown."""
    return D.resolve_fixtures(asked(t), t.schedule).withColumnRenamed("ask", "event_id")


@query("settlement_by_team", "event_id:i partkey:i suppkey:i market:s selection:s orientation:s expected_team_id:i settled:s settled_profit:d note:s",
       f"with {PLACED_ASKS} select event_id, partkey, suppkey, market, selection, orientation, expected_team_id, res as settled, case res when 'won' then payout when 'lost' then -1 when 'push' then 0 end as settled_profit, note from ps")
def _(t):
    return X.grade_against_games(team_asks(t), t.team_games, events=placed_events(t))


@query("backtest_by_orientation", "market:s tier:s orientation:s settled:s n:i profit:d",
       f"with {PLACED_ASKS} select market, tier, orientation, res as settled, count(*) as n, sum(case res when 'won' then payout when 'lost' then -1 when 'push' then 0 end) as profit from ps group by all")
def _(t):
    graded = X.grade_against_games(team_asks(t), t.team_games, events=placed_events(t))
    return graded.groupBy("market", "tier", "orientation", "settled").agg(F.count("*").alias("n"), F.sum("settled_profit").alias("profit"))


@query("half_settlement", "game_id:i home_away:s spread_h1:s total_h2:s team_h2:s",
       """with a as (select *, team_score_h1 - opponent_score_h1 + (game_id % 7 - 3) as s1, (team_score - team_score_h1) + (opponent_score - opponent_score_h1) - (70 + game_id % 20) as t2, (35 + game_id % 10) - (team_score - team_score_h1) as u2 from team_games)
       select game_id, home_away, case when s1 > 0 then 'won' when s1 < 0 then 'lost' else 'push' end as spread_h1, case when t2 > 0 then 'won' when t2 < 0 then 'lost' else 'push' end as total_h2, case when u2 > 0 then 'won' when u2 < 0 then 'lost' else 'push' end as team_h2 from a""")
def _(t):
    ask = lambda m, seg, sel, line: F.struct(F.lit(m).alias("market"), F.lit(seg).alias("segment"), sel.alias("selection"), line.cast("double").alias("line"))
    g = F.col("game_id")
    asks = t.team_games.select("game_id", "home_away", "team_score", "opponent_score", "team_score_h1", "opponent_score_h1", F.inline(F.array(
        ask("spread_h1", "h1", F.col("home_away"), g % 7 - 3), ask("total_points_h2", "h2", F.lit("over"), 70 + g % 20), ask("team_total_h2", "h2", F.concat("home_away", F.lit("_under")), 35 + g % 10))))
    pick = lambda m: F.max(F.when(F.col("market") == m, F.col("settled")))
    return X.settle_team(asks).groupBy("game_id", "home_away").agg(pick("spread_h1").alias("spread_h1"), pick("total_points_h2").alias("total_h2"), pick("team_total_h2").alias("team_h2"))


@query("player_settlement", "row_key:i market:s settled:s n:i",
       """with s as (select row_key, did_not_play, points, rebounds, assists, steals, blocks, (points >= 10)::int + (rebounds >= 10)::int + (assists >= 10)::int + (steals >= 10)::int + (blocks >= 10)::int as tens, 10 + row_key % 10 as l1 from player_games),
       a as (select row_key, did_not_play, unnest([{'m': 'player_points', 'd': points - (l1 + 0e0)}, {'m': 'player_pra', 'd': (20 + row_key % 9) - (points + rebounds + assists) + 0e0}, {'m': 'player_double_double', 'd': case when tens >= 2 then 0.5e0 else -0.5e0 end}]) as x from s)
       select row_key, x.m as market, case when did_not_play then 'void' when x.d > 0 then 'won' when x.d < 0 then 'lost' else 'push' end as settled, count(*) as n from a group by all""")
def _(t):
    ask = lambda m, sel, line: F.struct(F.lit(m).alias("market"), F.lit("game").alias("segment"), F.lit(sel).alias("selection"), line.cast("double").alias("line"))
    k = F.col("row_key")
    asks = t.player_games.select("*", F.inline(F.array(ask("player_points", "over", 10 + k % 10), ask("player_pra", "under", 20 + k % 9), ask("player_double_double", "over", F.lit(0.5)))))
    return X.settle_player(asks).groupBy("row_key", "market", "settled").agg(F.count("*").alias("n"))


@query("prop_grading", "market:s settled:s n:i",
       """with pl as (select game_id, 'Player ' || cast(game_id % 7 as varchar) as name, max(points) as points, bool_and(did_not_play) as dnp from player_games group by 1)
       select q.market, case when pl.dnp is null then 'unsettleable' when dnp then 'void' when (points - line) * case when selection = 'over' then 1 else -1 end > 0 then 'won' when points = line then 'push' else 'lost' end as settled, count(*) as n
       from quotes q left join pl on q.event_id = pl.game_id and q.player = pl.name where q.market like 'player_%' group by all""")
def _(t):
    rows = t.player_games.groupBy("game_id").agg(F.max("points").alias("points"), F.bool_and("did_not_play").alias("did_not_play"))
    stats = rows.select(F.col("game_id").alias("event_id"), F.concat(F.lit("Player "), (F.col("game_id") % 7).cast("string")).alias("player"), "points", "did_not_play")
    props = t.quotes.filter(F.col("market").startswith("player_"))
    return X.settle_player(props.join(stats, ["event_id", "player"], "left")).groupBy("market", "settled").agg(F.count("*").alias("n"))


@query("pick_grading", "game_id:i home:s over:s",
       """select game_id, case when home_score - away_score + (game_id % 9 - 4) > 0 then 'win' when home_score - away_score + (game_id % 9 - 4) < 0 then 'loss' else 'push' end as home,
       case when home_score + away_score - (140 + game_id % 40) > 0 then 'win' when home_score + away_score - (140 + game_id % 40) < 0 then 'loss' else 'push' end as over from schedule""")
def _(t):
    home = t.schedule.withColumns({"pick": F.lit("home"), "line": F.col("game_id") % 9 - 4}).withColumn("home", X.grade_pick())
    return home.withColumns({"pick": F.lit("over"), "line": 140 + F.col("game_id") % 40}).withColumn("over", X.grade_pick())
