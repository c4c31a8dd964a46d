"""Team history, play-by-play, ratings inputs."""

from pyspark.sql import functions as F

from closeline.functions import prices as P
from closeline.operators import history as H, ledger as L, plays as Y, ratings as R, schedules as D, segments as G
from closeline.plans import sql as S
from closeline.plans.registry import query
from closeline.plans.schedules import CLASS, LOCAL, schedule

OPP = "opp as (select a.*, b.possessions as possessions_opp, b.field_goals_made as fgm_o, b.field_goals_attempted as fga_o, b.three_made as tm_o, b.three_attempted as ta_o, b.free_throws_attempted as fta_o, b.offensive_rebounds as or_o, b.defensive_rebounds as dr_o, b.turnovers as to_o, b.steals as st_o, b.team_score as sc_o from team_games a join team_games b on a.game_id = b.game_id and a.opponent_id = b.team_id and a.home_away <> b.home_away)"
NET = OPP + ", net as (select *, (possessions + possessions_opp) / 2 as gp, 100e0 * margin / ((possessions + possessions_opp) / 2) as net from opp)"


@query("opponent_self_join", "game_id:i team_id:i opponent_id:i margin:i total:i opponent_turnovers:i",
       f"with {OPP} select game_id, team_id, opponent_id, team_score - sc_o as margin, team_score + sc_o as total, to_o as opponent_turnovers from opp")
def _(t):
    f = H.with_opponent(t.team_games)
    return f.select("game_id", "team_id", "opponent_id", (F.col("team_score") - F.col("team_score_opp")).alias("margin"), (F.col("team_score") + F.col("team_score_opp")).alias("total"), F.col("turnovers_opp").alias("opponent_turnovers"))


FEATS = """feats as (select game_id, team_id, season, slate_date, home_away, margin, (field_goals_made + 0.5e0 * three_made) / field_goals_attempted as efg_pct, turnovers / possessions as turnover_rate, offensive_rebounds / cast(offensive_rebounds + dr_o as double) as off_reb_pct,
 defensive_rebounds / cast(defensive_rebounds + or_o as double) as def_reb_pct, free_throws_attempted / cast(field_goals_attempted as double) as free_throw_rate, (fgm_o + 0.5e0 * tm_o) / fga_o as efg_pct_allowed, to_o / possessions_opp as turnover_rate_forced,
 fta_o / cast(fga_o as double) as free_throw_rate_allowed, (turnovers - st_o) / possessions as non_steal_turnover_rate, 100 * team_score / possessions as off_efficiency, 100 * opponent_score / possessions_opp as def_efficiency,
 100 * team_score / possessions - 100 * opponent_score / possessions_opp as net_efficiency, team_score / (2 * (field_goals_attempted + 0.44e0 * free_throws_attempted)) as true_shooting_pct, three_attempted / cast(field_goals_attempted as double) as three_point_rate,
 ta_o / cast(fga_o as double) as three_point_rate_allowed, (field_goals_made - three_made) / cast(field_goals_attempted - three_attempted as double) as two_point_pct, three_made / cast(three_attempted as double) as three_point_pct, free_throws_made / cast(free_throws_attempted as double) as free_throw_pct,
 assists / cast(field_goals_made as double) as assist_rate, team_score / cast(field_goals_attempted as double) as points_per_shot, 3 * three_made / cast(team_score as double) as points_share_three, free_throws_made / cast(team_score as double) as points_share_free_throw,
 1 - 3 * three_made / cast(team_score as double) - free_throws_made / cast(team_score as double) as points_share_two, blocks / cast(fga_o - ta_o as double) as block_rate, steals / possessions_opp as steal_rate, possessions as tempo from opp)"""
FCOLS = "efg_pct turnover_rate off_reb_pct def_reb_pct free_throw_rate efg_pct_allowed turnover_rate_forced free_throw_rate_allowed non_steal_turnover_rate off_efficiency def_efficiency net_efficiency true_shooting_pct three_point_rate three_point_rate_allowed two_point_pct three_point_pct free_throw_pct assist_rate points_per_shot points_share_three points_share_free_throw points_share_two block_rate steal_rate tempo".split()


@query("opponent_features_join", "game_id:i team_id:i " + " ".join(f"{c}:d" for c in FCOLS), f"with {OPP}, {FEATS} select game_id, team_id, {', '.join(FCOLS)} from feats")
def _(t):
    return H.game_features(t.team_games)


PRIOR = ["margin", "efg_pct", "tempo"]


@query("prior_expanding_mean", "game_id:i team_id:i home_away:s prior_margin:d prior_efg_pct:d prior_tempo:d",
       f"""with {OPP}, {FEATS} select game_id, team_id, home_away, {', '.join(f'avg({c}) over w as prior_{c}' for c in PRIOR)} from feats window w as (partition by team_id, season order by slate_date, game_id, home_away rows between unbounded preceding and 1 preceding)""")
def _(t):
    feats = H.game_features(t.team_games)
    return H.prior_means(feats, ["team_id", "season"], PRIOR, order=("slate_date", "game_id", "home_away"))


@query("prior_expanding_mean_generic", "game_id:i team_id:i home_away:s prior_total:d",
       "select game_id, team_id, home_away, case when count(total) over w >= 5 then avg(total) over w end as prior_total from team_games window w as (partition by team_id order by slate_date, game_id, home_away rows between unbounded preceding and 1 preceding)")
def _(t):
    return H.prior_means(t.team_games, ["team_id"], ["total"], minimum=5, order=("slate_date", "game_id", "home_away"))


@query("walk_forward_pricing", "game_id:i team_id:i home_away:s probability:d priced_through:t",
       f"""with w as (select *, count(*) over d as n, avg(margin) over d as m, max(slate_date) over d as pt from team_games window d as (partition by team_id order by slate_date range between unbounded preceding and interval 1 day preceding))
       select game_id, team_id, home_away, case when n > 0 then {S.normal_cdf('m / 11e0')} end as probability, pt as priced_through from w""")
def _(t):
    days = t.team_games.groupBy("team_id", "slate_date").agg(F.sum("margin").alias("m"), F.count("*").alias("n"))
    run = G.running_before(days, ["team_id"], ["slate_date"], {"pm": F.col("m"), "pn": F.col("n")}, [F.trunc("slate_date", "month")])
    through = G.previous_row(run, ["team_id"], ["slate_date"], {"priced_through": F.col("slate_date")}, F.trunc("slate_date", "month"))
    priced = t.team_games.select("game_id", "team_id", "home_away", "slate_date").join(through.select("team_id", "slate_date", "pm", "pn", "priced_through"), ["team_id", "slate_date"])
    out = priced.withColumn("__z", F.when(F.col("pn") > 0, F.col("pm") / F.col("pn") / 11.0)).withColumn("probability", F.when(F.col("__z").isNotNull(), P.normal_cdf("__z")))
    return L.assert_walk_forward(out)


@query("past_only_reprice", "compared:i differing:i", "select count(*) as compared, 0 as differing from team_games where slate_date < date '1998-06-01'")
def _(t):
    """Values before a day, computed with and without the rows from that day on."""
    cols = ["game_id", "team_id", "home_away", "prior_margin"]
    order = ("slate_date", "game_id", "home_away")
    rounded = lambda d: d.select(*cols).withColumn("prior_margin", F.round("prior_margin", 6))
    whole = rounded(H.prior_means(t.team_games, ["team_id"], ["margin"], order=order).filter("slate_date < '1998-06-01'"))
    cut = rounded(H.prior_means(H.before(t.team_games, "1998-06-01"), ["team_id"], ["margin"], order=order))
    differing = L.differences(whole, cut).agg(F.count("*").alias("differing"))
    return cut.agg(F.count("*").alias("compared")).crossJoin(F.broadcast(differing))


@query("reprice_equality", "only_in:s n:i",
       "select 'left' as only_in, count(*) filter (margin > 30) as n from team_games union all select 'right', count(*) filter (margin > 30) from team_games")
def _(t):
    base = t.team_games.select("game_id", "team_id", "home_away", "margin")
    moved = base.withColumn("margin", F.when(F.col("margin") > 30, F.col("margin") + 1000).otherwise(F.col("margin")))
    return L.differences(base, moved).groupBy("only_in").agg(F.count("*").alias("n"))


@query("feature_collinearity", "feature:s correlation:d", f"with {OPP}, {FEATS} " + " union all ".join(f"select '{c}' as feature, corr({c}, margin) as correlation from feats" for c in FCOLS))
def _(t):
    return H.collinearity(H.game_features(t.team_games), FCOLS, "margin")


RATED = "rated as (select team_id, avg(team_score) - 79 as offence, avg(opponent_score) - 79 as defence, avg(possessions) - 60 as tempo from team_games group by all)"


def rated(t):
    return t.team_games.groupBy("team_id").agg((F.avg("team_score") - 79).alias("offence"), (F.avg("opponent_score") - 79).alias("defence"), (F.avg("possessions") - 60).alias("tempo"))


@query("form_last_games", "team_id:i games:i form:d",
       f"""with {NET}, {RATED}, r as (select * from net qualify row_number() over (partition by team_id order by slate_date desc, game_id desc) <= 5)
       select r.team_id, count(*) as games, greatest(-3, least(3, avg(net - (a.offence + b.defence - b.offence - a.defence)) * count(*) / (count(*) + 15e0))) as form from r join rated a on a.team_id = r.team_id join rated b on b.team_id = r.opponent_id group by all""")
def _(t):
    return H.form(t.team_games, rated(t))


@query("pace_form", "team_id:i games:i pace:d",
       f"""with {NET}, {RATED}, r as (select * from net qualify row_number() over (partition by team_id order by slate_date desc, game_id desc) <= 5)
       select r.team_id, count(*) as games, greatest(-6, least(6, avg(gp - (a.tempo + b.tempo) / 2) * count(*) / (count(*) + 5e0))) as pace from r join rated a on a.team_id = r.team_id join rated b on b.team_id = r.opponent_id group by all""")
def _(t):
    return H.pace_form(t.team_games, rated(t))


@query("days_since_last_game", "team_id:i days:i season_day:i games:i",
       "select team_id, date_diff('day', max(slate_date), date '1999-02-01') as days, date_diff('day', min(slate_date), date '1999-02-01') as season_day, count(*) as games from team_games where slate_date < date '1999-02-01' group by all")
def _(t):
    return H.days_since_last(t.team_games, "1999-02-01")


def team_tiers(t):
    return t.team_games.select("team_id").distinct().withColumn("tier", F.when(F.col("team_id") % 3 == 0, "high_major").when(F.col("team_id") % 3 == 1, "mid_major").otherwise("unplaced"))


@query("rest_effects", "scope:s bucket:s n:i effect:d",
       f"""with {NET}, g as (select *, date_diff('day', lag(slate_date) over (partition by season, team_id order by slate_date, game_id), slate_date) as d from net),
       b as (select *, case when d < 1 then null when d = 1 then 'second game in two days' when d = 2 then 'one day off' when d <= 5 then 'ordinary rest' when d > 5 then 'six or more days off' end as bucket from g),
       x as (select *, net - avg(net) over (partition by season, team_id) as r from b where bucket is not null), y as (select *, r - avg(r) over (partition by venue_state, home_away) as e, case team_id % 3 when 0 then 'high_major' when 1 then 'mid_major' else 'unplaced' end as tier from x),
       c as (select 'league' as scope, bucket, sum(e) as s, count(*) as n from y group by all union all select tier, bucket, sum(e), count(*) from y where tier <> 'unplaced' group by all),
       rf as (select scope, s / n as base, n as rn from c where bucket = 'ordinary rest')
       select c.scope, bucket, n, greatest(-2, least(2, (s / n - coalesce(base, 0)) * n / (n + 300e0))) as effect from c left join rf using (scope) where bucket <> 'ordinary rest' and (c.scope = 'league' or (n >= 150 and rn >= 150))""")
def _(t):
    return H.rest_effects(t.team_games, team_tiers(t))


def lineup(t):
    return t.player_games.select("game_id", F.col("team_id"), "athlete_name", "did_not_play", "minutes", "points", "slate_date", "row_key")


@query("missing_rotation", "team_id:i missing:i share:d factor:d",
       """with pg as (select *, athlete_id % 12 as p from player_games), tg as (select distinct team_id, game_id, slate_date from pg), rc as (select *, row_number() over (partition by team_id order by slate_date desc, game_id desc) as k from tg qualify k <= 8),
       rw as (select pg.team_id, 'P' || cast(p as varchar) as name, rc.k, not did_not_play and minutes > 0 as on_, minutes, points from pg join rc on pg.team_id = rc.team_id and pg.game_id = rc.game_id),
       pp as (select team_id, name, count(*) filter (on_) as ap, sum(case when on_ then minutes else 0 end) as mi, sum(case when on_ then points else 0 end) as po, bool_or(on_ and k <= 1) as last from rw group by all),
       tp as (select team_id, sum(po) as tpo from pp group by all having sum(po) > 0)
       select team_id, count(*) as missing, sum(po / tpo) as share, greatest(0.92, 1 - 0.5 * sum(po / tpo)) as factor from pp join tp using (team_id) where ap >= 3 and mi / ap >= 18 and not last group by all""")
def _(t):
    players = lineup(t).withColumn("athlete_name", F.concat(F.lit("P"), (F.substring("athlete_name", 8, 20).cast("long") % 12).cast("string")))
    games = t.player_games.select("team_id", "game_id", "slate_date").distinct()
    return H.missing_rotation(players, games)


def _luck(excess):
    return f"""select team_id, count(*) as games, greatest(-3, least(3, 0.5 * 100 * sum({excess}) / sum(gp))) as luck from net, lg group by team_id having count(*) >= 5"""


@query("three_point_luck", "team_id:i games:i luck:d", f"with {NET}, lg as (select sum(three_made) / cast(sum(three_attempted) as double) as r3 from net) " + _luck("3 * (tm_o - r3 * ta_o)"))
def _(t):
    return H.three_point_luck(t.team_games)


@query("shooting_luck", "team_id:i games:i luck:d", f"with {NET}, lg as (select sum(three_made) / cast(sum(three_attempted) as double) as r3, sum(free_throws_made) / cast(sum(free_throws_attempted) as double) as r1 from net) " + _luck("3 * (three_made - r3 * three_attempted) + free_throws_made - r1 * free_throws_attempted"))
def _(t):
    return H.shooting_luck(t.team_games)


@query("four_factor_rows", "game_id:i team_id:i home_away_n:i fgm3:d fga:i orb_d:i ppp:d",
       f"with {NET} select game_id, team_id, count(*) as home_away_n, any_value(field_goals_made + 0.5e0 * three_made) as fgm3, any_value(field_goals_attempted) as fga, any_value(offensive_rebounds + dr_o) as orb_d, any_value(100 * team_score / gp) as ppp from net group by all")
def _(t):
    return H.four_factor_rows(t.team_games).withColumn("home_away_n", F.lit(1))


@query("four_factors", "season:i team_id:i efg:d tov:d orb:d ftr:d",
       f"with {NET} select season, team_id, sum(field_goals_made + 0.5e0 * three_made) / sum(field_goals_attempted) as efg, sum(turnovers) / sum(gp) as tov, sum(offensive_rebounds) / cast(sum(offensive_rebounds + dr_o) as double) as orb, sum(free_throws_made) / cast(sum(field_goals_attempted) as double) as ftr from net group by all")
def _(t):
    return H.factor_rates(H.four_factor_rows(t.team_games), ["season", "team_id"])


@query("resume", "team_id:i games:i wins:i wins_above_bubble:d luck:d",
       f"""with {RATED}, b as (select min(n) as bubble from (select offence - defence as n from rated order by n desc, team_id limit 10)),
       x as (select g.team_id, g.margin, (a.tempo + c.tempo + 120) / 2 as poss, a.offence - a.defence as n1, c.offence - c.defence as n2, case when g.neutral_site then 0 when g.home_away = 'home' then 1 else -1 end * 3e0 * 100 / greatest((a.tempo + c.tempo + 120) / 2, 1) as site
         from team_games g join rated a on a.team_id = g.team_id join rated c on c.team_id = g.opponent_id),
       y as (select x.*, bubble, (bubble - n2 + site) * poss / 100 / 11 as z1, (n1 - n2 + site) * poss / 100 / 11 as z2 from x, b)
       select team_id, count(*) as games, count(*) filter (margin > 0) as wins, round(count(*) filter (margin > 0) - sum({S.normal_cdf('z1')}), 2) as wins_above_bubble,
        greatest(-2, least(2, 5e0 * (count(*) filter (margin > 0) - sum({S.normal_cdf('z2')})) / count(*) * count(*) / (count(*) + 10))) as luck from y group by all""")
def _(t):
    ratings = rated(t).withColumn("tempo", F.col("tempo") + 60)
    return H.resume(t.team_games, ratings, bubble_rank=10)


@query("pythagorean_and_luck", "season:i team_id:i games:i expected:d luck:d",
       "select season, team_id, count(*) as games, pow(sum(team_score), 8) / (pow(sum(team_score), 8) + pow(sum(opponent_score), 8)) as expected, avg(case when margin > 0 then 1e0 else 0e0 end) - pow(sum(team_score), 8) / (pow(sum(team_score), 8) + pow(sum(opponent_score), 8)) as luck from team_games group by all")
def _(t):
    return H.pythagorean(t.team_games)


@query("daily_decay_check", "team_id:i slate_date:t rise:d",
       """with d as (select team_id, slate_date, avg(margin) as m from team_games group by all), l as (select *, m - lag(m) over (partition by team_id order by slate_date) as rise from d)
       select team_id, slate_date, rise from l where rise > 25""")
def _(t):
    daily = t.team_games.groupBy("team_id", "slate_date").agg(F.avg("margin").alias("m"))
    return H.decay_rises(daily, ["team_id"], "m", 25.0)


FT = "regexp_replace(lower(type_text), '[^a-z]', '', 'g') in ('madefreethrow', 'missedfreethrow')"
ENDS = f"""ends as (select *, (scoring_play and score_value > 0 and not ft) or lower(type_text) like '%defensive rebound%' or lower(type_text) like '%turnover%' or (ft and scoring_play and not coalesce(nft and nteam = team_id, false)) as ends
 from (select *, lead(ft) over w as nft, lead(team_id) over w as nteam from (select *, {FT} as ft from plays) window w as (partition by game_id order by play_no)))"""


@query("free_throw_and_made_goal", "game_id:i play_no:i free_throw:b made_goal:b", f"select game_id, play_no, {FT} as free_throw, scoring_play and score_value > 0 and not {FT} as made_goal from plays")
def _(t):
    return t.plays.withColumns({"free_throw": Y.is_free_throw(), "made_goal": Y.is_made_goal()})


@query("possession_end", "game_id:i play_no:i ends:b", f"with {ENDS} select game_id, play_no, ends from ends")
def _(t):
    return Y.with_possession_ends(t.plays)


@query("possession_number", "game_id:i play_no:i possession:i", f"with {ENDS} select game_id, play_no, coalesce(sum(cast(ends as int)) over (partition by game_id order by play_no rows between unbounded preceding and 1 preceding), 0) as possession from ends")
def _(t):
    return Y.possession_numbers(t.plays)


@query("possession_validation", "games:i mean_gap:d median_gap:d sd_gap:d correlation:d",
       f"""with {ENDS}, c as (select game_id, count(*) filter (ends) as counted, sum(value) as v from ends group by all), e as (select counted, 0.9e0 * counted + cast(floor(round(v * 100)) as bigint) % 17 as estimated from c)
       select count(*) as games, avg(estimated - counted) as mean_gap, quantile_cont(round(estimated - counted, 6), 0.5) as median_gap, stddev_samp(estimated - counted) as sd_gap, corr(estimated, counted) as correlation from e""")
def _(t):
    counted = Y.with_possession_ends(t.plays).groupBy("game_id").agg(F.count_if("ends").alias("c"), F.sum("value").alias("v"))
    estimated = counted.select("game_id", (0.9 * F.col("c") + F.floor(F.round(F.col("v") * 100)) % 17).alias("estimated"))
    return Y.possession_validation(estimated, t.plays)


ZONE = "case when score_value = 3 then 'three' when type_text in ('LayUpShot', 'DunkShot', 'TipShot') then 'rim' when type_text = 'JumpShot' then 'mid' end"


@query("shot_zone_by_label", "zone:s attempts:i made:i", f"select {ZONE} as zone, count(*) as attempts, count(*) filter (scoring_play) as made from plays where shooting_play group by all")
def _(t):
    return Y.attempts(t.plays).groupBy("zone").agg(F.count("*").alias("attempts"), F.count_if("made").alias("made"))


ZS = f"""z as (select game_id, team_id, {', '.join(f"count(*) filter ({ZONE} = '{x}') as attempts_{x}, count(*) filter ({ZONE} = '{x}' and scoring_play) as makes_{x}" for x in ('rim', 'mid', 'three'))} from plays where shooting_play group by all)"""


@query("zones_allowed_join", "game_id:i team_id:i fga:i attempts_rim:i makes_three:i attempts_rim_allowed:i makes_mid_allowed:i rim_rate:d efg_pct:d",
       f"""with {ZS} select a.game_id, a.team_id, a.attempts_rim + a.attempts_mid + a.attempts_three as fga, a.attempts_rim, a.makes_three, b.attempts_rim as attempts_rim_allowed, b.makes_mid as makes_mid_allowed,
       a.attempts_rim / cast(a.attempts_rim + a.attempts_mid + a.attempts_three as double) as rim_rate, (a.makes_rim + a.makes_mid + 1.5e0 * a.makes_three) / (a.attempts_rim + a.attempts_mid + a.attempts_three) as efg_pct from z a join z b on a.game_id = b.game_id and a.team_id <> b.team_id""")
def _(t):
    return Y.team_game_zones(t.plays)


@query("shot_quality_join", "team_id:i games:i attack:d defence:d",
       f"""with {ZS}, zz as (select a.game_id * 2 + w.w as game_id, a.team_id - a.game_id * 2 as side, a.* exclude (game_id, team_id), w.w from z a, (select unnest([0, 1]) as w) w), tg as (select game_id, team_id, opponent_id, home_away, gp from (with {NET} select * from net)),
       m as (select tg.*, z.attempts_rim, z.makes_rim, z.attempts_mid, z.makes_mid from tg join z on tg.game_id = z.game_id and (case when home_away = 'home' then 0 else 1 end) = z.team_id - z.game_id * 2),
       lg as (select sum(makes_rim) / cast(sum(attempts_rim) as double) as r, sum(makes_mid) / cast(sum(attempts_mid) as double) as d from m),
       o as (select m.*, 2 * makes_rim - 2 * r * attempts_rim + 2 * makes_mid - 2 * d * attempts_mid as e from m, lg),
       j as (select a.team_id, a.gp, a.e, coalesce(b.e, 0) as al from o a left join o b on a.game_id = b.game_id and a.opponent_id = b.team_id)
       select team_id, count(*) as games, greatest(-3, least(3, 50 * sum(e) / sum(gp))) as attack, greatest(-3, least(3, 50 * sum(al) / sum(gp))) as defence from j group by all having count(*) >= 5""")
def _(t):
    zones = Y.attempts(t.plays).groupBy("game_id", F.when(F.col("team_id") == F.col("home_team_id"), "home").otherwise("away").alias("home_away")).agg(
        *[F.count_if(F.col("zone") == z).alias(f"attempts_{z}") for z in ("rim", "mid")], *[F.count_if((F.col("zone") == z) & F.col("made")).alias(f"makes_{z}") for z in ("rim", "mid")])
    sides = t.team_games.select("game_id", "team_id", "home_away").join(zones, ["game_id", "home_away"]).drop("home_away")
    return H.shot_quality(t.team_games, sides)


GEO = """geo as (select *, case when own then x0 else -x0 end as x, case when own then y0 else -y0 end as y, case when scoring_play then score_value else 0 end as points from
 (select *, team_id = home_team_id as own, coordinate_x as x0, coordinate_y as y0 from plays where shooting_play and abs(coordinate_x) <= 1000 and abs(coordinate_y) <= 1000)),
 gz as (select *, case when dist >= 22.146 and abs(y) >= 21 then 'corner_three' when dist >= 22.146 and dist < 26 then 'above_break_three' when dist >= 22.146 then 'deep_three' when dist <= 4 then 'rim' when dist <= 6 then 'short_paint' else 'mid_range' end as fz from (select *, sqrt(pow(41.75 - x, 2) + y * y) as dist from geo))"""


def shots(t):
    return Y.geometry(Y.attempts(t.plays))


@query("shot_geometry", "game_id:i play_no:i x:d y:d distance:d", f"with {GEO} select game_id, play_no, x, y, dist as distance from gz")
def _(t):
    return shots(t)


@query("shot_zone_by_geometry", "floor_zone:s attempts:i points:d", f"with {GEO} select fz as floor_zone, count(*) as attempts, sum(points) as points from gz group by all")
def _(t):
    return shots(t).groupBy("floor_zone").agg(F.count("*").alias("attempts"), F.sum("points").alias("points"))


@query("geometry_agreement", "attempts:i agree:i share:d", f"with {GEO} select count(*) as attempts, count(*) filter (case when dist >= 22.146 then 3 else 2 end = score_value) as agree, count(*) filter (case when dist >= 22.146 then 3 else 2 end = score_value) / cast(count(*) as double) as share from gz where score_value in (2, 3)")
def _(t):
    return Y.geometry_agreement(shots(t))


@query("zone_baseline", "floor_zone:s attempts:i share:d points_per_attempt:d", f"with {GEO} select fz as floor_zone, count(*) as attempts, count(*) / cast((select count(*) from gz) as double) as share, sum(points) / cast(count(*) as double) as points_per_attempt from gz group by all")
def _(t):
    return Y.zone_baseline(shots(t))


PROFILE = f"""with {GEO}, p as (select team_id % 40 as team_id, fz, count(*) as attempts, sum(points) / cast(count(*) as double) as ppa from gz group by all), s as (select team_id, sum(attempts) as total from p group by all)
select p.team_id, fz as floor_zone, attempts, attempts / total as share, ppa as points_per_attempt, case when attempts >= 10 then rank() over (partition by fz order by case when attempts >= 10 then ppa end desc nulls last) end as rank,
count(case when attempts >= 10 then 1 end) over (partition by fz) as field from p join s using (team_id)"""


@query("zone_ranks", "team_id:i floor_zone:s attempts:i share:d points_per_attempt:d rank:i field:i", PROFILE)
def _(t):
    return Y.zone_profile(shots(t).withColumn("offense_id", F.col("offense_id") % 40), "offense", minimum=10)


@query("charted_share", "season:i games:i charted:i share:d",
       """with c as (select game_id, bool_or(abs(coordinate_x) <= 1000 and abs(coordinate_y) <= 1000) as c from plays where shooting_play group by all)
       select season, count(*) as games, count(*) filter (c) as charted, count(*) filter (c) / cast(count(*) as double) as share from schedule left join c using (game_id) group by all""")
def _(t):
    return Y.charted_share(t.plays, t.schedule)


@query("attribution_census", "shots:i home:i away:i neither:i", "select count(*) as shots, count(*) filter (team_id = home_team_id) as home, count(*) filter (team_id = away_team_id) as away, count(*) filter (team_id <> home_team_id and team_id <> away_team_id) as neither from plays where shooting_play")
def _(t):
    return Y.attribution_census(t.plays)


@query("period_ends_and_first_basket", "game_id:i periods:i overtime:b home_score_h1:i away_score_h1:i first_basket_athlete_id:i first_basket_team_id:i home_first_basket_athlete_id:i away_first_basket_athlete_id:i",
       f"""with p as (select *, scoring_play and score_value > 0 and not {FT} as mg from plays) select game_id, max(period_number) as periods, max(period_number) > 2 as overtime,
       coalesce(sum(score_value) filter (period_number = 1 and team_id = home_team_id and scoring_play), 0) as home_score_h1, coalesce(sum(score_value) filter (period_number = 1 and team_id <> home_team_id and scoring_play), 0) as away_score_h1,
       arg_min(athlete_id, play_no) filter (mg) as first_basket_athlete_id, arg_min(team_id, play_no) filter (mg) as first_basket_team_id, arg_min(athlete_id, play_no) filter (mg and team_id = home_team_id) as home_first_basket_athlete_id,
       arg_min(athlete_id, play_no) filter (mg and team_id <> home_team_id) as away_first_basket_athlete_id from p group by all""")
def _(t):
    return Y.game_segments(t.plays)


@query("first_basket_settlement", "game_id:i athlete_id:i side:s game_first:s team_first:s",
       f"""with p as (select *, scoring_play and score_value > 0 and not {FT} as mg from plays),
       s as (select game_id, arg_min(athlete_id, play_no) filter (mg) as fa, arg_min(team_id, play_no) filter (mg) as ft, arg_min(athlete_id, play_no) filter (mg and team_id = home_team_id) as ha, arg_min(athlete_id, play_no) filter (mg and team_id <> home_team_id) as aa from p group by all),
       r as (select distinct game_id, athlete_id, team_id, case when team_id = home_team_id then 'home' else 'away' end as side from plays)
       select r.game_id, athlete_id, side, case when fa is null then 'unsettleable' when athlete_id = fa then 'won' else 'lost' end as game_first,
       case when case side when 'home' then ha else aa end is not null then case when athlete_id = case side when 'home' then ha else aa end then 'won' else 'lost' end when ft is null or ft <> team_id then 'unsettleable' when athlete_id = fa then 'won' else 'lost' end as team_first from r join s using (game_id)""")
def _(t):
    from closeline.operators import settle as X

    who = t.plays.select("game_id", "athlete_id", "team_id", F.when(F.col("team_id") == F.col("home_team_id"), "home").otherwise("away").alias("home_away")).distinct()
    rows = who.join(Y.game_segments(t.plays), "game_id").withColumns({"segment": F.lit("game"), "selection": F.lit("over"), "line": F.lit(0.5), "did_not_play": F.lit(False)})
    asks = rows.withColumn("market", F.explode(F.array(*[F.lit(m) for m in X.FIRST_BASKET])))
    pick = lambda m: F.max(F.when(F.col("market") == m, F.col("settled")))
    return X.settle_player(asks).groupBy("game_id", "athlete_id", F.col("home_away").alias("side")).agg(pick(X.FIRST_BASKET[0]).alias("game_first"), pick(X.FIRST_BASKET[1]).alias("team_first"))


@query("as_of_join", "event_id:i last_value:d last_at:i",
       """with p as (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all)
       select e.event_id, p.value as last_value, epoch_us(p.ts) as last_at from events e asof left join p on e.user_id = p.user_id and e.ts >= p.ts""")
def _(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    bought = rows.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    found = G.as_of(rows.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["last_value"], [F.date_trunc("day", "ts")], right_at="last_at")
    return found.withColumn("last_at", F.unix_micros("last_at"))


PLACED = f"""{CLASS}, {LOCAL}, {NET}, placed as (select n.* exclude (venue_state), 100 * team_score / gp as eff, loc.venue_state, loc.venue_id,
  case loc.venue_state when 'home' then case when home_away = 'home' then team_id else opponent_id end when 'quasi_neutral' then local_team_id end as lt,
  case when game_state <> 'countable' then 'not countable' when loc.venue_state = 'unknown' then 'venue unknown' when periods is null then 'periods unknown' when periods <> 2 then 'overtime' when gp < 40 then 'too few possessions' end as left_out
  from net n join loc using (game_id) join (select game_id, game_state from classified) using (game_id)),
 prep as (select *, coalesce(lt = team_id, false) as own, coalesce(lt = opponent_id, false) as other from placed where left_out is null)"""


def placed_games(t):
    """Team games with the states of their schedule row, and the side that is local."""
    sides = D.local_sides(t.schedule)
    states = D.classify(schedule(t)).select("game_id", "game_state")
    return t.team_games.drop("venue_state").join(sides.select("game_id", "venue_state", "venue_id"), "game_id").join(states, "game_id"), sides


@query("rating_input", "game_id:i team_id:i efficiency:d game_possessions:d local_team_id:i is_local:b opponent_is_local:b",
       f"with {PLACED} select game_id, team_id, eff as efficiency, gp as game_possessions, lt as local_team_id, own as is_local, other as opponent_is_local from prep")
def _(t):
    return R.prepare(*placed_games(t))


@query("rating_input_counts", "reason:s rows:i",
       f"with {PLACED} select coalesce(left_out, case when venue_state = 'quasi_neutral' and lt is null then 'kept, local side unknown' else 'kept' end) as reason, count(*) as rows from placed group by all")
def _(t):
    return R.preparation_counts(*placed_games(t))
