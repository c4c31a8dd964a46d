"""Player features, trailing evidence, fitted constants."""

from pyspark.sql import functions as F

from closeline.functions import prices as P
from closeline.operators import players as L
from closeline.plans.registry import query

TEAM = """pf as (select *, sum(minutes) over w as tm, sum(field_goals_attempted) over w as tfga, sum(field_goals_made) over w as tfgm, sum(free_throws_attempted) over w as tfta, sum(turnovers) over w as tto, sum(offensive_rebounds) over w as tor, sum(defensive_rebounds) over w as tdr
 from player_games where minutes > 0 window w as (partition by game_id, team_id)),
 px as (select *, minutes * 5 / nullif(tm, 0) as ms, field_goals_attempted + 0.44e0 * free_throws_attempted + turnovers as used, tfga + 0.44e0 * tfta + tto as tused from pf),
 feats as (select *, used / nullif(tused * ms, 0) as usage_rate, field_goals_attempted / nullif(tfga * ms, 0) as shot_share, assists / nullif((tfgm - field_goals_made) * ms, 0) as assist_rate, turnovers / nullif(used, 0) as turnover_rate,
  offensive_rebounds / nullif(tor * ms, 0) as off_reb_rate, defensive_rebounds / nullif(tdr * ms, 0) as def_reb_rate, 40 * blocks / minutes as block_rate, 40 * points / minutes as points_per_40, points / nullif(2 * (field_goals_attempted + 0.44e0 * free_throws_attempted), 0) as true_shooting_pct,
  points + 0.4e0 * field_goals_made - 0.7e0 * field_goals_attempted - 0.4e0 * (free_throws_attempted - free_throws_made) + 0.7e0 * offensive_rebounds + 0.3e0 * defensive_rebounds + steals + 0.7e0 * assists + 0.7e0 * blocks - 0.4e0 * fouls - turnovers as game_score from px)"""


@query("team_totals_join", "row_key:i athlete_id:i minutes_share:d usage_rate:d shot_share:d assist_rate:d turnover_rate:d off_reb_rate:d def_reb_rate:d block_rate:d points_per_40:d true_shooting_pct:d game_score:d",
       f"with {TEAM} select row_key, athlete_id, ms as minutes_share, usage_rate, shot_share, assist_rate, turnover_rate, off_reb_rate, def_reb_rate, block_rate, points_per_40, true_shooting_pct, game_score from feats")
def _(t):
    return L.game_features(t.player_games)


@query("roster_features", "game_id:i team_id:i bench_minutes_share:d bench_points_share:d usage_concentration:d",
       f"""with {TEAM}, u as (select *, sum(usage_rate) over (partition by game_id, team_id) as su from feats)
       select game_id, team_id, sum(case when not starter then minutes else 0 end) / sum(minutes) as bench_minutes_share, sum(case when not starter then points else 0 end) / greatest(sum(points), 1) as bench_points_share, sum(pow(usage_rate / nullif(su, 0), 2)) as usage_concentration from u group by all""")
def _(t):
    return L.roster_features(L.game_features(t.player_games))


@query("feature_calibration", "season:i player_games:i team_games:i mean_shares:d mean_weighted_usage:d true_shooting_pct:d points_per_40:d game_score:d",
       f"""with {TEAM}, g as (select season, game_id, team_id, sum(ms) as s, sum(usage_rate * ms) as u from feats group by all), s as (select season, count(*) as team_games, avg(s) as mean_shares, avg(u) as mean_weighted_usage from g group by all),
       m as (select season, count(*) as player_games, avg(true_shooting_pct) as true_shooting_pct, avg(points_per_40) as points_per_40, avg(game_score) as game_score from feats group by all) select * from m join s using (season)""")
def _(t):
    return L.feature_calibration(L.game_features(t.player_games))


ORDERED = """pu as (select * from player_games),
 tr0 as (select *, not did_not_play and minutes > 0 as played, coalesce(count(*) filter (not did_not_play and minutes > 0) over w, 0) as prior_games, coalesce(sum(minutes) filter (not did_not_play and minutes > 0) over w, 0) as prior_minutes,
  coalesce(sum(points) filter (not did_not_play and minutes > 0) over w, 0) as bank_points, coalesce(sum(rebounds) filter (not did_not_play and minutes > 0) over w, 0) as bank_rebounds,
  coalesce(sum(free_throws_made) filter (not did_not_play and minutes > 0) over w, 0) as bank_ones, coalesce(sum(three_made) filter (not did_not_play and minutes > 0) over w, 0) as bank_threes, coalesce(sum(greatest(field_goals_made - three_made, 0)) filter (not did_not_play and minutes > 0) over w, 0) as bank_twos
  from pu window w as (partition by {key} order by slate_date, row_key rows between unbounded preceding and 1 preceding))"""


def trailing_sql(key: str = "season, athlete_id", half: str = "4e0") -> str:
    same = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    return ORDERED.replace("{key}", key) + f""", ew as (select a.row_key, a.athlete_id, sum(b.minutes * pow(0.5e0, (a.prior_games - 1 - b.prior_games) / {half})) / sum(pow(0.5e0, (a.prior_games - 1 - b.prior_games) / {half})) as pm
 from tr0 a join tr0 b on {same} and b.played and b.prior_games < a.prior_games and (b.slate_date, b.row_key) < (a.slate_date, a.row_key) group by all),
 tr as (select tr0.*, pm as projected_minutes, case when pm is null then -1 else least(8, greatest(0, cast(floor((round(pm, 9) - 4) / 4e0) as bigint))) end as bucket from tr0 left join ew using (row_key, athlete_id))"""


TR = trailing_sql("athlete_id")
PRICED = TR + ", priced as (select * from tr where played and prior_games >= 4 and prior_minutes >= 60)"


def trail(t, **kw):
    return L.with_trailing(t.player_games, keys=("athlete_id",), **kw)


@query("trailing_weighted_mean", "row_key:i athlete_id:i prior_games:i prior_minutes:d bank_points:d projected_minutes:d bucket:i", f"with {TR} select row_key, athlete_id, prior_games, prior_minutes, bank_points, projected_minutes, bucket from tr")
def _(t):
    return trail(t)


@query("trailing_evidence", "athlete_id:i row_key:i prior_games:i projected_minutes:d bank_rebounds:d", f"with {TR} select athlete_id, row_key, prior_games, projected_minutes, bank_rebounds from tr qualify row_number() over (partition by athlete_id order by slate_date desc, row_key desc) = 1")
def _(t):
    return L.latest_evidence(trail(t), ["athlete_id"])


@query("role_prior_cut", "team_id:i season:i n:i", "select team_id, season, count(*) as n from player_games where slate_date < date '1999-03-01' and season in (1998, 1999) and team_id in (select distinct team_id from player_games where minutes >= 39.9e0 and points >= 30) group by all")
def _(t):
    teams = t.player_games.filter("minutes >= 39.9 and points >= 30").select("team_id").distinct()
    return L.prior_roster(t.player_games, "1999-03-01", 1999, teams).groupBy("team_id", "season").agg(F.count("*").alias("n"))


@query("half_life_curve", "half_life:d rmse:d rows:i",
       f"""with {TR}, hl as (select unnest([2e0, 4e0, 8e0, 16e0]) as h), e as (select a.row_key, a.athlete_id, h, sum(b.minutes * pow(0.5e0, (a.prior_games - 1 - b.prior_games) / h)) / sum(pow(0.5e0, (a.prior_games - 1 - b.prior_games) / h)) as pm
        from tr0 a join tr0 b on a.athlete_id = b.athlete_id and b.played and b.prior_games < a.prior_games and (b.slate_date, b.row_key) < (a.slate_date, a.row_key), hl where a.played and a.prior_games >= 4 and a.prior_minutes >= 60 group by all)
       select h as half_life, sqrt(avg(pow(minutes - pm, 2))) as rmse, count(*) as rows from e join tr0 using (row_key, athlete_id) group by all
       union all select null, sqrt(avg(pow(minutes - prior_minutes / prior_games, 2))), count(*) from tr0 where played and prior_games >= 4 and prior_minutes >= 60""")
def _(t):
    rows = t.player_games.withColumn("season", F.lit(0))
    return L.half_life_curve(rows)


@query("role_priors", "bucket:i rows:i points:d rebounds:d", f"with {PRICED} select bucket, count(*) as rows, sum(points) / sum(minutes) as points, sum(rebounds) / sum(minutes) as rebounds from priced group by all")
def _(t):
    return L.role_priors(L.priced(trail(t)))


@query("absence_rates", "bucket:i rows:i absent_share:d", f"with {TR} select bucket, count(*) as rows, avg(case when played then 0e0 else 1e0 end) as absent_share from tr where prior_games >= 4 group by all")
def _(t):
    return L.absence_rates(trail(t))


KS = [0.5, 2.0, 8.0, 32.0, 128.0, 512.0, 2048.0]


@query("credibility_constant", "k:d loss:d best:b",
       f"""with {PRICED}, pr as (select bucket, sum(points) / sum(minutes) as pr from priced group by all), g as (select unnest({KS}) as k),
       l as (select k, sum(minutes * pow(points / minutes - pr - prior_minutes / (prior_minutes + k) * (bank_points / prior_minutes - pr), 2)) / sum(minutes) as loss from priced join pr using (bucket), g group by all)
       select k, loss, loss = min(loss) over () as best from l""")
def _(t):
    rows = L.priced(trail(t))
    return L.credibility_losses(rows, L.role_priors(rows), "points", KS)


@query("credibility_refined", "k:d loss:d",
       f"""with recursive {PRICED}, pr as (select bucket, sum(points) / sum(minutes) as pr from priced group by all),
       b as (select prior_minutes as p, minutes as m, points / minutes - pr as r, bank_points / prior_minutes - pr as g from priced join pr using (bucket)),
       c as (select round(p, 9) as p, sum(m * r * g) as rg, sum(m * g * g) as gg from b group by 1), tot as (select sum(m) as m, sum(m * r * r) as rr from b),
       rec(round_, low, high, k, loss, last_step) as (select 0, 0.1e0, 10000e0, 0e0, 0e0, 0e0 union all
        select round_ + 1, greatest(0.1e0, arg_min(k, loss) / step), least(10000e0, arg_min(k, loss) * step), arg_min(k, loss), min(loss), step from (select round_, step, k, (any_value(rr) - 2 * sum(p / (p + k) * rg) + sum(pow(p / (p + k), 2) * gg)) / any_value(tot.m) as loss
         from (select round_, pow(high / low, 1e0 / 24) as step, low * pow(pow(high / low, 1e0 / 24), i) as k from rec, range(0, 25) x(i) where round_ < 30 and (round_ = 0 or last_step > 1.0001e0)) z, c, tot group by round_, step, k) group by round_, step)
       select round(k, 3) as k, loss from rec qualify round_ = max(round_) over ()""")
def _(t):
    rows = L.priced(trail(t))
    k, loss = L.credibility(rows, L.role_priors(rows), "points")
    return t.spark.createDataFrame([(round(k, 3), loss)], "k double, loss double")


@query("credibility_by_band", "band:i rows:i k:d loss:d enough:b",
       f"""with {PRICED}, pr as (select bucket, sum(points) / sum(minutes) as pr from priced group by all), g as (select unnest({KS}) as k),
       l as (select case when prior_minutes >= 400.3e0 then 2 when prior_minutes >= 150.3e0 then 1 else 0 end as band, k, count(*) as rows, sum(minutes * pow(points / minutes - pr - prior_minutes / (prior_minutes + k) * (bank_points / prior_minutes - pr), 2)) / sum(minutes) as loss from priced join pr using (bucket), g group by all)
       select band, rows, k, loss, rows >= 500 as enough from l qualify row_number() over (partition by band order by loss, k) = 1""")
def _(t):
    rows = L.priced(trail(t))
    return L.credibility_by_band(rows, L.role_priors(rows), "points", KS, [150.3, 400.3])


@query("value_mix", "ones:d twos:d threes:d events:i mean:d variance:d",
       """with s as (select sum(free_throws_made) as a, sum(greatest(field_goals_made - three_made, 0)) as b, sum(three_made) as c from player_games where not did_not_play), p as (select a / (a + b + c + 0e0) as ones, b / (a + b + c + 0e0) as twos, c / (a + b + c + 0e0) as threes, a + b + c as events from s)
       select *, ones + 2 * twos + 3 * threes as mean, ones + 4 * twos + 9 * threes - pow(ones + 2 * twos + 3 * threes, 2) as variance from p""")
def _(t):
    return L.value_pmf(t.player_games)


@query("value_mix_prior_size", "k:d loss:d",
       f"""with {PRICED}, s as (select sum(free_throws_made) as a, sum(greatest(field_goals_made - three_made, 0)) as b, sum(three_made) as c from pu where not did_not_play), p as (select a / (a + b + c + 0e0) as p1, b / (a + b + c + 0e0) as p2, c / (a + b + c + 0e0) as p3 from s),
       g as (select unnest({KS}) as k), n as (select *, bank_ones + bank_twos + bank_threes as n from priced)
       select k, -2 * avg(free_throws_made * ln((bank_ones + k * p1) / (n + k)) + greatest(field_goals_made - three_made, 0) * ln((bank_twos + k * p2) / (n + k)) + three_made * ln((bank_threes + k * p3) / (n + k))) as loss from n, p, g group by all""")
def _(t):
    rows = L.with_values(t.player_games)
    priced = L.priced(L.with_trailing(rows, keys=("athlete_id",), banks=("ones", "twos", "threes")))
    return L.value_mix_losses(priced, L.value_pmf(rows), KS)


@query("pooled_dispersion", "stat:s used:i cells:i vmr:d",
       " union all ".join(f"select '{s}' as stat, sum(n) as used, count(*) as cells, sum(n * v) / (sum(n) - count(*)) / (sum(x) / sum(n)) as vmr from (select season, athlete_id, count(*) as n, var_pop({s}) as v, sum({s}) as x from player_games where not did_not_play group by all having count(*) >= 2)" for s in ("points", "rebounds", "assists")))
def _(t):
    return L.pooled_vmr(t.player_games.filter("not did_not_play"), ["points", "rebounds", "assists"], ["season", "athlete_id"])


@query("quasi_poisson_dispersion", "stat:s used:i phi:d",
       " union all ".join(f"select '{s}' as stat, sum(n) as used, sum(chi) / (sum(n) - count(*)) as phi from (select season, athlete_id, any_value(n) as n, sum(pow({s} - r * minutes, 2) / (r * minutes)) as chi from (select *, count(*) over w as n, sum({s}) over w / sum(minutes) over w as r from player_games where minutes > 0 window w as (partition by season, athlete_id)) where n >= 2 and r > 0 group by all)" for s in ("points", "steals")))
def _(t):
    return L.pearson_dispersion(t.player_games, ["points", "steals"])


CORR = ("points", "rebounds", "assists")
_PAIRS = [("points", "rebounds"), ("points", "assists"), ("rebounds", "assists")]


@query("residual_correlations", "rows:i left_stat:s right_stat:s correlation:d",
       "with r as (select *, count(*) over w as n, " + ", ".join(f"{s} - avg({s}) over w as e_{s}" for s in CORR) + " from player_games where not did_not_play window w as (partition by season, athlete_id, cast(floor(minutes / 8) as bigint))), k as (select * from r where n >= 2) "
       + " union all ".join(f"select count(*) as rows, '{a}' as left_stat, '{b}' as right_stat, sum(e_{a} * e_{b}) / sqrt(sum(e_{a} * e_{a}) * sum(e_{b} * e_{b})) as correlation from k" for a, b in _PAIRS))
def _(t):
    rows = t.player_games.filter("not did_not_play").withColumn("cell", F.floor(F.col("minutes") / 8))
    return L.residual_correlations(rows, CORR, ["season", "athlete_id", "cell"]).withColumnsRenamed({"left": "left_stat", "right": "right_stat"})


@query("compound_targets", "events_vmr:d measured:d implied:d ratio:d",
       """with v as (select free_throws_made + greatest(field_goals_made - three_made, 0) + three_made as e, free_throws_made + 2 * greatest(field_goals_made - three_made, 0) + 3 * three_made as p, season, athlete_id, free_throws_made as a, greatest(field_goals_made - three_made, 0) as b, three_made as c from player_games where not did_not_play),
       g as (select season, athlete_id, count(*) as n, var_pop(e) as ve, sum(e) as se, var_pop(p) as vp, sum(p) as sp from v group by all having count(*) >= 2), x as (select sum(n * ve) / (sum(n) - count(*)) / (sum(se) / sum(n)) as events_vmr, sum(n * vp) / (sum(n) - count(*)) / (sum(sp) / sum(n)) as measured from g),
       m as (select (sum(a) + 2 * sum(b) + 3 * sum(c)) / (sum(a) + sum(b) + sum(c) + 0e0) as mean, (sum(a) + 4 * sum(b) + 9 * sum(c)) / (sum(a) + sum(b) + sum(c) + 0e0) as sq from v)
       select events_vmr, measured, (sq - mean * mean) / mean + events_vmr * mean as implied, measured / ((sq - mean * mean) / mean + events_vmr * mean) as ratio from x, m""")
def _(t):
    return L.compound_targets(t.player_games.filter("not did_not_play"), ["season", "athlete_id"])


TOT = "tot as (select season, team_id, athlete_id, sum(minutes) as m, min(case when minutes > 0 then slate_date end) as fd from player_games where not did_not_play group by all), mt as (select season, athlete_id, arg_max(team_id, (m, team_id)) as mt, sum(m) as sm from tot group by all)"


@query("roster_evidence", "season:i team_id:i athlete_id:i first_slate_date:t previous_minutes:d previous_team_id:i",
       f"with {TOT} select t.season, t.team_id, t.athlete_id, fd as first_slate_date, coalesce(sm, 0) as previous_minutes, mt as previous_team_id from tot t left join mt on mt.athlete_id = t.athlete_id and mt.season = t.season - 1 where fd is not null and t.season - 1 in (select season from tot)")
def _(t):
    return L.roster_evidence(t.player_games)


@query("roster_turnover", "season:i teams:i returning_mean:d returning_median:d incoming_mean:d",
       f"""with {TOT}, r as (select p.season + 1 as season, p.team_id, sum(p.m) as t, sum(case when c.athlete_id is not null then p.m else 0 end) as r from tot p left join tot c on c.season = p.season + 1 and c.team_id = p.team_id and c.athlete_id = p.athlete_id group by all having sum(p.m) > 0),
       i as (select c.season, c.team_id, sum(c.m) as t2, sum(case when mt.mt <> c.team_id then c.m else 0 end) as i from tot c left join mt on mt.season = c.season - 1 and mt.athlete_id = c.athlete_id group by all having sum(c.m) > 0)
       select r.season, count(*) as teams, avg(r / t) as returning_mean, quantile_cont(r / t, 0.5) as returning_median, avg(i / t2) as incoming_mean from r left join i using (season, team_id) where r.season in (select season from tot) group by all""")
def _(t):
    return L.roster_turnover(t.player_games)


@query("rate_shrinkage", "row_key:i athlete_id:i rate:d one_share:d",
       f"""with {PRICED}, pr as (select bucket, sum(points) / sum(minutes) as pr from priced group by all), s as (select sum(free_throws_made) as a, sum(greatest(field_goals_made - three_made, 0)) as b, sum(three_made) as c from pu where not did_not_play)
       select row_key, athlete_id, (bank_points + 50 * pr) / (prior_minutes + 50) as rate, case when bank_ones + bank_twos + bank_threes > 0 then (bank_ones + 20 * a / (a + b + c + 0e0)) / (bank_ones + bank_twos + bank_threes + 20) else a / (a + b + c + 0e0) end as one_share from priced join pr using (bucket), s""")
def _(t):
    rows = L.with_values(t.player_games)
    priced = L.priced(L.with_trailing(rows, keys=("athlete_id",), banks=("points", "ones", "twos", "threes")))
    priors = L.role_priors(priced, ["points"]).select("bucket", F.col("points").alias("prior"))
    out = priced.join(F.broadcast(priors), "bucket").crossJoin(F.broadcast(L.value_pmf(rows).select(F.col("ones").alias("league_ones"))))
    events = F.col("bank_ones") + F.col("bank_twos") + F.col("bank_threes")
    return out.withColumns({"rate": P.shrink(F.col("bank_points") / F.col("prior_minutes"), F.col("prior_minutes"), F.col("prior"), F.lit(50.0)),
                            "one_share": P.shrink(F.try_divide(F.col("bank_ones"), events), events, F.col("league_ones"), F.lit(20.0))})


REF = "case when did_not_play then 'did not play' when minutes < 8 then 'too few minutes' when points is null then 'no stat' else '' end"


@query("refusal_census", "refusal:s athletes:i", f"select {REF} as refusal, count(*) as athletes from player_games group by all")
def _(t):
    return L.refusal_census(projections(t))


def projections(t):
    refusal = F.when(F.col("did_not_play"), "did not play").when(F.col("minutes") < 8, "too few minutes").when(F.col("points").isNull(), "no stat").otherwise("")
    tier = F.when(F.col("team_id") % 3 == 0, "high_major").when(F.col("team_id") % 3 == 1, "mid_major").otherwise("low_major")
    return t.player_games.withColumns({"refusal": refusal, "tier": tier, "resolved": F.col("athlete_id") % 20 != 0})


@query("resolution_census", "tier:s athletes:i resolved_share:d priceable_share:d points_behind:d",
       f"""with c as (select case team_id % 3 when 0 then 'high_major' when 1 then 'mid_major' else 'low_major' end as tier, count(*) as athletes, avg(case when athlete_id % 20 <> 0 then 1e0 else 0e0 end) as resolved_share, avg(case when {REF} = '' then 1e0 else 0e0 end) as priceable_share from player_games group by all)
       select *, 100 * (max(priceable_share) over () - priceable_share) as points_behind from c""")
def _(t):
    return L.resolution_census(projections(t))
