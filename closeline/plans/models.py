"""Ratings, graph, projections, layers, and the user-function surface."""

from pyspark.sql import functions as F

from closeline import pricers, session

from closeline.operators import history as H, intervals as I, ledger as L, ratings as R, schedules as D
from closeline.plans import sql as S
from closeline.plans.registry import query
from closeline.plans.schedules import EVENTS, LOCAL, lines
from closeline.plans.history import PLACED, RATED, placed_games, rated


TIER_OF = "case {0} % 4 when 0 then 'high_major' when 1 then 'mid_major' when 2 then 'low_major' end"


def tier_table(t):
    """A tier for most teams; the rest are unplaced."""
    tier = F.when(F.col("team_id") % 4 == 0, "high_major").when(F.col("team_id") % 4 == 1, "mid_major").when(F.col("team_id") % 4 == 2, "low_major").otherwise("unplaced")
    return t.team_games.select("team_id").distinct().withColumn("tier", tier)


def _solved(system: str, size: int, name: str = "solved") -> str:
    """Gauss-Jordan over a system of (r, c, v): unknown r, right-hand sides from c = ``size`` on. Gives (r, c, v) of the solutions.

    Entries that aren't there are zero; the systems are positive definite, so no row is exchanged.
    """
    return f"""{name}_0 as (select r, c, cast(coalesce(sum(v), 0) as double) as v from (select unnest(range(0, {size})) as r) cross join (select distinct c from {system} union select unnest(range(0, {size}))) left join {system} using (r, c) group by all),
 {name}_s(step, r, c, v) as (select 0, r, c, v from {name}_0 union all
  select m.step + 1, m.r, m.c, case when m.r = m.step then m.v / p.v else m.v - f.v * q.v / p.v end from {name}_s m join {name}_s p on p.r = m.step and p.c = m.step join {name}_s q on q.r = m.step and q.c = m.c join {name}_s f on f.r = m.r and f.c = m.step where m.step < {size}),
 {name} as (select r, c, v from {name}_s where step = {size} and c >= {size})"""


# Venue effects: normal equations of the twelve columns, those of tiers with their penalty.
_PLACE = [f"venue_state = 'home' and {side}" for side in ("own", "other")]
_PLACE = [*_PLACE, *[f"{p} and tier = '{tier}'" for p in _PLACE for tier in R.VENUE_TIERS], *[f"venue_state = 'quasi_neutral' and {side}" for side in ("own", "other")]]
_X = ", ".join(f"case when {p} then 1e0 else 0e0 end" for p in _PLACE)
VENUE_FIT = f"""{PLACED}, {RATED}, lg as (select avg(eff) as le, avg(gp) as lp from prep),
 vx as (select p.*, coalesce({TIER_OF.format('lt')}, 'unplaced') as tier, eff - le - coalesce(o.offence, 0) - coalesce(d.defence, 0) as y, [{_X}] as x from prep p cross join lg left join rated o on o.team_id = p.team_id left join rated d on d.team_id = p.opponent_id),
 vm as (select i as r, j as c, sum(x[i + 1] * case when j = 12 then y else x[j + 1] end) + max(case when i = j and i between 2 and 9 then 50e0 else 0 end) as v from vx, range(0, 12) a(i), range(0, 13) b(j) group by i, j),
 {_solved('vm', 12, 'beta')}"""
_LABELS = ", ".join(f"'{c}'" for c in R.VENUE_COLUMNS)
_FITTED = " + ".join(f"x[{k + 1}] * (select v from beta where r = {k})" for k in range(12))
# Ridge systems of the 25 teams: offence of k is unknown k, defence 25 + k.
_PAIRS = """pr as (select team_id as i, opponent_id as j, count(*) as n, sum(y) as y from fr group by all),
 tn as (select t, row_number() over (order by t) - 1 as k from (select i as t from pr union select j from pr)),
 pk as (select a.k as i, 25 + b.k as j, n, y from pr join tn a on a.t = i join tn b on b.t = j)"""
_ENTRIES = "select i as r, j as c, n as v from pk union all select j, i, n from pk union all select i, i, n from pk union all select j, j, n from pk"
RIDGE = f"""{VENUE_FIT}, fr as (select p.*, eff - le - ({_FITTED}) as y from (select * exclude (y) from vx) p cross join lg), {_PAIRS},
 mx as ({_ENTRIES} union all select k, k, 8e0 from range(0, 50) a(k) union all select i, 50, y from pk union all select j, 50, y from pk union all select k, 51, 8e0 from range(0, 50) a(k)), {_solved('mx', 50)},
 tp as (select a.k as i, b.k as j, gp - lp as y from prep cross join lg join tn a on a.t = team_id join tn b on b.t = opponent_id where home_away = 'home'),
 tm as (select i as r, j as c, 1 as v from tp union all select j, i, 1 from tp union all select i, i, 1 from tp union all select j, j, 1 from tp union all select k, k, 8e0 from range(0, 25) a(k) union all select i, 25, y from tp union all select j, 25, y from tp), {_solved('tm', 25, 'pace')},
 ab as (select t, o.v as offence, d.v as defence, w.v as weight, p.v as tempo from tn join solved o on o.r = k and o.c = 50 join solved d on d.r = 25 + k and d.c = 50 join solved w on w.r = k and w.c = 51 join pace p on p.r = k and p.c = 25)"""


@query("efficiency_ridge", "team_id:i offence:d defence:d tempo:d offence_weight:d league_efficiency:d league_tempo:d residual_sd:d",
       f"""with recursive {RIDGE} select t as team_id, offence, defence, tempo, weight as offence_weight, le as league_efficiency, lp as league_tempo,
       (select stddev_samp(y - a.offence - b.defence) from fr join ab a on a.t = team_id join ab b on b.t = opponent_id) as residual_sd from ab cross join lg""")
def _(t):
    return R.fit(venue_termed(t))


def venue_termed(t):
    prepared = session.cut_lineage(R.prepare(*placed_games(t)))
    effects, _ = R.venue_effects(prepared, rated(t), tier_table(t))
    return R.with_venue_term(prepared, effects, tier_table(t))


@query("venue_terms", "game_id:i team_id:i venue_term:d", f"with recursive {VENUE_FIT} select game_id, team_id, {_FITTED} as venue_term from vx")
def _(t):
    return venue_termed(t)


_SHARED = ("venue_state = 'home' and own", "venue_state = 'home' and other", "venue_state = 'quasi_neutral' and own", "venue_state = 'quasi_neutral' and other")
SEASON = f"""{PLACED}, fr as (select *, eff - avg(eff) over () as y, [{', '.join(f'case when {p} then 1e0 else 0e0 end' for p in _SHARED)}] as x from prep), {_PAIRS},
 sx as (select a.k as i, 25 + b.k as j, 50 + m as c, x[m + 1] as v, y from fr join tn a on a.t = team_id join tn b on b.t = opponent_id, range(0, 4) z(m)),
 sm as ({_ENTRIES} union all select k, k, 1e0 from range(0, 54) a(k) union all select i, 54, y from pk union all select j, 54, y from pk
  union all select i, c, v from sx union all select c, i, v from sx union all select j, c, v from sx union all select c, j, v from sx union all select c, 54, v * y from sx
  union all select 50 + a, 50 + b, x[a + 1] * x[b + 1] from fr, range(0, 4) p(a), range(0, 4) q(b)), {_solved('sm', 54)}"""


@query("season_fit", "team_id:i offence:d defence:d home_offence:d home_defence:d quasi_offence:d quasi_defence:d residual_sd:d",
       f"""with recursive {SEASON}, g as (select max(v) filter (r = 50) as g0, max(v) filter (r = 51) as g1, max(v) filter (r = 52) as g2, max(v) filter (r = 53) as g3 from solved),
       ab as (select t, o.v as offence, d.v as defence from tn join solved o on o.r = k join solved d on d.r = 25 + k)
       select t as team_id, offence, defence, g0 as home_offence, g1 as home_defence, g2 as quasi_offence, g3 as quasi_defence,
       (select stddev_samp(y - a.offence - b.defence - g0 * x[1] - g1 * x[2] - g2 * x[3] - g3 * x[4]) from fr join ab a on a.t = team_id join ab b on b.t = opponent_id, g) as residual_sd from ab, g""")
def _(t):
    return R.season_fit(R.prepare(*placed_games(t)))


@query("normal_equation_sums", "i:i j:i n:i y:d yy:d", f"with {PLACED} select team_id as i, opponent_id as j, count(*) as n, sum(eff - 100) as y, sum(pow(eff - 100, 2)) as yy from prep group by all")
def _(t):
    return R.pair_sums(R.prepare(*placed_games(t)), F.col("efficiency") - 100.0)


_LINED = f"""{EVENTS}, l as (select s.home_id as i, s.away_id as j, case when flipped then 1 else -1 end * ((ask % 21 - 10) * 0.5e0) as m, 130e0 + ask % 40 as t from fx join schedule s on s.game_id = fx.game_id),
 lv as (select avg(m) as edge, count(*) as games, avg(t) as level from l), tn as (select t, row_number() over (order by t) - 1 as k from (select i as t from l union select j from l)),
 lk as (select a.k as i, b.k as j, m - edge as m, l.t - level as y from l cross join lv join tn a on a.t = i join tn b on b.t = j),
 own as (select i as r, i as c, 1e0 as v from lk union all select j, j, 1e0 from lk union all select k, k, 2e0 from range(0, 25) a(k)),
 mm as (select * from own union all select i, j, -1e0 from lk union all select j, i, -1e0 from lk union all select i, 25, m from lk union all select j, 25, -m from lk), {_solved('mm', 25, 'margins')},
 mt as (select * from own union all select i, j, 1e0 from lk union all select j, i, 1e0 from lk union all select i, 25, y from lk union all select j, 25, y from lk), {_solved('mt', 25, 'totals')}"""


@query("market_implied_ratings", "team_id:i margin_rating:d total_rating:d edge:d games:i level:d",
       f"with recursive {_LINED} select t as team_id, a.v as margin_rating, b.v as total_rating, edge, games, level from tn join margins a on a.r = k join totals b on b.r = k cross join lv")
def _(t):
    return R.market_fit(D.lined_games(lines(t), t.schedule, key="ask"))


@query("market_rating_inputs", "edge:d games:i level:d",
       f"with {EVENTS}, l as (select case when flipped then 1 else -1 end * ((ask % 21 - 10) * 0.5e0) as m, 130e0 + ask % 40 as t from fx where game_id is not null) select avg(m) as edge, count(*) as games, avg(t) as level from l")
def _(t):
    lined = D.lined_games(lines(t), t.schedule, key="ask")
    return lined.agg(F.avg("market_margin").alias("edge"), F.count("*").alias("games"), F.avg("market_total").alias("level"))


SRS = """pairs as (select season, team_id, opponent_id, count(*) as n, sum(margin) as m from team_games group by all), base as (select season, team_id, sum(m) / sum(n) as margin, sum(n) as g from pairs group by all),
 it(step, season, team_id, rating) as (select 0, season, team_id, margin from base union all
  select step + 1, season, team_id, v - avg(v) over (partition by season) from (select it.step as step, b.season as season, b.team_id as team_id, any_value(b.margin) + sum(p.n * it.rating) / sum(p.n) as v from it join pairs p on p.season = it.season and p.opponent_id = it.team_id join base b on b.season = p.season and b.team_id = p.team_id where it.step < 60 group by it.step, b.season, b.team_id)),
 srs as (select season, team_id, rating from it where step = 60)"""


@query("simple_rating_system", "season:i team_id:i games:i margin:d rating:d", f"with recursive {SRS} select b.season, b.team_id, g as games, margin, rating from base b join srs using (season, team_id)")
def _(t):
    return R.simple_ratings(t.team_games)


@query("strength_of_schedule", "season:i team_id:i strength:d", "with base as (select season, team_id, avg(margin) as r from team_games group by all) select g.season, g.team_id, avg(b.r) as strength from team_games g join base b on b.season = g.season and b.team_id = g.opponent_id group by all")
def _(t):
    ratings = t.team_games.groupBy("season", "team_id").agg(F.avg("margin").alias("rating"))
    return R.schedule_strength(t.team_games, ratings)


EDGES = "edges as (select c_custkey as a, 100000000 + (c_custkey * 7 + c_nationkey) % (select count(*) // 4 from customer) as b from customer)"


@query("graph_components", "node:i component:i size:i",
       f"""with recursive {EDGES}, e as (select a, b from edges union select b, a from edges), lab(step, node, label) as (select 0, a, a from e group by a union all
        select step + 1, node, min(label) from (select lab.step as step, lab.node as node, lab.label as label from lab where step < 40 union all select lab.step, e.a, lab.label from lab join e on e.b = lab.node where step < 40) group by step, node),
       fin as (select node, label from lab where step = 40) select node, label as component, count(*) over (partition by label) as size from fin""")
def _(t):
    groups = t.customer.agg(F.floor(F.count("*") / 4).alias("g"))
    edges = t.customer.crossJoin(F.broadcast(groups)).select(F.col("c_custkey").alias("a"), (100000000 + (F.col("c_custkey") * 7 + F.col("c_nationkey")) % F.col("g")).alias("b"))
    return R.components(edges, "a", "b")


# What the place adds: league's and tier's effect at home, one pair of effects on quasi-neutral ground.
EFFECTS = {"league offence": 1.5, "league defence": -1.25, "high_major offence": 0.5, "mid_major offence": 0.25, "low_major offence": -0.25, "unplaced offence": 0.0,
           "high_major defence": -0.5, "mid_major defence": 0.0, "low_major defence": 0.125, "unplaced defence": 0.0, "quasi offence": 0.75, "quasi defence": -0.5}


def _added(own: str, other: str) -> str:
    of = lambda side: f"{EFFECTS[f'league {side}']}e0 + case tier " + " ".join(f"when '{x}' then {EFFECTS[f'{x} {side}']}e0" for x in R.VENUE_TIERS) + " end"
    return (f"case when vs = 'home' and lt = {own} then {of('offence')} when vs = 'home' and lt = {other} then {of('defence')} "
            f"when vs = 'quasi_neutral' and lt = {own} then {EFFECTS['quasi offence']}e0 when vs = 'quasi_neutral' and lt = {other} then {EFFECTS['quasi defence']}e0 else 0 end")


@query("matchup_projection", "game_id:i margin:d total:d possessions:d priceable:b reason:s",
       f"""with {LOCAL}, {RATED}, f as (select game_id, home_id, away_id, loc.venue_state as vs, local_team_id as lt, coalesce({TIER_OF.format('local_team_id')}, 'unplaced') as tier from schedule join loc using (game_id)),
       x as (select f.*, 79 + a.offence + b.defence + {_added('home_id', 'away_id')} as h, 79 + b.offence + a.defence + {_added('away_id', 'home_id')} as w, 60 + a.tempo + b.tempo as po,
        case when vs = 'unknown' then 'venue unknown' when vs = 'quasi_neutral' and lt is null then 'local side unknown' when a.team_id is null or b.team_id is null then 'no rating' end as reason
        from f left join rated a on a.team_id = home_id left join rated b on b.team_id = away_id)
       select game_id, h * po / 100 - w * po / 100 as margin, h * po / 100 + w * po / 100 as total, po as possessions, reason is null as priceable, reason from x""")
def _(t):
    fixtures = t.schedule.select("game_id", "home_id", "away_id").join(D.local_sides(t.schedule), "game_id")
    ratings = rated(t).withColumns({"league_efficiency": F.lit(79.0), "league_tempo": F.lit(60.0)})
    effects = t.spark.createDataFrame(list(EFFECTS.items()), "effect string, value double")
    return R.matchups(fixtures, ratings, effects=effects, tiers=tier_table(t))


@query("prior_season_pairs", "season:i team_id:i previous:d current:d",
       """with r as (select season, team_id, avg(margin) as v from team_games group by all), b as (select a.season, a.team_id, p.v as previous, a.v as current from r a join r p on p.team_id = a.team_id and p.season = a.season - 1)
       select season, team_id, previous - avg(previous) over w as previous, current - avg(current) over w as current from b window w as (partition by season)""")
def _(t):
    return R.season_pairs(season_ratings(t), "rating")


def season_ratings(t):
    return t.team_games.groupBy("season", "team_id").agg(F.avg("margin").alias("rating"))


@query("carryover_fit", "pairs:i carryover:d held:i residual_sd:d",
       """with r as (select season, team_id, avg(margin) as v from team_games group by all), b as (select a.season, a.team_id, p.v as x0, a.v as y0 from r a join r p on p.team_id = a.team_id and p.season = a.season - 1),
       c as (select season, x0 - avg(x0) over w as x, y0 - avg(y0) over w as y, season = max(season) over () as late from b window w as (partition by season)), f as (select sum(x * y) / sum(x * x) as slope from c where not late)
       select (select count(*) from c) as pairs, (select sum(x * y) / sum(x * x) from c) as carryover, count(*) as held, stddev_samp(y - slope * x) as residual_sd from c, f where late""")
def _(t):
    return R.carryover(R.season_pairs(season_ratings(t), "rating"))


@query("venue_effects", "effect:s value:d", f"with recursive {VENUE_FIT} select [{_LABELS}][r + 1] as effect, v as value from beta")
def _(t):
    return R.venue_effects(R.prepare(*placed_games(t)), rated(t), tier_table(t))[0]


@query("venue_departures", "venue_id:i games:i departure:d",
       f"""with recursive {VENUE_FIT}, e as (select game_id, venue_id, own, y - ({_FITTED}) as e from vx where venue_state = 'home' and venue_id is not null),
       g as (select game_id, venue_id, (avg(e) filter (own) - avg(e) filter (not own)) / 2 as h from e group by all having h is not null),
       per as (select venue_id, count(*) as games, avg(h) as mean, var_samp(h) as var from g group by all),
       u as (select sum(coalesce(var, 0) * games) / sum(games) as within, count(*) / sum(1e0 / games) as harmonic, var_samp(mean) as observed from per where games >= 5), w as (select within, greatest(0, observed - within / harmonic) as between_ from u)
       select venue_id, games, case when between_ > 0 then games / (games + within / between_) * mean else 0 end as departure from per, w""")
def _(t):
    return R.venue_effects(R.prepare(*placed_games(t)), rated(t), tier_table(t))[1]


@query("reciprocal_home_edge", "tier:s " + S.INTERVAL,
       f"""with h as (select season, least(team_id, opponent_id) as lo, greatest(team_id, opponent_id) as hi, avg(margin) filter (team_id < opponent_id) as m1, avg(margin) filter (team_id > opponent_id) as m2 from team_games where home_away = 'home' and venue_state = 'home' group by all having m1 is not null and m2 is not null),
       p as (select (m1 + m2) / 2 as edge, lo || '-' || hi as pair, case greatest(nullif(lo % 4, 3), nullif(hi % 4, 3)) when 0 then 'high_major' when 1 then 'mid_major' when 2 then 'low_major' else 'unplaced' end as tier from h) {S.interval('p', 'tier', {'game': 'pair'}, 'edge')}""")
def _(t):
    names = F.array(*[F.lit(x) for x in D.TIERS])
    tiers = t.team_games.select("team_id").distinct().withColumn("tier", F.element_at(names, (F.col("team_id") % 4 + 1).cast("int")))
    return R.reciprocal_home_edge(t.team_games, tiers)


@query("score_fit_report", "season:i games:i home_variance:d away_variance:d correlation:d margin_variance:d total_variance:d",
       """with e as (select game_id, season, home_away, team_score - avg(team_score) over (partition by season, team_id) - avg(team_score) over (partition by season, opponent_id) + avg(team_score) over (partition by season) as e from team_games),
       s as (select season, game_id, max(e) filter (home_away = 'home') as h, max(e) filter (home_away = 'away') as a from e group by all)
       select season, count(*) as games, var_samp(h) as home_variance, var_samp(a) as away_variance, corr(h, a) as correlation, var_samp(h - a) as margin_variance, var_samp(h + a) as total_variance from s group by all""")
def _(t):
    return R.score_fit(t.team_games)


PRED = f"{RATED}, pr as (select g.game_id, g.slate_date as day, g.season, a.offence - a.defence - b.offence + b.defence as pm, 158 + a.offence + a.defence as pt, g.margin as am, g.total as at_, g.game_id % 7 - 3 as mm, g.game_id % 5 - 2 as mt from team_games g join rated a on a.team_id = g.team_id join rated b on b.team_id = g.opponent_id where g.home_away = 'home')"


def predicted(t):
    r = rated(t)
    a, b = r.select("team_id", F.col("offence").alias("o1"), F.col("defence").alias("d1")), r.select(F.col("team_id").alias("opponent_id"), F.col("offence").alias("o2"), F.col("defence").alias("d2"))
    g = t.team_games.filter("home_away = 'home'").join(a, "team_id").join(b, "opponent_id")
    return g.select("game_id", F.col("slate_date").alias("day"), "season", (F.col("o1") - F.col("d1") - F.col("o2") + F.col("d2")).alias("pred_margin"), (158 + F.col("o1") + F.col("d1")).alias("pred_total"),
                    F.col("margin").alias("actual_margin"), F.col("total").alias("actual_total"))


@query("forecast_accuracy", "season:i games:i margin_mae:d margin_bias:d total_mae:d winners:d",
       f"with {PRED} select season, count(*) as games, avg(abs(am - pm)) as margin_mae, avg(am - pm) as margin_bias, avg(abs(at_ - pt)) as total_mae, avg(case when sign(am) = sign(pm) and pm <> 0 then 1e0 else 0e0 end) as winners from pr group by all")
def _(t):
    return R.accuracy(predicted(t), ["season"])


@query("rating_moves", "team_id:i before:d after:d move:d",
       "with b as (select team_id, avg(margin) as before from team_games where slate_date < date '1998-01-01' group by all), a as (select team_id, avg(margin) as after from team_games group by all) select team_id, before, after, after - before as move from b full outer join a using (team_id)")
def _(t):
    means = lambda d: d.groupBy("team_id").agg(F.avg("margin").alias("rating"))
    return R.rating_moves(means(H.before(t.team_games, "1998-01-01")), means(t.team_games))


LAY = f"""{PRED}, lay as (select pr.*, 'form' as layer, true as on_ from pr union all select pr.*, 'pace', false from pr), mv as (select *, mm * case layer when 'form' then 1 else 0.5e0 end as move_m, cast(mt as double) as move_t from lay where abs(mm * case layer when 'form' then 1 else 0.5e0 end) + abs(mt) > 0.01),
 wi as (select *, case when on_ then pm else pm + move_m end as wm, case when on_ then pt else pt + move_t end as wt from mv),
 ga as (select *, am - wm + move_m as rm, at_ - wt + move_t as rt, pow(am - wm + move_m, 2) - pow(am - wm, 2) + pow(at_ - wt + move_t, 2) - pow(at_ - wt, 2) as gain from wi)"""


def layered(t):
    move = F.col("game_id") % 7 - 3
    layer = lambda n, on, k: F.struct(F.lit(n).alias("layer"), F.lit(on).alias("on"), (move * k).cast("double").alias("move_m"), (F.col("game_id") % 5 - 2).cast("double").alias("move_t"))
    return predicted(t).select("*", F.inline(F.array(layer("form", True, 1.0), layer("pace", False, 0.5))))


@query("layer_gains", "game_id:i layer:s gain:d", f"with {LAY} select game_id, layer, gain from ga")
def _(t):
    return R.layer_gains(layered(t))


@query("layer_verdicts", "layer:s games:i days:i gain:d standard_error:d z:d best_scale:d gain_at_best_scale:d switched_on:b",
       f"""with {LAY}, m as (select layer, avg(gain) as mean, count(*) as n, count(distinct day) as days, any_value(on_) as on_, sum(move_m * rm + move_t * rt) / sum(move_m * move_m + move_t * move_t) as k, sum(move_m * rm + move_t * rt) as mr, sum(move_m * move_m + move_t * move_t) as mmv from ga group by all),
       c as (select ga.layer, day, sum(gain - mean) as s from ga join m using (layer) group by all), e as (select layer, sum(s * s) * count(*) / (count(*) - 1e0) as v from c group by all)
       select layer, n as games, days, mean as gain, sqrt(v) / n as standard_error, mean / (sqrt(v) / n) as z, k as best_scale, (2 * k * mr - k * k * mmv) / n as gain_at_best_scale,
       case when n < 200 or days < 5 then on_ when on_ and mean / (sqrt(v) / n) <= -2 then false when not on_ and mean / (sqrt(v) / n) >= 2 then true else on_ end as switched_on from m join e using (layer)""")
def _(t):
    return R.layer_verdicts(R.layer_gains(layered(t))).withColumnRenamed("on", "switched_on")


@query("factor_layers", "game_id:i margin:d total:d",
       f"with {PRED} select game_id, pm + 0.3e0 * mm + case when season % 2 = 0 then 1e0 else 0e0 end as margin, pt + 0.5e0 * mt as total from pr")
def _(t):
    base = predicted(t).select("game_id", "season", F.col("pred_margin").alias("margin"), F.col("pred_total").alias("total"))
    layers = [
        pricers.Layer("form", margin=lambda: 0.3 * (F.col("game_id") % 7 - 3)),
        pricers.Layer("pace", total=lambda: 0.5 * (F.col("game_id") % 5 - 2)),
        pricers.Layer("home", margin=lambda: F.when(F.col("season") % 2 == 0, 1.0).otherwise(0.0)),
        pricers.Layer("travel", margin=lambda: F.lit(99.0), on=False),
    ]
    return pricers.apply_layers(base, layers)


@query("pricer_callback", "event_id:i partkey:i suppkey:i probability:d priced_through:t",
       f"""with pd as (select event_id, partkey, suppkey, slate_date, tier from quotes), h as (select tier, slate_date, count(*) filter (outcome = 'won') as w, count(*) as n from quotes group by all),
       r as (select tier, slate_date, sum(w) over x as w, sum(n) over x as n, lag(slate_date) over (partition by tier order by slate_date) as pt from h window x as (partition by tier order by slate_date rows between unbounded preceding and 1 preceding))
       select event_id, partkey, suppkey, (coalesce(w, 0) + 5) / (coalesce(n, 0) + 10e0) as probability, pt as priced_through from pd join r using (tier, slate_date)""")
def _(t):
    priced = pricers.walk_forward(t.quotes, t.quotes.select("slate_date", "tier", "outcome"), pricers.resolve("base_rate"))
    return L.assert_walk_forward(priced)


@query("python_pricer_callback", "event_id:i partkey:i suppkey:i probability:d",
       "select event_id, partkey, suppkey, least(0.95e0, greatest(0.05e0, 0.5e0 + payout / 100)) as probability from quotes")
def _(t):
    return pricers.price_batches(t.quotes.select("event_id", "partkey", "suppkey", "payout"), lambda pdf: (0.5 + pdf["payout"] / 100).clip(0.05, 0.95))


