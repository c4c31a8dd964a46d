"""Intervals, calibration, scores, regression."""

from pyspark.sql import functions as F

from closeline.functions import prices as P
from closeline.operators import calibration as K, captures as M, intervals as I, ledger as L, quotes as Q
from closeline.plans import sql as S
from closeline.plans.registry import query

LOOKS = 12
Z12 = I.adjusted_z(LOOKS)
GAME = {"game": "event_id"}
BOTH = {"game": "event_id", "day": "slate_date"}
THREE = {**BOTH, "athlete": "subject"}
IV = S.INTERVAL


@query("cluster_interval", "market:s tier:s " + IV, S.interval("bets", "market, tier", GAME, z=Z12))
def _(t):
    return I.interval(t.bets, [["market", "tier"]], GAME, looks=LOOKS)


@query("two_way_interval", "market:s tier:s " + IV, S.interval("bets", "market, tier", BOTH, z=Z12))
def _(t):
    return I.interval(t.bets, [["market", "tier"]], BOTH, looks=LOOKS)


@query("three_way_interval", "market:s " + IV, S.interval("bets", "market", THREE, z=Z12))
def _(t):
    return I.interval(t.bets, [["market"]], THREE, looks=LOOKS)


@query("interval_as_aggregate", "subject:i " + IV, S.interval("bets", "subject", {"game": "slate_date"}, z=Z12))
def _(t):
    return I.interval(t.bets, [["subject"]], {"game": "slate_date"}, looks=LOOKS)


_HELD = "(bets >= 200 and adjusted_high > adjusted_low and not (adjusted_low <= 0 and adjusted_high >= 0))"


@query("interval_record", "subject:i roi:d bets:i detectable_effect:d powered_effect:d enough_evidence:b survives_correction:b inside_bounds:b verdict:s",
       f"""select subject, roi, bets, case when standard_error > 0 then {Z12!r}e0 * standard_error end as detectable_effect, case when standard_error > 0 then ({Z12!r}e0 + 0.8416212335729143e0) * standard_error end as powered_effect,
       bets >= 200 as enough_evidence, {_HELD} as survives_correction, roi >= adjusted_low and roi <= adjusted_high as inside_bounds, verdict from ({S.interval("bets", "subject", {"game": "slate_date"}, z=Z12)})""")
def _(t):
    return I.record(I.interval(t.bets, [["subject"]], {"game": "slate_date"}, looks=LOOKS), LOOKS)


@query("cluster_mean_by_column", "season:i " + IV, S.interval("team_games", "season", {"game": "game_id"}, "margin"))
def _(t):
    return I.interval(t.team_games, [["season"]], {"game": "game_id"}, "margin")


@query("clustered_mean", "team_id:i mean:d standard_error:d rows:i clusters:i",
       """with m as (select team_id, avg(margin) as mean, count(*) as n from team_games group by 1),
       c as (select t.team_id, slate_date, sum(margin - mean) as s, any_value(mean) as mean, any_value(n) as n from team_games t join m using (team_id) group by 1, 2)
       select team_id, any_value(mean) as mean, sqrt(sum(s * s) * count(*) / (count(*) - 1e0)) / any_value(n) as standard_error, any_value(n) as rows, count(*) as clusters from c group by 1""")
def _(t):
    return I.clustered_mean(t.team_games, "margin", "slate_date", ["team_id"])


CELLS = f"""select market, tier, 'market and tier' as level, * exclude (market, tier) from ({S.interval('bets', 'market, tier', BOTH, z=Z12)})
union all by name select tier, 'tier' as level, * exclude (tier) from ({S.interval('bets', 'tier', BOTH, z=Z12)})
union all by name select market, 'market' as level, * exclude (market) from ({S.interval('bets', 'market', BOTH, z=Z12)})
union all by name select 'pooled' as level, * from ({S.interval('bets', '', BOTH, z=Z12)})"""


@query("roi_by_market_and_tier", "market:s tier:s level:s " + IV, CELLS)
def _(t):
    levels = F.array(*[F.lit(x) for x in ("market and tier", "tier", "market", "pooled")])
    out = I.interval(t.bets, [["market", "tier"], ["tier"], ["market"], []], BOTH, looks=LOOKS)
    return out.withColumn("level", F.element_at(levels, F.col("grouping") + 1))


PAIRED = """paired as (select *, case when selection = 'away' then -coalesce(line, 0) when selection = 'home' then coalesce(line, 0) else line end as pl from quotes),
grouped as (select event_id, market, segment, lower(player) as lp, selection in ('home', 'away') as hk, pl, count(*) as n, count(distinct selection) as s, sum(raw_implied) as total
  from paired where pl is not null {book_filter} group by all{book_group}),
devigged as (select p.*, g.total, g.n, g.s, case when g.n = 2 and g.s = 2 and g.total > 1 then raw_implied / g.total end as fair,
  case when g.n = 2 and g.s = 2 and g.total > 1 then g.total end as overround, case when p.pl is null then 'unknown selection' when g.n = 1 then 'no complement'
   when g.n <> 2 or g.s <> 2 then 'not two sided' when not g.total > 1 then 'overround not above one' else '' end as refusal
  from paired p left join grouped g on p.event_id = g.event_id and p.market = g.market and p.segment = g.segment and lower(p.player) = g.lp and (p.selection in ('home', 'away')) = g.hk and p.pl = g.pl)"""
DEVIG = PAIRED.format(book_filter="", book_group="")
SCORED = DEVIG + """, scored as (select *, case when outcome = 'won' then 1e0 else 0e0 end as won, model_probability - fair as disagreement
  from devigged where fair is not null and model_probability is not null and outcome in ('won', 'lost'))"""


def scored(t):
    return K.scorable(Q.devig(t.quotes))


@query("devig_proportional", "event_id:i partkey:i suppkey:i market:s fair:d overround:d refusal:s", f"with {DEVIG} select event_id, partkey, suppkey, market, fair, overround, refusal from devigged")
def _(t):
    return Q.devig(t.quotes).withColumnRenamed("market_implied", "fair")


@query("devig_census", "market:s refusal:s n:i", f"with {DEVIG} select market, refusal, count(*) as n from devigged group by all")
def _(t):
    return Q.devig(t.quotes).groupBy("market", "refusal").agg(F.count("*").alias("n"))


@query("devig_power", "event_id:i partkey:i suppkey:i fair:d power:d k:d",
       f"""with {DEVIG}, k as (select event_id, partkey, suppkey, fair, raw_implied as a, overround - raw_implied as b from devigged)
       select event_id, partkey, suppkey, fair, {S.power_fair('a', 'b')} as power, {S.power_k('a', 'b')} as k from k""")
def _(t):
    return Q.devig(t.quotes, power=True).withColumnsRenamed({"market_implied": "fair", "fair_power": "power", "devig_exponent": "k"})


@query("overround_summary", "pairs:i median:d mean:d low:d high:d",
       f"with {DEVIG} select count(*) / 2 as pairs, quantile_cont(overround, 0.5) as median, avg(overround) as mean, min(overround) as low, max(overround) as high from devigged where overround is not null")
def _(t):
    return K.overround_summary(Q.devig(t.quotes))


@query("scored_population_census", "tier:s devigged:i no_model_probability:i push:i void:i unsettleable:i other_outcome:i scored:i",
       f"""with {DEVIG} select tier, count(*) as devigged, count(*) filter (model_probability is null) as no_model_probability,
       count(*) filter (model_probability is not null and outcome = 'push') as push, count(*) filter (model_probability is not null and outcome = 'void') as void, 0 as unsettleable, 0 as other_outcome,
       count(*) filter (model_probability is not null and outcome in ('won', 'lost')) as scored from devigged where fair is not null group by all""")
def _(t):
    return K.population_census(Q.devig(t.quotes), ["tier"])


def _brier_sql():
    f = S.interval("(select *, pow(fair - won, 2) - pow(model_probability - won, 2) as v from scored)", "", BOTH, "v", Z12)
    r = S.interval("(select *, pow(raw_implied - won, 2) - pow(model_probability - won, 2) as v from scored)", "", BOTH, "v", Z12)
    return f"""with {SCORED}, m as (select count(*) as rows, avg(won) as base_rate, avg(pow(model_probability - won, 2)) as model, avg(pow(fair - won, 2)) as market_devigged,
    avg(pow(raw_implied - won, 2)) as market_raw, var_pop(won) as base_rate_reference from scored)
    select m.*, 1 - model / market_devigged as skill_vs_devigged, 1 - model / market_raw as skill_vs_raw, model > market_raw as loses_to_market,
    f.roi as fair_advantage, f.adjusted_low as fair_low, f.adjusted_high as fair_high, f.verdict as fair_verdict, r.roi as raw_advantage, r.adjusted_low as raw_low, r.adjusted_high as raw_high, r.verdict as raw_verdict
    from m, ({f}) f, ({r}) r"""


@query("brier_comparison", "rows:i base_rate:d model:d market_devigged:d market_raw:d base_rate_reference:d skill_vs_devigged:d skill_vs_raw:d loses_to_market:b fair_advantage:d fair_low:d fair_high:d fair_verdict:s raw_advantage:d raw_low:d raw_high:d raw_verdict:s", _brier_sql())
def _(t):
    return K.brier(scored(t), LOOKS)


@query("log_loss", "market:s rows:i loss:d clipped:i",
       f"""with {SCORED} select market, count(*) as rows, avg(-(won * ln(model_probability) + (1 - won) * ln(1 - model_probability))) as loss, 0 as clipped from scored group by all""")
def _(t):
    return scored(t).groupBy("market").agg(F.count("*").alias("rows"), F.avg(K.log_loss(F.col("model_implied"), F.col("won"))).alias("loss"), F.count_if(K.clipped(F.col("model_implied"))).alias("clipped"))


_BUCKETS = "(values (0, '-infinity'::double, -0.1e0), (1, -0.1e0, -0.05e0), (2, -0.05e0, 0e0), (3, 0e0, 0.02e0), (4, 0.02e0, 0.05e0), (5, 0.05e0, 0.1e0), (6, 0.1e0, 0.2e0), (7, 0.2e0, 'infinity'::double)) b(bucket, bucket_low, bucket_high)"


def _edges_sql():
    roi = S.interval("tagged", "bucket", BOTH, z=Z12)
    lo, hi = S.wilson("wins", "rows")
    return f"""with {SCORED}, tagged as (select s.*, b.bucket from scored s join {_BUCKETS} on s.edge >= b.bucket_low and s.edge < b.bucket_high),
    per as (select bucket, count(*) as rows, count(distinct event_id) as games, sum(won) as wins, avg(edge) as claimed_edge, avg(model_probability) as mi, avg(fair) as fi from tagged group by all)
    select b.bucket, b.bucket_low, coalesce(rows, 0) as rows, coalesce(games, 0) as games, coalesce(rows, 0) >= 30 as enough, claimed_edge, wins / rows as realised, case when rows is null then null else {lo} end as wilson_low,
    case when rows is null then null else {hi} end as wilson_high, wins / rows - mi as gap_to_model, wins / rows - fi as gap_to_market, roi, adjusted_low as roi_low, adjusted_high as roi_high
    from {_BUCKETS} left join per using (bucket) left join ({roi}) i using (bucket)"""


@query("edge_buckets", "bucket:i bucket_low:d rows:i games:i enough:b claimed_edge:d realised:d wilson_low:d wilson_high:d gap_to_model:d gap_to_market:d roi:d roi_low:d roi_high:d", _edges_sql())
def _(t):
    return K.edge_buckets(scored(t), LOOKS)


@query("overconfidence_slope", "usable_buckets:i measurable:b gap_lowest:d gap_highest:d widens:b widens_by:d return_change:d",
       f"""with e as ({_edges_sql()}) select count(*) as usable_buckets, count(*) >= 2 as measurable, arg_min(gap_to_model, bucket) as gap_lowest, arg_max(gap_to_model, bucket) as gap_highest,
       arg_max(gap_to_model, bucket) < arg_min(gap_to_model, bucket) as widens, arg_min(gap_to_model, bucket) - arg_max(gap_to_model, bucket) as widens_by, arg_max(roi, bucket) - arg_min(roi, bucket) as return_change from e where enough""")
def _(t):
    return K.overconfidence_slope(K.edge_buckets(scored(t), LOOKS))


CL, CH = S.wilson("wins", "n")
_BINS = "(select i as bucket, i / 10e0 as lo, (i + 1) / 10e0 as hi from range(0, 10) r(i))"
_CALIBRATION = f"""select b.bucket, coalesce(n, 0) as n, predicted, wins / cast(n as double) as observed, case when n is null then null else {CL} end as wilson_low, case when n is null then null else {CH} end as wilson_high,
 wins / cast(n as double) - predicted as gap, coalesce(n, 0) >= 30 as enough
 from {_BINS} b left join (select b.bucket, count(*) as n, sum(won) as wins, avg(p) as predicted from {{source}} join {_BINS} b on p >= lo and (p < hi or (bucket = 9 and p <= hi)) group by all) c using (bucket)"""


@query("calibration_table", "bucket:i n:i predicted:d observed:d wilson_low:d wilson_high:d gap:d enough:b", _CALIBRATION.format(source="forecasts"))
def _(t):
    return K.calibration_table(t.forecasts)


@query("calibration_of_quotes", "bucket:i n:i predicted:d observed:d wilson_low:d wilson_high:d gap:d enough:b",
       f"with {SCORED} " + _CALIBRATION.format(source="(select model_probability as p, won from scored)"))
def _(t):
    return K.calibration_table(scored(t), "model_implied")


@query("overconfidence_points", "points:d n:i buckets:i",
       f"""with {SCORED}, c as ({_CALIBRATION.format(source="(select model_probability as p, won from scored)")}) select sum((predicted - observed) * n) / sum(n) as points, sum(n) as n, count(*) as buckets from c where enough""")
def _(t):
    return K.overconfidence(K.calibration_table(scored(t), "model_implied"))


@query("exclusion_counts", "no_probability:i push:i void:i unsettleable:i",
       "select count(*) filter (model_probability is null) as no_probability, count(*) filter (outcome = 'push') as push, count(*) filter (outcome = 'void') as void, 0 as unsettleable from quotes")
def _(t):
    return K.exclusions(t.quotes, "model_probability")


WAGER = ("slate_date", "event_id", "market", "player", "selection", "line")


@query("calibration_by_decile", "bucket:i rows:i wagers:i enough:b predicted:d realised:d gap_points:d",
       f"""with {SCORED}, c as (select b.bucket, count(*) as rows, count(distinct (slate_date, event_id, market, player, selection, coalesce(line, -99))) as wagers, avg(model_probability) as p, avg(won) as w
       from scored join {_BINS} b on model_probability >= lo and (model_probability < hi or (bucket = 9 and model_probability <= hi)) group by all)
       select b.bucket, coalesce(rows, 0) as rows, coalesce(wagers, 0) as wagers, coalesce(wagers, 0) >= 30 as enough, case when wagers >= 30 then p end as predicted, case when wagers >= 30 then w end as realised,
       case when wagers >= 30 then 100 * (p - w) end as gap_points from {_BINS} b left join c using (bucket)""")
def _(t):
    return K.calibration_by_decile(scored(t), "model_implied", WAGER)


def rung_frame(t):
    return Q.rungs_from_the_money(Q.devig(t.quotes, power=True), t.quotes)


RUNGS = """over_rows as (select event_id, market, lower(player) as lp, line, case when selection = 'over' then raw_implied else 1 - raw_implied end as oi from quotes where line is not null),
per_rung as (select event_id, market, lp, line, quantile_cont(oi, 0.5) as m from over_rows group by all),
placed as (select *, row_number() over (partition by event_id, market, lp order by line) as pos from per_rung),
money as (select event_id, market, lp, arg_min(pos, (abs(m - 0.5), pos)) as mp from placed group by all),
rung as (select event_id, market, lp, line, abs(pos - mp) as rungs from placed join money using (event_id, market, lp))"""


@query("rungs_from_the_money", "event_id:i partkey:i suppkey:i market:s rungs:d",
       f"with {RUNGS} select q.event_id, q.partkey, q.suppkey, q.market, r.rungs from quotes q left join rung r on q.event_id = r.event_id and q.market = r.market and lower(q.player) = r.lp and q.line = r.line")
def _(t):
    return Q.rungs_from_the_money(t.quotes).withColumnRenamed("rungs_from_the_money", "rungs")


@query("coverage_by_rung", "rungs:i rows:i two_sided:i share:d benchmarked:b",
       f"""with {DEVIG}, {RUNGS} select cast(r.rungs as bigint) as rungs, count(*) as rows, count(fair) as two_sided, count(fair) / cast(count(*) as double) as share, r.rungs <= 3 as benchmarked
       from devigged d join rung r on d.event_id = r.event_id and d.market = r.market and lower(d.player) = r.lp and d.line = r.line group by all""")
def _(t):
    return K.coverage_by_rung(rung_frame(t))


TIERS = ["high_major", "mid_major", "low_major"]
LADDER = f"""{SCORED}, {RUNGS}, pop as (select s.*, case when r.rungs <= 3 then 'near' else 'far' end as population, total - raw_implied as other, s.player as subject from scored s
 left join rung r on s.event_id = r.event_id and s.market = r.market and lower(s.player) = r.lp and s.line = r.line),
 losses as (select *, {S.power_fair('raw_implied', 'other')} as pf from pop),
 adv as (select *, -(won * ln(pf) + (1 - won) * ln(1 - pf)) as lf, -(won * ln(model_probability) + (1 - won) * ln(1 - model_probability)) as lm from losses)"""


@query("prop_population", "population:s tier:s rows:i loss_model:d loss_fair:d",
       f"with {LADDER} select population, tier, count(*) as rows, avg(lm) as loss_model, avg(lf) as loss_fair from adv group by all")
def _(t):
    return K.ladder_population(rung_frame(t), TIERS).groupBy("population", "tier").agg(F.count("*").alias("rows"), F.avg("loss_model").alias("loss_model"), F.avg("loss_fair").alias("loss_fair"))


@query("advantage_interval", "tier:s roi:d bets:i clusters:i unit:s adjusted_low:d adjusted_high:d below_floor:b",
       f"with {LADDER}, v as (select *, lf - lm as adv from adv) select tier, roi, bets, clusters, unit, adjusted_low, adjusted_high, clusters < 30 as below_floor from ({S.interval('v', 'tier', THREE, 'adv', Z12)})")
def _(t):
    rows = K.ladder_population(rung_frame(t), TIERS).withColumn("subject", F.col("player"))
    return K.advantage_interval(rows, "advantage", [["tier"]], LOOKS)


def _ols_sql():
    def unit(u, c):
        return f"""select '{u}' as unit, count(*) as g, sum(s0*s0) as m00, sum(s0*s1) as m01, sum(s0*s2) as m02, sum(s1*s1) as m11, sum(s1*s2) as m12, sum(s2*s2) as m22
        from (select {c}, sum(e) as s0, sum(e * x1) as s1, sum(e * x2) as s2 from resid group by {c})"""
    adj = ("a11*a22-a12*a12", "a02*a12-a01*a22", "a01*a12-a02*a11", "a00*a22-a02*a02", "a01*a02-a00*a12", "a00*a11-a01*a01")
    var = []
    for r in ((0, 1, 2), (1, 3, 4), (2, 4, 5)):
        p, q, w = (f"i{k}" for k in r)
        var.append(f"({p}*{p}*m00 + {q}*{q}*m11 + {w}*{w}*m22 + 2*{p}*{q}*m01 + 2*{p}*{w}*m02 + 2*{q}*{w}*m12)")
    names = [("intercept", 0), ("market_implied", 1), ("disagreement", 0)]
    picks = " union all ".join(f"select '{n}' as name, b{i} as estimate, unit, g, n, {null}e0 as null_value, sqrt({var[i]} * (g / (g - 1e0)) * ((n - 1e0) / (n - 3))) as se, case unit when 'game' then 0 else 1 end as rk from joined" for i, (n, null) in enumerate(names))
    return f"""with {SCORED}, x as (select event_id, slate_date, fair as x1, disagreement as x2, won as y from scored),
    a as (select count(*) as n, count(*) as a00, sum(x1) as a01, sum(x2) as a02, sum(x1*x1) as a11, sum(x1*x2) as a12, sum(x2*x2) as a22, sum(y) as y0, sum(x1*y) as y1, sum(x2*y) as y2 from x),
    inv as (select *, {', '.join(f'({e}) / (a00*(a11*a22-a12*a12) - a01*(a01*a22-a12*a02) + a02*(a01*a12-a11*a02)) as i{k}' for k, e in enumerate(adj))} from a),
    beta as (select *, i0*y0 + i1*y1 + i2*y2 as b0, i1*y0 + i3*y1 + i4*y2 as b1, i2*y0 + i4*y1 + i5*y2 as b2 from inv),
    resid as (select x.*, y - b0 - b1*x1 - b2*x2 as e from x, beta),
    joined as (select * from ({unit('game', 'event_id')} union all {unit('day', 'slate_date')}), beta),
    each as ({picks})
    select name, estimate, se as standard_error, unit as cluster_unit, n as rows, g as clusters, null_value, estimate - {Z12!r}e0 * se as low, estimate + {Z12!r}e0 * se as high,
    not (estimate - {Z12!r}e0 * se <= null_value and estimate + {Z12!r}e0 * se >= null_value) as excludes_null from each qualify row_number() over (partition by name order by round(se, 12) desc, rk) = 1"""


@query("cluster_robust_ols", "name:s estimate:d standard_error:d cluster_unit:s rows:i clusters:i null_value:d low:d high:d excludes_null:b", _ols_sql())
def _(t):
    return K.ols_clustered(scored(t), "won", ["market_implied", "disagreement"], BOTH, [0.0, 1.0, 0.0], LOOKS)


_SIDES = """sides as (select market, tier, event_id, slate_date, profit_units, selection as side from quotes),
 two as (select q.*, count(*) over w as n, min(payout) over w as low from quotes q window w as (partition by market, tier, event_id, segment, player, line)),
 every as (select market, tier, event_id, slate_date, profit_units, side from sides union all
  select market, tier, event_id, slate_date, profit_units, case when payout = low then 'favourite' else 'underdog' end from two where n = 2)"""


@query("null_baseline", "market:s tier:s side:s " + IV, f"with {_SIDES} {S.interval('every', 'market, tier, side', BOTH, z=Z12)}")
def _(t):
    return L.null_baseline(t.quotes, LOOKS)


@query("side_concentration", "market:s side:s share:d biased:b",
       "select market, arg_min(selection, (-n, selection)) as side, max(n) / sum(n) as share, max(n) / sum(n) >= 0.75 as biased from (select market, selection, count(*) as n from bets group by all) group by all")
def _(t):
    return L.side_concentration(t.bets, ["market"])


@query("key_numbers", "number:i games:i share:d covered:d",
       """with c as (select abs(margin) as number, count(*) as games from team_games where home_away = 'home' group by all), r as (select *, sum(games) over (order by games desc, number) as run, sum(games) over () as total from c)
       select number, games, games / total as share, run / total as covered from r where run - games < 0.5 * total""")
def _(t):
    return L.key_numbers(t.team_games.filter("home_away = 'home'"), "margin")


def ticketed(t):
    """Graded quotes whose settled number agrees with their outcome."""
    step = F.when(F.col("outcome") == "won", 1.0).when(F.col("outcome") == "lost", -1.0).otherwise(0.0)
    gap = F.when(F.col("partkey") % 3 == 0, 0.5).otherwise(3.5)
    line = F.coalesce("line", F.lit(0.0))
    up = F.col("selection").isin("over")
    actual = F.when(F.col("selection") == "home", step * gap - line).when(up, line + step * gap).otherwise(line - step * gap)
    return t.quotes.withColumn("actual", actual)


TICKET = """ticket as (select *, case when selection = 'home' then st * gap - ln when selection = 'over' then ln + st * gap else ln - st * gap end as actual from
 (select *, case outcome when 'won' then 1e0 when 'lost' then -1e0 else 0e0 end as st, case when partkey % 3 = 0 then 0.5e0 else 3.5e0 end as gap, coalesce(line, 0) as ln from quotes)),
 margins as (select *, st * gap as margin from ticket)"""


@query("ticket_margin_check", "checked:i agreed:i rate:d verified:b",
       f"with {TICKET} select count(*) as checked, count(*) filter ((margin > 0) = (outcome = 'won')) as agreed, count(*) filter ((margin > 0) = (outcome = 'won')) / cast(count(*) as double) as rate, true as verified from margins where outcome in ('won', 'lost')")
def _(t):
    return L.convention_check(ticketed(t))


_KEYNUM = "keynum as (select number from (select number, games, sum(games) over (order by games desc, number) as run, sum(games) over () as total from (select abs(margin) as number, count(*) as games from team_games where home_away = 'home' group by all)) where run - games < 0.5 * total)"
_HALF = f"""with {TICKET}, {_KEYNUM}, parts as (select *, case when abs(margin) <= 0.5 then 'half point' else 'view of the game' end as part from margins
 union all select *, 'half point at a key number' from margins where abs(margin) <= 0.5 and abs(round_even(line, 0)) in (select number from keynum))
 select part, roi, bets, clusters, unit, adjusted_low, adjusted_high, verdict from ({S.interval('parts', 'part', BOTH, z=Z12)})"""


@query("half_point_split", "part:s roi:d bets:i clusters:i unit:s adjusted_low:d adjusted_high:d verdict:s", _HALF)
def _(t):
    numbers = L.key_numbers(t.team_games.filter("home_away = 'home'"), "margin")
    return L.half_points(ticketed(t), numbers, LOOKS)


@query("trust_posterior", "settled:i weight:d",
       f"with {SCORED} select count(*) as settled, greatest(0, least(1, (20 * 0.3e0 + sum(disagreement * (won - fair))) / (20 + sum(disagreement * disagreement)))) as weight from scored")
def _(t):
    return M.trust_posterior(0.3, scored(t))
