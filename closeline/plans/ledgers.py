"""Accounting, censuses and verdicts."""

from pyspark.sql import functions as F

from closeline.operators import intervals as I, ledger as L
from closeline.plans import sql as S
from closeline.plans.registry import query

BOTH = {"game": "event_id", "day": "slate_date"}
GAME = {"game": "event_id"}
Z9 = I.adjusted_z(9)


@query("accounting_identity", "bucket:s n:i total:i",
       """with b as (select case when suppkey % 29 = 0 then 'ambiguous' when suppkey % 31 = 0 then 'gated' when model_probability is null then 'no_opinion' when edge < 0.02 then 'below_threshold' else 'bet' end as bucket from quotes)
       select bucket, count(*) as n, (select count(*) from b) as total from b group by all""")
def _(t):
    rows = t.quotes.withColumns({"ambiguous": F.col("suppkey") % 29 == 0, "gated": F.col("suppkey") % 31 == 0})
    return L.counts_by(rows.withColumn("bucket", L.accounting_bucket()), "bucket")


def respelled(t):
    return t.quotes.withColumn("player", F.when(F.col("partkey") % 2 == 0, F.upper("player")).otherwise(F.col("player")))


SP = "sp as (select *, case when partkey % 2 = 0 then upper(player) else player end as pl from quotes)"
WKEY = ["event_id", "market", "player", "selection", "line"]


@query("wager_census", "market:s quotes:i wagers_raw:i wagers_folded:i collisions:i",
       f"""with {SP}, r as (select market, (event_id, market, lower(pl), selection, coalesce(line, -999)) as f, pl, count(*) as n from sp group by all), g as (select market, f, sum(n) as n, count(*) as s from r group by all)
       select market, sum(n) as quotes, sum(s) as wagers_raw, count(*) as wagers_folded, count(*) filter (s > 1) as collisions from g group by all""")
def _(t):
    return L.wager_census(respelled(t), WKEY)


@query("spelling_sets", "folded:s spellings:i first_form:s", f"with {SP} select lower(pl) as folded, count(distinct pl) as spellings, min(pl) as first_form from sp where pl <> '' group by all")
def _(t):
    return L.spellings(respelled(t)).withColumn("first_form", F.col("forms")[0])


@query("offered_accounting", "market:s offered:i accounted:i residual:i",
       f"""with {SP}, o as (select market, count(distinct (event_id, lower(pl), selection, coalesce(line, -999))) as offered from sp group by all), a as (select market, count(distinct (event_id, lower(pl), selection, coalesce(line, -999))) as accounted from sp group by all)
       select market, offered, accounted, offered - accounted as residual from o full outer join a using (market)""")
def _(t):
    census = L.wager_census(respelled(t), WKEY).select("market", F.col("wagers_folded").alias("offered"))
    run = L.wager_census(t.quotes.withColumn("player", F.lower("player")), WKEY).select("market", F.col("wagers_folded").alias("accounted"))
    return L.reconcile(census, run)


@query("unmeasured_markets", "market:s",
       """select market from (values ('moneyline'), ('spread'), ('alternate_spread'), ('total_points'), ('alternate_total_points'), ('team_total'), ('alternate_team_total')) m(market) where market not in (select distinct market from quotes)""")
def _(t):
    from closeline.operators import settle as X

    registry = X.markets(t.spark).filter("market_segment = 'game' and quantity in ('game_margin', 'game_total', 'team_score')")
    return registry.join(t.quotes.select("market").distinct(), "market", "left_anti")


@query("retention_roll_up", "market:s fully_asked:i priced:i absent:i incomplete:i rows:i asked_high_major:i",
       """with k as (select * from (values ('click', 'clicks'), ('view', 'views'), ('view_alt', 'views'), ('error', 'errors')) k(provider_key, market)),
       ev as (select user_id as event_id, event_type, event_id as id, value from events), al as (select event_id, case when event_type = 'view' and id % 2 = 0 then 'view_alt' else event_type end as provider_key, id, value from ev),
       ask as (select distinct event_id, provider_key from al where provider_key in (select provider_key from k) and (event_id >= 20 or provider_key <> 'view_alt')), seen as (select event_id, provider_key, count(*) as rows from al where value >= 40 group by all),
       e as (select k.market, a.event_id, count(distinct a.provider_key) as answered, coalesce(sum(s.rows), 0) as rows from ask a join k using (provider_key) left join seen s using (event_id, provider_key) group by all),
       c as (select e.*, answered = (select count(*) from k where k.market = e.market) as complete, event_id % 3 = 0 as high from e)
       select market, count(*) filter (complete) as fully_asked, count(*) filter (rows > 0) as priced, count(*) filter (complete and rows = 0) as absent, count(*) filter (not complete and rows = 0) as incomplete, sum(rows) as rows, count(*) filter (complete and high) as asked_high_major from c group by all""")
def _(t):
    keys = t.spark.createDataFrame([("click", "clicks"), ("view", "views"), ("view_alt", "views"), ("error", "errors")], "provider_key string, market string")
    alt = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "view_alt").otherwise(F.col("event_type"))
    ev = t.events.select(F.col("user_id").alias("event_id"), alt.alias("provider_key"), F.col("event_id").alias("id"), "value")
    tier = F.when(F.col("event_id") % 3 == 0, "high_major").otherwise("low_major")
    asked = ev.select("event_id", "provider_key").distinct().filter((F.col("event_id") >= 20) | (F.col("provider_key") != "view_alt")).withColumn("tier", tier)
    seen = ev.filter("value >= 40").groupBy("event_id", "provider_key").agg(F.count("*").alias("rows"))
    return L.retention(asked, seen, keys)


@query("sample_balance", "axis:s value:s population:i bought:i population_share:d bought_share:d difference:d",
       """with p as (select unnest([{'axis': 'market', 'value': market}, {'axis': 'tier', 'value': tier}]) as a from quotes), b as (select unnest([{'axis': 'market', 'value': market}, {'axis': 'tier', 'value': tier}]) as a from quotes where edge >= 0.1),
       tp as (select count(*) as n from quotes), tb as (select count(*) as n from quotes where edge >= 0.1), pc as (select a.axis as axis, a.value as value, count(*) as population from p group by all), bc as (select a.axis as axis, a.value as value, count(*) as bought from b group by all)
       select axis, value, coalesce(population, 0) as population, coalesce(bought, 0) as bought, round(coalesce(population, 0) / cast(tp.n as double), 4) as population_share, round(coalesce(bought, 0) / cast(tb.n as double), 4) as bought_share,
       round(coalesce(bought, 0) / cast(tb.n as double) - coalesce(population, 0) / cast(tp.n as double), 4) as difference from pc full outer join bc using (axis, value), tp, tb""")
def _(t):
    return L.sample_balance(t.quotes.filter(F.col("edge") >= 0.1), t.quotes, ["market", "tier"])


@query("look_count", "axis:s value:s looks:i",
       """with h as (select market, subject, min(year(slate_date) * 100 + week(slate_date)) as week from bets group by all)
       select 'all' as axis, '' as value, count(*) as looks from h union all select 'search', market, count(*) from h group by all union all select 'week', cast(week as varchar), count(*) from h group by all""")
def _(t):
    week = F.year("slate_date") * 100 + F.weekofyear("slate_date")
    tests = t.bets.select(F.col("market").alias("search"), F.col("subject").alias("name"), week.alias("week"))
    return L.looks_summary(tests)


@query("restated_intervals", "market:s tier:s roi:d low:d high:d adjusted_low:d adjusted_high:d verdict:s",
       f"select market, tier, roi, low, high, adjusted_low, adjusted_high, verdict from ({S.interval('bets', 'market, tier', GAME, z=Z9)})")
def _(t):
    stored = I.interval(t.bets, [["market", "tier"]], GAME, looks=2)
    return L.restated(stored, 9)


@query("season_record", "season:i slate_date:t wins:i losses:i pushes:i units:d staked:d",
       """with p as (select year(slate_date) as season, *, case when tier = 'high_major' then 2e0 else 1e0 end as stake from quotes)
       select season, slate_date, count(*) filter (outcome = 'won') as wins, count(*) filter (outcome = 'lost') as losses, count(*) filter (outcome = 'push') as pushes, sum(profit_units * stake) as units, sum(case when outcome in ('won', 'lost') then stake else 0 end) as staked
       from p group by grouping sets ((season, slate_date), (season))""")
def _(t):
    picks = t.quotes.withColumns({"season": F.year("slate_date"), "stake": F.when(F.col("tier") == "high_major", 2.0).otherwise(1.0)})
    return L.season_record(picks)


@query("pick_record", "category:s outcome:s n:i mean_clv:d graded:i",
       "select case when market = 'player_points' then 'props' when market = 'total_points' then 'totals' else 'sides' end as category, outcome, count(*) as n, avg(edge) as mean_clv, count(edge) as graded from quotes group by all")
def _(t):
    category = F.when(F.col("market") == "player_points", "props").when(F.col("market") == "total_points", "totals").otherwise("sides")
    return L.pick_record(t.quotes.withColumns({"category": category, "clv": F.col("edge")}))


@query("hold_days", "market:s hold_days:i n:i", "select market, suppkey % 11 as hold_days, count(*) as n from quotes group by all")
def _(t):
    settled = F.date_add("slate_date", (F.col("suppkey") % 11).cast("int"))
    return L.hold_days(t.quotes.withColumn("settled_at", settled), "slate_date", "settled_at").groupBy("market", "hold_days").agg(F.count("*").alias("n"))


HOLD = f"""d as ({S.interval("(select * from bets where slate_date < date '2000-01-01')", 'market, tier', BOTH, z=Z9)}),
 hs as (select *, year(slate_date) as season from bets where slate_date >= date '2000-01-01'), h as ({S.interval('hs', 'season, market, tier', BOTH, z=Z9)}),
 ss as (select distinct season from hs),
 st as (select ss.season, d.market, d.tier, coalesce(h.bets, 0) as held_bets, case when h.bets is null then 'untestable' when h.bets < 500 then 'not enough evidence' when d.verdict not in ('demonstrated edge', 'demonstrated deficit') then 'nothing to replicate'
  when h.verdict not in ('demonstrated edge', 'demonstrated deficit') then 'did not replicate' when sign(h.roi) <> sign(d.roi) then 'reversed' else 'replicated' end as state from d cross join ss left join h on h.season = ss.season and h.market = d.market and h.tier = d.tier)"""


def states(t):
    split = F.lit("2000-01-01").cast("date")
    claims = I.interval(t.bets.filter(F.col("slate_date") < split), [["market", "tier"]], BOTH, looks=9)
    held = t.bets.filter(F.col("slate_date") >= split).withColumn("season", F.year("slate_date"))
    return L.replication(claims, I.interval(held, [["season", "market", "tier"]], BOTH, looks=9), minimum_bets=500)


@query("replication_states", "season:i market:s tier:s held_bets:i state:s", f"with {HOLD} select * from st")
def _(t):
    return states(t)


@query("replication_verdict", "market:s tier:s state:s seasons:i",
       f"""with {HOLD} select market, tier, case when bool_and(state = 'replicated') then 'replicated' when bool_or(state = 'nothing to replicate') then 'nothing to replicate' when bool_or(state = 'reversed') then 'reversed'
       when bool_or(state = 'did not replicate') then 'did not replicate' when bool_or(state = 'not enough evidence') then 'not enough evidence' else 'untestable' end as state, count(*) as seasons from st group by all""")
def _(t):
    return L.combined_state(states(t))


SEAS = f"sb as (select *, year(slate_date) as season from bets), sc as ({S.interval('sb', 'season, market', BOTH)})"


@query("promotion", "market:s seasons:i thin:i short:i spanning:i promoted:b",
       f"""with {SEAS} select market, count(*) as seasons, count(*) filter (bets < 2000) as thin, count(*) filter (100 * (roi + 0.1) < 1.5) as short, count(*) filter ((low + high) / 2 - (high - low) / 2 * 1.4 <= 0 and (low + high) / 2 + (high - low) / 2 * 1.4 >= 0) as spanning,
       count(*) filter (bets < 2000) = 0 and count(*) filter (100 * (roi + 0.1) < 1.5) = 0 and count(*) filter ((low + high) / 2 - (high - low) / 2 * 1.4 <= 0 and (low + high) / 2 + (high - low) / 2 * 1.4 >= 0) = 0 as promoted from sc group by all""")
def _(t):
    cells = I.interval(t.bets.withColumn("season", F.year("slate_date")), [["season", "market"]], BOTH)
    return L.promotion(cells.withColumn("margin_points", 100.0 * (F.col("roi") + 0.1)), ["market"], factor=1.4)


@query("stopping_rule", "market:s bets:i roi:d high:d finding:s",
       f"""with c as ({S.interval('bets', 'market', BOTH)}), d as (select * from (values ('A', -0.02e0, 300), ('R', -0.5e0, 300), ('X', -0.02e0, 300)) d(market, roi_floor, minimum_bets))
       select d.market, coalesce(bets, 0) as bets, roi, high, case when coalesce(bets, 0) < 500 then 'not enough evidence' when high < roi_floor then 'withdraw' when roi < roi_floor then 'below floor, interval reaches it' else 'above floor' end as finding from d left join c using (market)""")
def _(t):
    declared = t.spark.createDataFrame([("A", -0.02, 300), ("R", -0.5, 300), ("X", -0.02, 300)], "market string, roi_floor double, minimum_bets long")
    return L.demotion(I.interval(t.bets, [["market"]], BOTH), declared)


BUDGET_Z = f"""list_reduce(list_concat([0e0], list_transform(range(0, 50), lambda i: 8e0 / pow(2, i))), lambda z, s: case when looks > 1 and 1 - {S.normal_cdf('(z + s)')} >= 0.025e0 / looks then z + s else z end)"""
_Z_LIMIT = f"({S.Z} * sqrt(supply / 1537e0))"
_Z_FLOOR = f"({S.Z} * sqrt(10000 / 1537e0))"


@query("search_budget", "market:s looks:i supply:i correction_factor:d needed:i exhausted:b exhausted_at_floor:b bites_at:i bites_at_floor:i",
       f"""with l as (select market, count(distinct subject) as looks from bets group by all), s as (select market, count(*) // count(distinct year(slate_date)) as supply from bets group by all),
       z as (select *, case when looks <= 1 then 1 else {BUDGET_Z} / {S.Z} end as f from l join s using (market)), n as (select *, cast(ceil(1537 * f * f) as bigint) as needed from z)
       select market, looks, supply, f as correction_factor, needed, needed > supply as exhausted, needed > 10000 as exhausted_at_floor, greatest(2, cast(floor(0.025e0 / (1 - {S.normal_cdf(_Z_LIMIT)})) as bigint) + 1) as bites_at,
        greatest(2, cast(floor(0.025e0 / (1 - {S.normal_cdf(_Z_FLOOR)})) as bigint) + 1) as bites_at_floor from n""")
def _(t):
    tests = t.bets.groupBy("market").agg(F.countDistinct("subject").alias("looks"))
    supply = t.bets.groupBy("market").agg(F.floor(F.count("*") / F.countDistinct(F.year("slate_date"))).alias("supply"))
    return L.search_budget(tests, supply)


@query("decision_rule", "market:s roi:d opinions:i games:i decision:s",
       f"""with c as ({S.interval('bets', 'market', BOTH, z=Z9)}), n as (select market, count(*) as opinions, count(distinct event_id) as games from bets group by all)
       select market, roi, opinions, games, case when opinions < 10000 or games < 2000 then 'did not run' when adjusted_high < 0 then 'stop: loses' when adjusted_low <= 0 then 'stop: no edge' when roi - 0.01 <= 0 then 'not reachable' else 'candidate' end as decision from c join n using (market)""")
def _(t):
    counts = t.bets.groupBy("market").agg(F.count("*").alias("opinions"), F.countDistinct("event_id").alias("games"))
    cells = I.interval(t.bets, [["market"]], BOTH, looks=9).join(counts, "market").withColumn("survived_roi", F.col("roi") - 0.01)
    return L.decision(cells)


@query("claim_rows", "test:s market:s tier:s roi:d bets:i verdict:s claim:s",
       f"""with b as ({S.interval("(select * from bets where slate_date < date '1999-01-01')", 'market, tier', BOTH, z=Z9)}), f as ({S.interval("(select * from bets where slate_date >= date '1999-01-01')", 'market, tier', BOTH, z=Z9)}),
       u as (select 'backtest' as test, market, tier, roi, bets, verdict from b union all select 'forward', market, tier, roi, bets, verdict from f)
       select *, case verdict when 'demonstrated edge' then 'edge' when 'demonstrated deficit' then 'deficit' else 'none' end as claim from u""")
def _(t):
    day = F.lit("1999-01-01").cast("date")
    part = lambda c: I.interval(t.bets.filter(c), [["market", "tier"]], BOTH, looks=9)
    return L.claim_rows(part(F.col("slate_date") < day), part(F.col("slate_date") >= day))


@query("key_number_inputs", "game_id:i margin:i total:i", "select game_id, margin, total from team_games where home_away = 'home' and game_id in (select event_id from quotes where market = 'spread')")
def _(t):
    covered = t.quotes.filter("market = 'spread'").select(F.col("event_id").alias("game_id"))
    games = t.team_games.filter("home_away = 'home'").select("game_id", "margin", "total")
    return games.join(covered, "game_id", "left_semi").dropDuplicates(["game_id"])
