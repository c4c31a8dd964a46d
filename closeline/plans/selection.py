"""Wagers, best prices, pairing, ladders, selection under caps."""

from pyspark.sql import functions as F

from closeline.functions import prices as P
from closeline.operators import intervals as I, ledger as L, quotes as Q, settle as X
from closeline.plans import sql as S
from closeline.plans.registry import query

W = "slate_date:t event_id:i market:s player:s selection:s line:d"
KEYS = "slate_date, event_id, market, player, selection, line"


@query("best_price_per_wager", W + " book:s american_odds:d payout:d",
       f"select {KEYS}, book, american_odds, payout from quotes qualify row_number() over (partition by slate_date, event_id, market, segment, lower(player), selection, line order by payout desc, store_order) = 1")
def _(t):
    return Q.best_price_per_wager(t.quotes, "store_order")


@query("price_dedupe", W + " book:s american_odds:d",
       f"select {KEYS}, book, american_odds from quotes qualify row_number() over (partition by slate_date, event_id, market, segment, player, selection, line, book order by payout desc, store_order) = 1")
def _(t):
    return Q.dedupe_prices(t.quotes, "store_order")


@query("one_bet_per_wager", W + " american_odds:d",
       f"select {KEYS}, max_by(american_odds, payout) as american_odds from quotes group by {KEYS}, segment")
def _(t):
    return Q.one_bet_per_wager(t.quotes.withColumn("phase", F.lit("close")), "store_order", "phase")


REFUSAL = """refused as (select *, case when suppkey % 11 = 0 then 'unknown market' when suppkey % 13 = 0 then 'unknown segment' when suppkey % 17 = 0 then 'unknown selection'
 when suppkey % 19 = 0 then 'unreadable price' when suppkey % 23 = 0 then 'no event or team' else '' end as refusal from quotes)"""


def dirty(t):
    every = lambda n: F.col("suppkey") % n == 0
    return t.quotes.withColumns({
        "market": F.when(every(11), "corner_kicks").otherwise(F.col("market")), "segment": F.when(every(13), "q9").otherwise(F.col("segment")),
        "selection": F.when(every(17), "draw").otherwise(F.col("selection")), "american_odds": F.when(every(19), 0.0).otherwise(F.col("american_odds")),
        "home_team": F.when(every(23), " nan ").otherwise(F.col("home_team"))})


@query("wager_refusals", "refusal:s n:i", f"with {REFUSAL} select refusal, count(*) as n from refused group by all")
def _(t):
    return Q.refusal_reason(dirty(t), X.markets(t.spark)).groupBy("refusal").agg(F.count("*").alias("n"))


@query("wagers", W + " quotes:i rows:i best:d",
       f"with {REFUSAL} select {KEYS}, count(distinct (book, american_odds)) as quotes, count(*) as rows, max(payout) as best from refused where refusal = '' group by all")
def _(t):
    out = Q.build_wagers(dirty(t), X.markets(t.spark))
    return out.withColumn("best", F.array_max(F.transform("quotes", lambda q: P.payout(q["american_odds"])))).withColumn("quotes", F.size("quotes"))


@query("complement_map", "event_id:i partkey:i suppkey:i kind:s side:s pair_line:d complement:s",
       """select event_id, partkey, suppkey, case when selection in ('home', 'away') then 'handicap' else 'total' end as kind, '' as side,
       case when selection = 'home' then coalesce(line, 0) when selection = 'away' then -coalesce(line, 0) else line end as pair_line,
       case selection when 'home' then 'away' when 'away' then 'home' when 'over' then 'under' else 'over' end as complement from quotes""")
def _(t):
    return t.quotes.withColumns(Q.pair_columns()).withColumn("complement", Q.complement(F.col("selection"))).withColumnsRenamed({"pair_kind": "kind", "pair_side": "side"})


def halves(t):
    """The graded side of a pair, and the whole store it came from."""
    return t.quotes.filter(F.col("selection").isin("home", "over")), t.quotes


COMP = """pl as (select *, case when selection = 'away' then -coalesce(line, 0) when selection = 'home' then coalesce(line, 0) else line end as pl from quotes),
 g as (select * from pl where selection in ('home', 'over')), o as (select event_id, market, player, pl, book, selection, max(payout) as best from pl where selection in ('away', 'under') group by all),
 census as (select g.*, case when g.pl is null then 'keyless' when o.best is null then 'unpairable' else 'paired' end as census, o.best from g left join o on g.event_id = o.event_id and g.market = o.market and g.player = o.player and g.pl = o.pl and g.book = o.book)"""


def complements(t):
    graded, store = halves(t)
    pairs = Q.pair_columns(True)
    keys = ["event_id", "market", "segment", *pairs]
    other = store.withColumns(pairs).withColumn("__side", Q.complement(F.col("selection"))).filter("pair_line is not null")
    best = other.groupBy(*keys, "__side").agg(F.max(P.payout("american_odds")).alias("best"), F.max_by("american_odds", P.ranked_payout("american_odds")).alias("other_odds"))
    left = graded.withColumns(pairs)
    joined = left.join(best.withColumnRenamed("__side", "selection"), [*keys, "selection"], "left")
    state = F.when(F.col("pair_line").isNull(), "keyless").when(F.col("best").isNull(), "unpairable").otherwise("paired")
    return joined.withColumn("census", state)


@query("complement_join", "market:s census:s n:i mean_best:d", f"with {COMP} select market, census, count(*) as n, avg(best) as mean_best from census group by all")
def _(t):
    return complements(t).groupBy("market", "census").agg(F.count("*").alias("n"), F.avg("best").alias("mean_best"))


@query("skill_frame_union", "market:s selection:s origin:s n:i",
       f"with {COMP} select market, selection, 'graded' as origin, count(*) as n from g group by all union all select market, case selection when 'home' then 'away' else 'under' end as selection, 'complement', count(*) from census where census = 'paired' group by all")
def _(t):
    graded, _ = halves(t)
    added = complements(t).filter("census = 'paired'").select("event_id", "market", Q.complement(F.col("selection")).alias("selection"), F.col("other_odds").alias("american_odds"), F.lit("complement").alias("origin"))
    both = graded.withColumn("origin", F.lit("graded")).unionByName(added, allowMissingColumns=True)
    return both.groupBy("market", "selection", "origin").agg(F.count("*").alias("n"))


@query("covered_pairs", "event_id:i market:s pl:d",
       f"with {COMP} select distinct event_id, market, pl from pl where selection in ('home', 'over') and pl is not null intersect select event_id, market, pl from pl where selection in ('away', 'under') and pl is not null")
def _(t):
    keyed = t.quotes.withColumns(Q.pair_columns()).filter("pair_line is not null").withColumnRenamed("pair_line", "pl")
    side = lambda *s: keyed.filter(F.col("selection").isin(*s)).select("event_id", "market", "pl")
    return side("home", "over").intersect(side("away", "under"))


@query("dominated_quotes", "event_id:i book:s market:s selection:s line:d american_odds:d easier_line:d n:i",
       """with q as (select *, case when selection = 'over' then line else -line end as rung from quotes where line is not null),
       r as (select event_id, market, player, selection, book, rung, max(payout) as best, max(line) as l from q group by all),
       e as (select a.event_id, a.market, a.player, a.selection, a.book, a.rung, max(b.best) as eb, max_by(b.l, (b.best, b.l)) as el from r a join r b using (event_id, market, player, selection, book) where b.rung < a.rung group by all)
       select q.event_id, q.book, q.market, q.selection, q.line, q.american_odds, e.el as easier_line, count(*) as n from q join e using (event_id, market, player, selection, book, rung) where e.eb > q.payout group by all""")
def _(t):
    return Q.dominated_quotes(t.quotes).groupBy("event_id", "book", "market", "selection", "line", "american_odds", "easier_line").agg(F.count("*").alias("n"))


@query("main_line", "event_id:i market:s main_line:d quotes:i",
       """with c as (select event_id, market, case when selection = 'away' then -line else line end as l, count(*) as n from quotes where market in ('spread', 'total_points') and line is not null group by all)
       select event_id, market, l as main_line, n as quotes from c qualify row_number() over (partition by event_id, market order by n desc, l) = 1""")
def _(t):
    return Q.main_lines(t.quotes, ["spread", "total_points"])


@query("rung_distance_mask", "market:s n:i",
       """with c as (select event_id, market, case when selection = 'away' then -line else line end as l, count(*) as n from quotes where market in ('spread', 'total_points') and line is not null group by all),
       m as (select event_id, market, l as main from c qualify row_number() over (partition by event_id, market order by n desc, l) = 1)
       select q.market, count(*) as n from quotes q left join m using (event_id, market) where not coalesce(abs(case when selection = 'away' then -line else line end - main) > 2, false) group by all""")
def _(t):
    mains = Q.main_lines(t.quotes, ["spread", "total_points"])
    return Q.within_rung_cap(t.quotes, mains, {"spread": "spread", "total_points": "total_points"}, 2.0).groupBy("market").agg(F.count("*").alias("n"))


BARS = """b0 as (select *, case when suppkey % 7 = 0 then 'started' else 'upcoming' end as tip, case when suppkey % 5 = 0 then 'out' else 'in' end as av from quotes),
 b1 as (select slate_date, event_id, market, segment, player, selection, line, max(model_probability) as p, count(*) as quotes_seen, max(tip) as tip, max(av) as av, bool_or(coalesce(edge >= 0.02, false)) as clears,
   max(edge) filter (edge >= 0.02 and american_odds between -400 and 600) as e, arg_max(book, (edge, book, american_odds)) filter (edge >= 0.02 and american_odds between -400 and 600) as book from b0 group by all),
 barred as (select *, case when market not in ('moneyline', 'spread', 'player_points') then 'not_approved' when p is null then 'no_opinion' when not clears then 'below_threshold' when e is null then 'outside_price_band'
   when player <> '' and av = 'out' then 'availability' when tip <> 'upcoming' then 'start_guard' else '' end as bar,
   market || '|' || segment || '|' || player || '|' || selection || '|' || case when line is null then '' else cast(line as varchar) end as label from b1)"""
APPROVED = ["moneyline", "spread", "player_points"]


def barred(t):
    rows = t.quotes.withColumns({"tip_state": F.when(F.col("suppkey") % 7 == 0, "started").otherwise("upcoming"), "availability": F.when(F.col("suppkey") % 5 == 0, "out").otherwise("in")})
    return Q.bar_of(rows, APPROVED)


@query("selection_bars", "market:s bar:s n:i", f"with {BARS} select market, bar, count(*) as n from barred group by all")
def _(t):
    return barred(t).groupBy("market", "bar").agg(F.count("*").alias("n"))


@query("exposure_caps", "slate_date:t event_id:i label:s edge:d book:s slate_rank:i",
       f"""with {BARS}, one as (select * from barred where bar = '' qualify row_number() over (partition by slate_date, event_id order by e desc, label) = 1)
       select slate_date, event_id, label, e as edge, book, row_number() over (partition by slate_date order by e desc, label, event_id) as slate_rank from one qualify slate_rank <= 5""")
def _(t):
    return Q.exposure_caps(barred(t), 1, 5)


@query("card_reconcile", "bar:s n:i total:i", f"with {BARS} select bar, count(*) as n, (select count(*) from barred) as total from barred group by all")
def _(t):
    return L.counts_by(barred(t), "bar")


@query("bet_down_bar", "event_id:i market:s kept:i raised:i",
       """with m as (select event_id, market, min(american_odds) as floor_odds from quotes where book in ('book0', 'book1') group by all)
       select q.event_id, q.market, count(*) filter (edge >= case when floor_odds is not null and american_odds < floor_odds then 0.04e0 else 0.02e0 end) as kept, count(*) filter (floor_odds is not null and american_odds < floor_odds) as raised
       from quotes q left join m using (event_id, market) group by all""")
def _(t):
    morning = t.quotes.filter(F.col("book").isin("book0", "book1")).groupBy("event_id", "market").agg(F.min("american_odds").alias("floor_odds"))
    worse = F.coalesce(F.col("american_odds") < F.col("floor_odds"), F.lit(False))
    rows = t.quotes.join(morning, ["event_id", "market"], "left").withColumn("bar", F.greatest(F.lit(P.EDGE_THRESHOLD), F.when(worse, 0.04).otherwise(0.0)))
    return rows.groupBy("event_id", "market").agg(F.count_if(F.col("edge") >= F.col("bar")).alias("kept"), F.count_if(worse).alias("raised"))


@query("closed_cell_gate", "tier:s market:s n:i", "select tier, market, count(*) as n from quotes where not (tier = 'high_major' and market = 'spread') and not (tier = 'low_major' and market = 'moneyline') group by all")
def _(t):
    gate = t.spark.createDataFrame([("high_major", "spread"), ("low_major", "moneyline")], "tier string, market string")
    return L.closed_cells(t.quotes, gate).groupBy("tier", "market").agg(F.count("*").alias("n"))


@query("stratified_sample", "market:s tier:s store_order:i pick:i",
       "select market, tier, store_order, row_number() over (partition by market, tier order by md5('7:' || store_order), store_order) as pick from (select distinct market, tier, store_order from quotes) qualify pick <= 25")
def _(t):
    rows = t.quotes.select("market", "tier", "store_order").distinct()
    return L.stratified_sample(rows, ["market", "tier"], "store_order", 25)


@query("stratified_order", "market:s store_order:i position:d",
       "select market, store_order, (row_number() over (partition by market order by md5('7:' || store_order), store_order) - 0.5e0) / count(*) over (partition by market) as position from (select distinct market, store_order from quotes)")
def _(t):
    rows = t.quotes.select("market", "store_order").distinct()
    return L.stratified_order(rows, ["market"], "store_order")


@query("earliest_card_wins", "event_id:i market:s selection:s slate_date:t american_odds:d",
       "select event_id, market, selection, slate_date, american_odds from quotes qualify row_number() over (partition by event_id, market, selection order by slate_date, store_order, american_odds) = 1")
def _(t):
    return L.earliest_wins(t.quotes, ["event_id", "market", "selection"], ["slate_date", "store_order", "american_odds"])


FLOW = f"""qd as (select * from quotes qualify row_number() over (partition by slate_date, event_id, market, segment, lower(player), selection, line order by payout desc, store_order) = 1),
 q2 as (select *, case when selection = 'away' then -coalesce(line, 0) when selection = 'home' then coalesce(line, 0) else line end as pl, selection in ('home', 'away') as hk from qd),
 gr as (select event_id, market, lower(player) as lp, hk, pl, count(*) as n, count(distinct selection) as s, sum(raw_implied) as total from q2 where pl is not null group by all),
 staked as (select q2.*, q2.edge + 0 as e2 from q2 join gr on q2.event_id = gr.event_id and q2.market = gr.market and lower(q2.player) = gr.lp and q2.hk = gr.hk and q2.pl = gr.pl where gr.n = 2 and gr.s = 2 and gr.total > 1 and q2.edge >= 0.02)"""
FB = {"game": "event_id", "day": "slate_date"}


@query("backtest_verdict", "market:s tier:s level:s " + S.INTERVAL,
       f"""with {FLOW} select market, tier, 'market and tier' as level, * exclude (market, tier) from ({S.interval('staked', 'market, tier', FB, z=I.adjusted_z(12))})
       union all by name select tier, 'tier' as level, * exclude (tier) from ({S.interval('staked', 'tier', FB, z=I.adjusted_z(12))}) union all by name select 'pooled' as level, * from ({S.interval('staked', '', FB, z=I.adjusted_z(12))})""")
def _(t):
    best = Q.best_price_per_wager(t.quotes, "store_order")
    fair = Q.devig(best).filter("refusal = ''")
    bets = fair.withColumn("edge", P.expected_value("model_probability", "american_odds")).filter(F.col("edge") >= P.EDGE_THRESHOLD)
    bets = bets.withColumn("profit_units", P.profit_units("outcome", "american_odds"))
    levels = F.array(*[F.lit(x) for x in ("market and tier", "tier", "pooled")])
    return I.interval(bets, [["market", "tier"], ["tier"], []], FB, looks=12).withColumn("level", F.element_at(levels, F.col("grouping") + 1))
