"""Boards and captures: consensus, shops, survival, moves, closing values."""

from pyspark.sql import functions as F

from closeline import session
from closeline.functions import prices as P
from closeline.operators import captures as M, intervals as I, quotes as Q
from closeline.plans import sql as S
from closeline.plans.registry import query

LOOKS = 6
Z6 = I.adjusted_z(LOOKS)
IV = S.INTERVAL
BOTH = {"game": "event_id", "day": "slate_date"}

BRD = f"""brd as (select * from (select *, case market when 'moneyline' then 0e0 when 'spread' then case when selection = 'away' then -line else line end else line end as pair_line,
  selection in ('home', 'over') as fs, {S.decimal('american_odds')} as dec from board where captured_at < commence_time) where dec is not null)"""
FAIR = f"""{BRD}, pb as (select captured_at, event_id, market, pair_line, book, max(dec) filter (fs) as a, max(dec) filter (not fs) as b from brd group by all),
 dv as (select *, 1 / a as ia, 1 / b as ib from pb), dw as (select *, {S.power_fair('ia', 'ib')} as dv from dv),
 fair as (select captured_at, event_id, market, pair_line, quantile_cont(dv, 0.5) as ff, count(dv) as books from dw group by all having count(dv) >= 3),
 best as (select * from brd qualify row_number() over (partition by captured_at, event_id, market, pair_line, fs order by dec desc, book desc) = 1),
 fb as (select f.captured_at, f.event_id, f.market, f.pair_line, f.books, b.selection, b.line, b.commence_time, case when b.fs then ff else 1 - ff end as fair, b.dec as best_decimal, b.american_odds as best_american, b.book as best_book
  from fair f join best b using (captured_at, event_id, market, pair_line)),
 shop as (select *, fair * best_decimal - 1 as shop_edge from fb where fair * best_decimal - 1 >= 0.02 and best_american between -400 and 600)"""
FB = "captured_at:t event_id:i market:s pair_line:d selection:s line:d books:i fair:d best_decimal:d best_american:d best_book:s"


@query("fair_board", FB, f"with {FAIR} select * from fb")
def _(t):
    return Q.fair_board(t.board)


@query("shops", FB + " shop_edge:d", f"with {FAIR} select * from shop")
def _(t):
    return Q.shops(Q.fair_board(t.board))


@query("latest_capture", FB + " shop_edge:d", f"with {FAIR} select * from shop where captured_at = (select max(captured_at) from fb)")
def _(t):
    board = Q.fair_board(t.board)
    return Q.latest(board, Q.shops(board))


ALERTS = f"""with {FAIR}, st as (select distinct captured_at from fb order by 1 desc limit 2)
select * from shop s where shop_edge >= 0.03 and captured_at = (select max(captured_at) from st)
 and not exists (select 1 from shop p where p.shop_edge >= 0.03 and p.captured_at = (select min(captured_at) from st) and (select count(*) from st) = 2
 and (p.event_id, p.market, p.pair_line, p.selection, p.best_book) = (s.event_id, s.market, s.pair_line, s.selection, s.best_book))"""


@query("alerts", FB + " shop_edge:d", ALERTS)
def _(t):
    board = Q.fair_board(t.board)
    return Q.alerts(board, Q.shops(board))


@query("new_since_previous", "captured_at:t event_id:i market:s selection:s line:d book:s american_odds:d",
       """with st as (select captured_at, lag(captured_at) over (order by captured_at) as prev from (select distinct captured_at from board)),
       d as (select distinct captured_at, event_id, market, selection, line, book, american_odds from board)
       select d.* from d join st using (captured_at) where prev is not null and not exists (select 1 from d p where p.captured_at = prev and p.event_id = d.event_id and p.market = d.market and p.selection = d.selection
        and p.line is not distinct from d.line and p.book = d.book and p.american_odds = d.american_odds)""")
def _(t):
    cols = ["event_id", "market", "selection", "line", "book", "american_odds"]
    rows = t.board.select("captured_at", *cols).distinct()
    nxt = M.next_stamps(t.board).filter("next_capture is not null")
    earlier = rows.join(nxt, "captured_at", "inner").select(F.col("next_capture").alias("captured_at"), *[F.col(c).alias(f"p_{c}") for c in cols])
    first = t.board.agg(F.min("captured_at").alias("first"))
    later = rows.crossJoin(F.broadcast(first)).filter("captured_at > first").drop("first")
    on = [later.captured_at == earlier.captured_at, *[later[c].eqNullSafe(earlier[f"p_{c}"]) for c in cols]]
    return later.join(earlier, on, "left_anti")


GRADED = f"""{FAIR}, f1 as (select * from shop qualify row_number() over (partition by event_id, market, pair_line, selection order by captured_at) = 1),
 cl as (select event_id, market, pair_line, selection, arg_max(fair, captured_at) as close_fair, max(captured_at) as closed_at from fb group by all),
 fin as (select event_id, max(captured_at) as final_capture from fb group by all),
 gr as (select f1.*, case when closed_at = final_capture and closed_at > f1.captured_at then close_fair end as close_fair from f1 left join cl using (event_id, market, pair_line, selection) left join fin using (event_id)),
 graded as (select *, close_fair * best_decimal - 1 as clv, case event_id % 3 when 0 then 'high_major' when 1 then 'mid_major' else 'unplaced' end as tier from gr)"""


def graded(t):
    board = Q.fair_board(t.board)
    tier = F.when(F.col("event_id") % 3 == 0, "high_major").when(F.col("event_id") % 3 == 1, "mid_major").otherwise("unplaced")
    return Q.graded_shops(board, Q.shops(board)).withColumn("tier", tier)


@query("closing_grade", FB + " close_fair:d clv:d", f"with {GRADED} select * from graded")
def _(t):
    return graded(t)


@query("price_shop_cells", "tier:s shops:i graded:i games:i mean:d low:d high:d beat_close:d",
       f"""with {GRADED}, g as (select * from graded where clv is not null), i as ({S.interval('g', 'tier', {'game': 'event_id'}, 'clv', Z6)})
       select tier, count(*) as shops, count(clv) as graded, count(distinct case when clv is not null then event_id end) as games, case when count(clv) > 0 then avg(clv) end as mean,
       case when count(clv) >= 30 then any_value(i.adjusted_low) end as low, case when count(clv) >= 30 then any_value(i.adjusted_high) end as high, count(*) filter (clv > 0) / nullif(cast(count(clv) as double), 0) as beat_close
       from graded left join i using (tier) group by tier""")
def _(t):
    rows = graded(t)
    counts = rows.groupBy("tier").agg(
        F.count("*").alias("shops"), F.count("clv").alias("graded"), F.countDistinct(F.when(F.col("clv").isNotNull(), F.col("event_id"))).alias("games"),
        F.avg("clv").alias("mean"), F.try_divide(F.count_if(F.col("clv") > 0), F.count("clv")).alias("beat_close"))
    cells = I.interval(rows, [["tier"]], {"game": "event_id"}, "clv", LOOKS).select("tier", "adjusted_low", "adjusted_high")
    shown = lambda c: F.when(F.col("graded") >= Q.MIN_GRADED, F.col(c))
    return counts.join(cells, "tier", "left").withColumns({"low": shown("adjusted_low"), "high": shown("adjusted_high")})


SURV = """st as (select captured_at, lead(captured_at) over (order by captured_at) as nxt from (select distinct captured_at from board)),
 cov as (select distinct captured_at, event_id, market from board), pres as (select distinct captured_at, event_id, market, selection, line, book, american_odds from board),
 lab as (select b.*, st.nxt, case when nxt is null or c.event_id is null then 'unknown' when p.event_id is not null then 'survived' else 'gone' end as label
  from board b join st using (captured_at) left join cov c on c.captured_at = nxt and c.event_id = b.event_id and c.market = b.market
  left join pres p on p.captured_at = nxt and p.event_id = b.event_id and p.market = b.market and p.selection = b.selection and p.line is not distinct from b.line and p.book = b.book and p.american_odds = b.american_odds)"""
COUNTS = "count(*) filter (label = 'survived') as survived, count(*) filter (label = 'gone') as gone, count(*) filter (label = 'unknown') as unknown, count(*) filter (label = 'survived') / nullif(cast(count(*) filter (label <> 'unknown') as double), 0) as rate"
SC = " survived:i gone:i unknown:i rate:d"


@query("survival_counts", "captured_at:t next_capture:t" + SC, f"with {SURV} select captured_at, nxt as next_capture, {COUNTS} from lab where nxt is not null group by all")
def _(t):
    return M.survival(t.board)


@query("survival_by_book", "captured_at:t book:s" + SC, f"with {SURV} select captured_at, book, {COUNTS} from lab where nxt is not null group by all")
def _(t):
    return M.survival(t.board, ["book"])


@query("survival_by_tier", "captured_at:t tier:s" + SC, f"with {SURV} select captured_at, tier, {COUNTS} from lab where nxt is not null group by all")
def _(t):
    return M.survival(t.board, ["tier"])


@query("survival_label", "event_id:i market:s reachability:s n:i", f"with {SURV} select event_id, market, label as reachability, count(*) as n from lab group by all")
def _(t):
    return M.label_bets(t.board, t.board).groupBy("event_id", "market", "reachability").agg(F.count("*").alias("n"))


@query("survival_label_unstamped", "event_id:i market:s reachability:s n:i",
       f"""with {SURV}, fs as (select event_id, market, selection, line, book, american_odds, min(captured_at) as captured_at from board group by all),
       one as (select distinct captured_at, event_id, market, selection, line, book, american_odds, label from lab)
       select b.event_id, b.market, one.label as reachability, count(*) as n from board b join fs on b.event_id = fs.event_id and b.market = fs.market and b.selection = fs.selection and b.line is not distinct from fs.line and b.book = fs.book and b.american_odds = fs.american_odds
        join one on one.captured_at = fs.captured_at and one.event_id = b.event_id and one.market = b.market and one.selection = b.selection and one.line is not distinct from b.line and one.book = b.book and one.american_odds = b.american_odds group by all""")
def _(t):
    return M.label_bets(t.board.drop("captured_at"), t.board).groupBy("event_id", "market", "reachability").agg(F.count("*").alias("n"))


def staked(t):
    return M.label_bets(t.board, t.board)


SPLIT = f"""with {SURV}, s as (select *, label as reachability from lab) select tier, reachability, * exclude (tier, reachability) from ({S.interval('s', 'tier, reachability', BOTH, z=Z6)})
 union all by name select 'pooled' as tier, reachability, * exclude (reachability) from ({S.interval('s', 'reachability', BOTH, z=Z6)})"""


@query("reachability_split", "tier:s reachability:s " + IV, SPLIT)
def _(t):
    return M.reachability_split(staked(t), LOOKS)


@query("reachability_split_by_market", "market:s reachability:s roi:d bets:i", SPLIT.replace("tier", "market"))
def _(t):
    return M.reachability_split(staked(t), LOOKS, by="market")


@query("reachability_verdict", "tier:s survived_bets:i gone_bets:i unknown_bets:i verdict:s",
       f"""with sp as ({SPLIT}) select tier, coalesce(max(bets) filter (reachability = 'survived'), 0) as survived_bets, coalesce(max(bets) filter (reachability = 'gone'), 0) as gone_bets, coalesce(max(bets) filter (reachability = 'unknown'), 0) as unknown_bets,
       case when max(verdict) filter (reachability = 'survived') = 'demonstrated edge' then 'reachable in surviving prices' when max(verdict) filter (reachability = 'gone') = 'demonstrated edge' then 'not reachable'
       when coalesce(max(bets) filter (reachability = 'survived'), 0) < 200 and coalesce(max(bets) filter (reachability = 'gone'), 0) < 200 then 'not enough evidence' else 'no demonstrated edge' end as verdict from sp group by tier""")
def _(t):
    return M.reachability_verdict(M.reachability_split(staked(t), LOOKS))


@query("opening_split", "taken:s " + IV,
       f"""with fc as (select year(slate_date) as y, min(captured_at) as fc from board group by all),
       s as (select b.* exclude (slate_date), make_date(year(slate_date), 1, 1) as slate_date, case when captured_at = fc then 'at first capture' else 'later' end as taken from board b join fc on year(b.slate_date) = fc.y)
       {S.interval('s', 'taken', BOTH, z=Z6)}""")
def _(t):
    yearly = t.board.withColumn("slate_date", F.trunc("slate_date", "year"))
    return M.opening_split(yearly, yearly, LOOKS)


@query("store_summary", "quotes:i captures:i first_capture:t last_capture:t events:i books:i slate_days:i judged_quotes:i enough_evidence:b",
       f"""with {SURV} select count(*) as quotes, count(distinct captured_at) as captures, min(captured_at) as first_capture, max(captured_at) as last_capture, count(distinct event_id) as events, count(distinct book) as books,
       count(distinct slate_date) as slate_days, count(*) filter (nxt is not null and label <> 'unknown') as judged_quotes, count(distinct captured_at) >= 2 and count(*) filter (nxt is not null and label <> 'unknown') >= 1000 as enough_evidence from lab""")
def _(t):
    return M.store_summary(t.board)


def cons(where: str = "true") -> str:
    return f"""rows0 as (select * from board where {where}),
 bk as (select event_id, captured_at, book, max({S.payout('american_odds')}) filter (market = 'moneyline' and selection = 'home') as ph, max({S.payout('american_odds')}) filter (market = 'moneyline' and selection = 'away') as pa from rows0 group by all),
 ml as (select event_id, captured_at, quantile_cont((1 / (1 + ph)) / (1 / (1 + ph) + 1 / (1 + pa)), 0.5) as moneyline from bk group by all),
 ln as (select event_id, captured_at, quantile_cont(case when market = 'spread' and selection = 'home' then line end, 0.5) as spread, quantile_cont(case when market = 'total_points' and selection = 'over' then line end, 0.5) as total_points from rows0 group by all),
 cons as (select * from ml join ln using (event_id, captured_at))"""


CLOSE = cons("captured_at <= commence_time") + ", closing as (select event_id, captured_at as closed_at, moneyline as close_moneyline, spread as close_spread, total_points as close_total from cons qualify row_number() over (partition by event_id order by captured_at desc) = 1)"


@query("closing_consensus", "event_id:i closed_at:t close_moneyline:d close_spread:d close_total:d", f"with {CLOSE} select * from closing")
def _(t):
    return M.closing_consensus(t.board)


CLV = """case when market = 'moneyline' then case when selection = 'home' then close_moneyline else 1 - close_moneyline end - 1 / (1 + {pay})
 when market = 'spread' then case when selection = 'home' then line - close_spread else line + close_spread end when selection = 'over' then close_total - line else line - close_total end""".format(pay=S.payout("american_odds"))


@query("closing_value", "event_id:i market:s selection:s n:i mean_value:d mean_chance:d",
       f"""with {CLOSE} select event_id, market, selection, count(*) as n, avg({CLV}) as mean_value,
       avg(case when market = 'moneyline' then case when selection = 'home' then close_moneyline else 1 - close_moneyline end when market = 'spread' then {S.normal_cdf("(case when selection = 'home' then line - close_spread else line + close_spread end) / 11e0")}
        else {S.normal_cdf("(case when selection = 'over' then close_total - line else line - close_total end) / 16e0")} end) as mean_chance
       from board left join closing using (event_id) group by all""")
def _(t):
    rows = M.with_closing(t.board, M.closing_consensus(t.board))
    return rows.groupBy("event_id", "market", "selection").agg(F.count("*").alias("n"), F.avg("clv").alias("mean_value"), F.avg("close_chance").alias("mean_chance"))


@query("closing_probability", "event_id:i orderkey:i partkey:i linenumber:i market:s chance:d",
       f"""with {CLOSE}, b as (select * from board left join closing using (event_id))
       select event_id, orderkey, partkey, linenumber, 'team_total' as market, {S.normal_cdf('((close_total - close_spread) / 2 - (60.5e0 + linenumber)) / 9.7e0')} as chance from b
       union all select event_id, orderkey, partkey, linenumber, 'alternate_total_points', 1 - {S.normal_cdf('(close_total - (128.5e0 + linenumber)) / 16e0')} from b""")
def _(t):
    ask = lambda m, s, base: F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), (base + F.col("linenumber")).alias("line"))
    asks = t.board.select("event_id", "orderkey", "partkey", "linenumber", "american_odds", F.inline(F.array(ask("team_total", "home_over", F.lit(60.5)), ask("alternate_total_points", "under", F.lit(128.5)))))
    return M.with_closing(asks, M.closing_consensus(t.board)).withColumnRenamed("close_chance", "chance")


@query("closing_alarm", "tier:s market:s leans:i graded:i games:i survived:i gone:i unknown:i mean:d low:d high:d beat_close:d alarm:b",
       f"""with {SURV}, {CLOSE}, l as (select *, {CLV} as clv from lab left join closing using (event_id) where edge >= 0.02), g as (select * from l where clv is not null),
       i as ({S.interval('g', 'tier, market', {'game': 'event_id'}, 'clv', Z6)})
       select l.tier, l.market, count(*) as leans, count(clv) as graded, count(distinct case when clv is not null then event_id end) as games, count(*) filter (label = 'survived') as survived, count(*) filter (label = 'gone') as gone, count(*) filter (label = 'unknown') as unknown,
       any_value(i.roi) as mean, any_value(i.adjusted_low) as low, any_value(i.adjusted_high) as high, count(*) filter (clv > 0) / nullif(cast(count(clv) as double), 0) as beat_close,
       coalesce(count(clv) >= 100 and count(distinct case when clv is not null then event_id end) >= 20 and any_value(i.adjusted_high) < 0, false) as alarm from l left join i using (tier, market) group by all""")
def _(t):
    return M.closing_alarm(t.board, t.board, LOOKS)


MOVES = cons() + """, ends as (select event_id, arg_min(moneyline, captured_at) as m0, arg_max(moneyline, captured_at) as m1, min(captured_at) as c0, max(captured_at) as c1 from cons group by all),
 raw as (select e.event_id, a.moneyline as am, b.moneyline as bm, a.spread as asp, b.spread as bsp, a.total_points as ato, b.total_points as bto from ends e join cons a on a.event_id = e.event_id and a.captured_at = c0 join cons b on b.event_id = e.event_id and b.captured_at = c1 where c0 < c1),
 moves as (select * from (select event_id, 'moneyline' as market, am as opened, bm as now from raw union all select event_id, 'spread', asp, bsp from raw union all select event_id, 'total_points', ato, bto from raw) where opened is not null and now is not null),
 moved as (select b.*, m.opened, m.now, (now - opened) * case when market = 'moneyline' then case when selection = 'home' then 1 else -1 end when market = 'spread' then case when selection = 'home' then -1 else 1 end when selection = 'over' then 1 else -1 end as toward,
  case when market = 'moneyline' then 0.02e0 else 1e0 end as bar from board b left join moves m using (event_id, market))"""


@query("consensus_moves", "event_id:i market:s opened:d now:d", f"with {MOVES} select * from moves")
def _(t):
    return M.moves(t.board)


@query("market_movement_advice", "event_id:i market:s selection:s advice:s n:i", f"with {MOVES} select event_id, market, selection, case when toward >= bar then 'now' else 'near tip' end as advice, count(*) as n from moved group by all")
def _(t):
    rows = M.with_moves(t.board, M.moves(t.board)).withColumn("advice", M.advice())
    return rows.groupBy("event_id", "market", "selection", "advice").agg(F.count("*").alias("n"))


@query("move_restraint", "event_id:i orderkey:i partkey:i linenumber:i trusted:d",
       f"with {MOVES} select event_id, orderkey, partkey, linenumber, case when model_probability > 0.5e0 and toward <= -bar then 0.5e0 + 0.5e0 * (model_probability - 0.5e0) else model_probability end as trusted from moved")
def _(t):
    return M.with_moves(t.board, M.moves(t.board)).withColumn("trusted", M.restrained(F.col("model_probability"), F.lit(0.5)))


@query("line_history", "event_id:i captured_at:t home_price:d spread_line:d total_line:d captures:i open_price:d open_spread:d open_total:d",
       """with h as (select event_id, captured_at, max(american_odds) filter (market = 'moneyline' and selection = 'home') as home_price,
         max(line) filter (market = 'spread' and selection = 'home') as spread_line, max(line) filter (market = 'total_points' and selection = 'over') as total_line from board group by all)
       select *, first_value(home_price) over w as open_price, first_value(spread_line) over w as open_spread, first_value(total_line) over w as open_total from (select *, count(*) over (partition by event_id) as captures from h) where captures >= 2
       window w as (partition by event_id order by captured_at)""")
def _(t):
    return M.line_history(t.board)


@query("market_probabilities", "event_id:i market:s pair_line:d fair_first:d books:i",
       f"""with b0 as (select * exclude (event_id), event_id * 1000000 + year(captured_at) * 100 + month(captured_at) as event_id, case market when 'moneyline' then 0e0 when 'spread' then case when selection = 'away' then -line else line end else line end as pl, selection in ('home', 'over') as fs from board),
       b1 as (select event_id, market, pl, book, max(payout0) filter (fs) as a, max(payout0) filter (not fs) as b from (select *, {S.payout('american_odds')} as payout0 from b0) group by all),
       b2 as (select *, 1 / (1 + a) as ia, 1 / (1 + b) as ib from b1), b3 as (select *, {S.power_fair('ia', 'ib')} as f from b2)
       select event_id, market, pl as pair_line, quantile_cont(f, 0.5) as fair_first, count(f) as books from b3 where f is not null group by all having count(f) >= 3""")
def _(t):
    per_capture = t.board.withColumn("event_id", F.col("event_id") * 1000000 + F.year("captured_at") * 100 + F.month("captured_at"))
    return Q.market_probabilities(per_capture)


@query("trust_blend", "event_id:i orderkey:i partkey:i linenumber:i blended:d",
       """select event_id, orderkey, partkey, linenumber, m + w * (model_probability - m) as blended from (select *, 0.48e0 + (partkey % 10) / 200e0 as m, case tier when 'high_major' then 0.1e0 when 'mid_major' then 0.4e0 else 0.25e0 end as w from board)""")
def _(t):
    table = t.spark.createDataFrame([("high_major", 0.1), ("mid_major", 0.4)], "tier string, weight double")
    m = 0.48 + (F.col("partkey") % 10) / 200.0
    rows = t.board.join(F.broadcast(table), "tier", "left").withColumn("weight", F.coalesce("weight", F.lit(0.25)))
    return rows.withColumn("blended", m + F.col("weight") * (F.col("model_probability") - m))


@query("best_and_consensus_line", "event_id:i captured_at:t market:s selection:s best_odds:d best_book:s modal_line:d",
       f"""select event_id, captured_at, market, selection, arg_max(american_odds, ({S.payout('american_odds')}, book)) as best_odds, arg_max(book, ({S.payout('american_odds')}, book)) as best_book, min(line) as modal_line from board group by all""")
def _(t):
    top = F.struct(P.payout("american_odds"), F.col("book"))
    return t.board.groupBy("event_id", "captured_at", "market", "selection").agg(
        F.max_by("american_odds", top).alias("best_odds"), F.max_by("book", top).alias("best_book"), F.mode("line", True).alias("modal_line"))
