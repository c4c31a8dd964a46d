"""Streaming operators by their batch twins; the tests drive the streams themselves."""

from pyspark.sql import functions as F

from closeline.functions import prices as P
from closeline.operators import captures as M, quotes as Q
from closeline.sources import stores as S
from closeline.streaming import live as V
from closeline.plans.boards import CLOSE, COUNTS, FAIR, SURV
from closeline.plans.registry import query


@query("capture_stream", "captured_at:t event_id:i market:s selection:s line:d book:s american_odds:d", "select distinct captured_at, event_id, market, selection, line, book, american_odds from board")
def _(t):
    rows = S.with_identity(t.board, V.IDENTITY)
    return rows.dropDuplicates(S.identity_columns(rows))


@query("survival_stream", "captured_at:t next_capture:t survived:i gone:i unknown:i",
       f"with {SURV.replace('from board b join st', 'from (select distinct captured_at, event_id, market, selection, line, book, american_odds from board) b join st')} select captured_at, nxt as next_capture, {COUNTS} from lab where nxt is not null group by all")
def _(t):
    """What the sink has written when every capture has come, each identity once."""
    rows = S.with_identity(t.board, V.IDENTITY)
    return M.survival(rows.dropDuplicates(S.identity_columns(rows)).select(*t.board.columns))


@query("closing_stream", "event_id:i closed_at:t close_moneyline:d close_spread:d close_total:d", f"with {CLOSE} select * from closing")
def _(t):
    return M.closing_consensus(t.board)


@query("alert_stream", "captured_at:t event_id:i market:s selection:s pair_line:d best_book:s shop_edge:d",
       f"""with {FAIR}, st as (select captured_at, lag(captured_at) over (order by captured_at) as prev from (select distinct captured_at from board))
       select s.captured_at, event_id, market, selection, pair_line, best_book, shop_edge from shop s join st using (captured_at) where shop_edge >= 0.03 and not exists (select 1 from shop p where p.shop_edge >= 0.03 and p.captured_at = st.prev
        and (p.event_id, p.market, p.pair_line, p.selection, p.best_book) = (s.event_id, s.market, s.pair_line, s.selection, s.best_book))""")
def _(t):
    """What the sink has written when every capture has come: new edges of each against the one before."""
    return Q.alerts_by_capture(Q.shops(Q.fair_board(t.board)), M.next_stamps(t.board))


@query("late_settlement", "event_id:i state:s margin:d final_at:i",
       """select event_id, case when event_id % 20 <= 14 then 'result' else 'unsettleable' end as state, case when event_id % 20 <= 14 then value end as margin, case when event_id % 20 <= 14 then epoch_us(ts) + (event_id % 20) * 86400000000 end as final_at from events""")
def _(t):
    """Every event frozen at its time, its result up to nineteen days later."""
    stamp = F.col("ts").cast("timestamp")
    quotes = t.events.select("event_id", stamp.alias("frozen_at"))
    late = stamp + F.make_interval(days=(F.col("event_id") % 20).cast("int"))
    results = t.events.select(F.col("event_id").alias("game_id"), late.alias("final_at"), F.col("value").alias("margin"))
    return V.settle_stream(quotes, results).withColumn("final_at", F.unix_micros("final_at"))


@query("daily_window_freeze", "snapshot_date:t event_id:i market:s american_odds:d quotes:i",
       "select cast(ts as date) as snapshot_date, user_id as event_id, event_type as market, first(100 + floor(value) order by ts, value desc) as american_odds, count(*) as quotes from events group by all")
def _(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("captured_at"), F.col("user_id").alias("event_id"), F.col("event_type").alias("market"), (100 + F.floor("value")).cast("double").alias("american_odds"))
    return V.daily_freeze(rows.withColumn("payout", P.payout("american_odds")), ["event_id", "market"])


@query("move_since_first_capture", "event_id:i captured_at:t first_at:t market:s opened:d now:d",
       f"""with {CLOSE}, f as (select event_id, min(captured_at) as first_at from board where captured_at <= commence_time group by all),
       m as (select c.event_id, c.captured_at, first_at, unnest([{{'m': 'moneyline', 'a': o.moneyline, 'b': c.moneyline}}, {{'m': 'spread', 'a': o.spread, 'b': c.spread}}, {{'m': 'total_points', 'a': o.total_points, 'b': c.total_points}}]) as x
        from cons c join f on f.event_id = c.event_id and c.captured_at > first_at join cons o on o.event_id = c.event_id and o.captured_at = first_at)
       select event_id, captured_at, first_at, x.m as market, x.a as opened, x.b as now from m where x.a is not null and x.b is not null""")
def _(t):
    return M.moves_by_capture(t.board)


@query("session_moves", "event_id:i market:s first_at:i opened:d now:d captures:i",
       """with g as (select *, case when ts - lag(ts) over w >= interval 3 days or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id, event_type order by ts)),
       s as (select *, sum(new) over (partition by user_id, event_type order by ts) as sess from g)
       select user_id as event_id, event_type as market, epoch_us(min(ts)) as first_at, arg_min(floor(value / 10), ts) as opened, arg_max(floor(value / 10), ts) as now, count(*) as captures from s group by user_id, event_type, sess""")
def _(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("captured_at"), F.col("user_id").alias("event_id"), F.col("event_type").alias("market"), F.floor(F.col("value") / 10).alias("line"))
    return V.first_last_moves(rows).withColumn("first_at", F.unix_micros("first_at"))


SAME = "(event_id, market, player, selection, line, book)"


@query("settled_day_marker", "slate_date:t fresh:i held:i",
       f"""with h as (select *, bool_or(tier = 'low_major') over (partition by slate_date, event_id, market, player, selection, line, book) as h from quotes)
       select slate_date, count(distinct case when not h then {SAME} end) as fresh, count(distinct case when h then {SAME} end) as held from h group by all""")
def _(t):
    keys = ("slate_date", "event_id", "market", "player", "selection", "line", "book")
    rows = t.quotes.select(*keys, "tier")
    held = rows.filter("tier = 'low_major'").drop("tier")
    fresh = S.unseen(rows.drop("tier"), held, keys)
    a = fresh.groupBy("slate_date").agg(F.count("*").alias("fresh"))
    b = held.distinct().groupBy("slate_date").agg(F.count("*").alias("held"))
    return a.join(b, "slate_date", "full_outer").na.fill(0)
