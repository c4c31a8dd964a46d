"""Scalar operators and row predicates."""

from pyspark.sql import functions as F

from closeline.functions import prices as P, text as T, times as C
from closeline.operators import quotes as Q
from closeline.plans import sql as S
from closeline.plans.registry import query

QK = "event_id:i partkey:i suppkey:i market:s"


@query("odds_to_payout", QK + " payout:d", f"select event_id, partkey, suppkey, market, {S.payout('american_odds')} as payout from quotes")
def _(t):
    return t.quotes.withColumn("payout", P.payout("american_odds"))


@query("odds_to_decimal", QK + " decimal_price:d", f"select event_id, partkey, suppkey, market, {S.decimal('american_odds')} as decimal_price from quotes")
def _(t):
    return t.quotes.withColumn("decimal_price", P.decimal_price("american_odds"))


@query("implied_probability", QK + " implied:d", f"select event_id, partkey, suppkey, market, {S.implied('american_odds')} as implied from quotes")
def _(t):
    return t.quotes.withColumn("implied", P.implied("american_odds"))


@query("expected_value_and_profit", QK + " ev:d profit:d",
       f"""select event_id, partkey, suppkey, market, model_probability / {S.implied('american_odds')} - 1 as ev,
       case outcome when 'won' then {S.payout('american_odds')} when 'lost' then -1 when 'push' then 0 when 'void' then 0 end as profit from quotes""")
def _(t):
    return t.quotes.withColumns({"ev": P.expected_value("model_probability", "american_odds"), "profit": P.profit_units("outcome", "american_odds")})


@query("power_fair", "l_partkey:i l_suppkey:i l_orderkey:i l_linenumber:i fair:d other:d",
       f"""select *, {S.power_fair('a', 'b')} as fair, {S.power_fair('b', 'a')} as other from
       (select l_partkey, l_suppkey, l_orderkey, l_linenumber, 0.30e0 + (l_partkey % 400) / 1000e0 as a, 0.32e0 + (l_suppkey * 7 % 350) / 1000e0 as b from lineitem)""")
def _(t):
    a, b = 0.30 + (F.col("l_partkey") % 400) / 1000.0, 0.32 + (F.col("l_suppkey") * 7 % 350) / 1000.0
    return t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", a.alias("a"), b.alias("b")).withColumns(
        {"fair": P.power_fair("a", "b"), "other": P.power_fair("b", "a")})


def _worst(p: str) -> str:
    """First American price, shortest payout first, that still clears the edge."""
    prices = "list_concat(range(-400, -100), range(100, 601))"
    return f"list_filter({prices}, lambda a: {p} * (1 + case when a > 0 then a / 100e0 else -100e0 / a end) - 1 >= 0.02e0)[1]"


@query("bet_down_to_price", QK + " american:i from_edge:i",
       f"""select event_id, partkey, suppkey, market, {_worst('model_probability')} as american, {_worst('p2')} as from_edge
       from (select *, (1 + edge) / (1 + payout) as p2 from quotes)""")
def _(t):
    return t.quotes.withColumns({"american": P.bet_down_to("model_probability"), "from_edge": P.bet_down_to_from_edge("edge", "american_odds")})


@query("stake_units", QK + " units:d ladder:d",
       """select event_id, partkey, suppkey, market,
       case when american_odds < 200 then null when american_odds <= 500 then 0.6 when american_odds <= 1500 then 0.4 else 0.2 end as ladder,
       case when american_odds >= 200 then case when american_odds <= 500 then 0.6 when american_odds <= 1500 then 0.4 else 0.2 end
            when model_probability is null then 1.0 else round(round_even((1 + model_probability) / 0.2e0, 0) * 0.2e0, 2) end as units from quotes""")
def _(t):
    return t.quotes.withColumns({"units": P.units("model_probability", "american_odds"), "ladder": P.ladder_units("american_odds")})


@query("normal_tail", "l_orderkey:i l_partkey:i l_suppkey:i x:d tail:d",
       f"""select *, {S.normal_cdf('x')} as tail from (select l_orderkey, l_partkey, l_suppkey, (l_partkey % 120 - 60) / 10e0 as x from lineitem)""")
def _(t):
    return t.lineitem.withColumn("x", (F.col("l_partkey") % 120 - 60) / 10.0).withColumn("tail", P.normal_cdf("x"))


W0, W1 = S.wilson("wins", "n")


@query("wilson_interval", "market:s tier:s wins:i n:i low:d high:d",
       f"select *, {W0} as low, {W1} as high from (select market, tier, count(*) filter (outcome = 'won') as wins, count(*) as n from quotes group by all)")
def _(t):
    out = t.quotes.groupBy("market", "tier").agg(F.count_if(F.col("outcome") == "won").alias("wins"), F.count("*").alias("n"))
    low, high = P.wilson(F.col("wins"), F.col("n"))
    return out.withColumns({"low": low, "high": high})


@query("slate_date_and_season", "event_id:i slate_date:t season:i",
       """select event_id, cast(((ts at time zone 'UTC') at time zone 'America/New_York') as date) as slate_date,
       case when month(((ts at time zone 'UTC') at time zone 'America/New_York')) >= 7 then 1 else 0 end + year(((ts at time zone 'UTC') at time zone 'America/New_York')) as season from events""")
def _(t):
    return t.events.withColumn("slate_date", C.slate_date("ts")).withColumn("season", C.season_of("slate_date"))


@query("start_window", "event_id:i tip_window:s",
       """select event_id, case when h >= 21 or h < 8 then 'late' when h >= 17 then 'early_evening' else 'afternoon' end as tip_window
       from (select event_id, hour((ts at time zone 'UTC') at time zone 'America/New_York') as h from events)""")
def _(t):
    return t.events.withColumn("tip_window", C.tip_window("ts"))


@query("tip_state_and_playable", "event_id:i state:s playable:b",
       """select event_id, case when m <= 0 then 'started' when m <= 60 then 'imminent' else 'upcoming' end as state, m > 60 as playable
       from (select event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) / 60e6 as m from events)""")
def _(t):
    state = C.tip_state("ts", F.lit("2024-01-15 12:00:00"))
    return t.events.withColumn("state", state).withColumn("playable", C.can_be_played("state"))


@query("minutes_parse", "row_key:i minutes:d",
       """select row_key, cast(l as bigint) + case when r = '' then 0 else cast(r as double) / 60 end as minutes from
       (select row_key, split_part(txt, ':', 1) as l, split_part(txt, ':', 2) as r from
       (select row_key, case when row_key % 3 = 0 then cast(cast(floor(minutes) as bigint) as varchar) else cast(cast(floor(minutes) as bigint) as varchar) || ':' || lpad(cast(row_key % 60 as varchar), 2, '0') end as txt from player_games))""")
def _(t):
    whole = F.col("minutes").cast("long").cast("string")
    txt = F.when(F.col("row_key") % 3 == 0, whole).otherwise(F.concat(whole, F.lit(":"), F.lpad((F.col("row_key") % 60).cast("string"), 2, "0")))
    return t.player_games.select("row_key", txt.alias("txt")).withColumn("minutes", C.parse_minutes("txt"))


@query("canonical_value", "l_orderkey:i l_partkey:i l_suppkey:i qty:s disc:s word:s none:s",
       """select l_orderkey, l_partkey, l_suppkey, cast(cast(l_quantity as bigint) as varchar) as qty,
       case when l_discount = 0 then '0' else cast(l_discount as varchar) end as disc, l_returnflag as word,
       case when l_linenumber = 1 then '' else cast(l_linenumber as varchar) end as none from lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", T.canonical_value(F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).alias("qty"),
        T.canonical_value("l_discount").alias("disc"), T.canonical_value(F.concat("l_returnflag", F.lit("  "))).alias("word"),
        T.canonical_value(F.when(F.col("l_linenumber") == 1, F.lit("NaN")).otherwise(F.col("l_linenumber").cast("string"))).alias("none"))


@query("quote_identity_normalise", "event_id:s market:s segment:s player:s selection:s line:s book:s american_odds:s n:i",
       """select cast(event_id as varchar) as event_id, market, segment, player, selection,
       case when line is null then '' when line = floor(line) then cast(cast(line as bigint) as varchar) else cast(line as varchar) end as line,
       book, cast(cast(american_odds as bigint) as varchar) as american_odds, count(*) as n from quotes group by all""")
def _(t):
    return Q.normalise_identity(t.quotes).groupBy(*Q.QUOTE_IDENTITY).agg(F.count("*").alias("n"))


@query("subject_normalise", "event_id:i subject:s n:i", "select event_id, lower(player) as subject, count(*) as n from quotes group by all")
def _(t):
    return t.quotes.withColumn("subject", T.normalise_subject(F.concat(F.lit(" "), "player"))).groupBy("event_id", "subject").agg(F.count("*").alias("n"))


@query("clean_text", "doc_id:i cleaned:s", "select doc_id, case when doc_id % 4 = 0 then '' else trim(source) end as cleaned from documents")
def _(t):
    return t.documents.withColumn("cleaned", T.clean_text(F.when(F.col("doc_id") % 4 == 0, F.lit(" NaN ")).otherwise(F.concat(F.lit("  "), "source"))))


@query("shrinkage", "team_id:i n:i rate:d", "select team_id, count(*) as n, count(*) / (count(*) + 15e0) * avg(margin) + 15e0 / (count(*) + 15e0) * 1.5e0 as rate from team_games group by team_id")
def _(t):
    out = t.team_games.groupBy("team_id").agg(F.count("*").alias("n"), F.avg("margin").alias("m"))
    return out.withColumn("rate", P.shrink(F.col("m"), F.col("n"), 1.5, F.lit(15.0)))


@query("name_normalise", "row_key:s name:s",
       """select row_key, trim(regexp_replace(regexp_replace(regexp_replace(lower(spelled), '[^a-z0-9 ]+', ' ', 'g'), '\\b(university|univ|college|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) as name from spelled""")
def _(t):
    return t.spelled.withColumn("name", T.normalise_name("spelled"))


@query("name_variants", "row_key:i variant:s",
       """select row_key, unnest(list_distinct([w || ' ' || n, full1 || ' ' || n, full2 || ' ' || n])) as variant from
       (select c_custkey as row_key, case when c_custkey % 3 = 0 then 'st' else 'mount' end as w, case when c_custkey % 3 = 0 then 'state' else 'mount' end as full1,
        case when c_custkey % 3 = 0 then 'saint' else 'mount' end as full2, lower(replace(c_name, '#', ' ')) as n from customer)""")
def _(t):
    spelled = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lit("St. ")).otherwise(F.lit("Mt ")), "c_name", F.lit(" University"))
    return t.customer.select(F.col("c_custkey").alias("row_key"), F.explode(T.name_variants(spelled)).alias("variant"))


@query("player_name_forms", "row_key:i form:s",
       """select row_key, unnest([f, replace(f, ' q ', ' ')]) as form from
       (select c_custkey as row_key, unnest([a || ' q ' || b || ' ' || c, a || ' q ' || b, a || ' q ' || c]) as f from
        (select c_custkey, lower(c_mktsegment) as a, 'x' || cast(c_custkey as varchar) as b, 'y' || cast(c_nationkey as varchar) as c from customer))""")
def _(t):
    spelled = F.concat("c_mktsegment", F.lit(" Q. X"), F.col("c_custkey").cast("string"), F.lit("-Y"), F.col("c_nationkey").cast("string"), F.lit(" Jr."))
    return t.customer.select(F.col("c_custkey").alias("row_key"), F.explode(T.player_variants(spelled)).alias("form"))


@query("player_name_abbreviations", "row_key:i form:s",
       """select c_custkey as row_key, substr(lower(c_mktsegment), 1, 1) || ' customer' || substr(c_name, 10) as form from customer""")
def _(t):
    spelled = F.concat("c_mktsegment", F.lit(" "), F.regexp_replace("c_name", "#", ""))
    return t.customer.select(F.col("c_custkey").alias("row_key"), F.explode(T.player_abbreviations(spelled)).alias("form"))


@query("hyphen_forms_table_function", "p_partkey:i form:s",
       """select p_partkey, unnest([a || '-' || b || ' ' || p_brand, a || ' ' || p_brand, b || ' ' || p_brand]) as form
       from (select p_partkey, p_brand, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part)""")
def _(t):
    spelled = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(" "), "p_brand")
    return t.part.select("p_partkey", F.explode(T.hyphen_forms(spelled)).alias("form"))


@query("selection_words", "event_id:i partkey:i suppkey:i team:s total:s yes:s team_total:s",
       """select event_id, partkey, suppkey,
       case when partkey % 3 = 0 then 'home' when partkey % 3 = 1 then 'away' end as team,
       case when partkey % 2 = 0 then 'over' else 'under' end as total, case when suppkey % 3 = 0 then 'over' when suppkey % 3 = 1 then 'under' end as yes,
       case when partkey % 3 = 0 then 'home_' when partkey % 3 = 1 then 'away_' end || case when partkey % 2 = 0 then 'over' else 'under' end as team_total from quotes""")
def _(t):
    third = F.col("partkey") % 3
    school = F.when(third == 0, F.col("home_team")).when(third == 1, F.concat(F.lit(" "), "away_team", F.lit(" "))).otherwise(F.lit("Nobody"))
    word = F.when(F.col("partkey") % 2 == 0, "Over").otherwise(" U ")
    yes = F.when(F.col("suppkey") % 3 == 0, "YES").when(F.col("suppkey") % 3 == 1, "No").otherwise("maybe")
    return t.quotes.select("event_id", "partkey", "suppkey", T.team_selection(school, "home_team", "away_team").alias("team"),
                           T.over_under_selection(word).alias("total"), T.yes_no_selection(yes).alias("yes"),
                           T.team_total_selection(word, school, "home_team", "away_team").alias("team_total"))


@query("edge", QK + " edge2:d", f"select event_id, partkey, suppkey, market, model_probability * (1 + {S.payout('american_odds')}) - 1 as edge2 from quotes")
def _(t):
    return t.quotes.withColumn("edge2", P.expected_value("model_probability", "american_odds"))


@query("bet_predicate", QK + " edge:d", "select event_id, partkey, suppkey, market, edge from quotes where edge >= 0.02e0")
def _(t):
    return t.quotes.filter(F.col("edge") >= P.EDGE_THRESHOLD)


@query("settled_predicates", "market:s tier:s settled:i opinions:i",
       """select market, tier, count(profit_units) as settled, count(*) filter (outcome in ('won', 'lost') and model_probability is not null) as opinions from quotes group by all""")
def _(t):
    return t.quotes.groupBy("market", "tier").agg(
        F.count("profit_units").alias("settled"),
        F.count_if(F.col("outcome").isin("won", "lost") & F.col("model_probability").isNotNull()).alias("opinions"))


@query("selected_flag", "market:s n:i", "select market, count(*) as n from quotes where suppkey % 2 = 0 group by all")
def _(t):
    flag = F.when(F.col("suppkey") % 4 == 0, " TRUE ").when(F.col("suppkey") % 4 == 2, "1").when(F.col("suppkey") % 4 == 1, "False").otherwise("")
    return t.quotes.withColumn("flag", flag).filter(T.truthy("flag")).groupBy("market").agg(F.count("*").alias("n"))


@query("price_band", "market:s n:i", "select market, count(*) as n from quotes where american_odds >= -400 and american_odds <= 600 group by all")
def _(t):
    return t.quotes.filter(P.in_price_band("american_odds")).groupBy("market").agg(F.count("*").alias("n"))


@query("measurable_rows", QK + " outcome:s profit_units:d edge:d",
       "select event_id, partkey, suppkey, market, outcome, profit_units, edge from quotes where market <> 'player_points' and outcome in ('won', 'lost', 'push')")
def _(t):
    from closeline.operators import ledger
    return ledger.measurable(t.quotes, refused_markets=["player_points"])


@query("markets_refused_by_name", "market:s n:i", "select market, count(*) as n from quotes where market not in ('spread', 'player_points') group by all")
def _(t):
    from closeline.operators import ledger
    return ledger.without_markets(t.quotes, ["spread", "player_points"]).groupBy("market").agg(F.count("*").alias("n"))


@query("strict_past_cut", "team_id:i n:i last_day:t", "select team_id, count(*) as n, max(slate_date) as last_day from team_games where slate_date < date '1998-03-15' group by all")
def _(t):
    from closeline.operators import history
    return history.before(t.team_games, "1998-03-15").groupBy("team_id").agg(F.count("*").alias("n"), F.max("slate_date").alias("last_day"))


@query("latest_day", "season:i day:t", "select season, max(slate_date) as day from team_games group by all")
def _(t):
    return t.team_games.groupBy("season").agg(F.max("slate_date").alias("day"))


@query("rest_bucket", "row_key:i bucket:s",
       """select row_key, case when d < 1 then null when d = 1 then 'second game in two days' when d = 2 then 'one day off' when d <= 5 then 'ordinary rest' else 'six or more days off' end as bucket
       from (select row_key, row_key % 9 as d from player_games)""")
def _(t):
    return t.player_games.withColumn("bucket", C.rest_bucket(F.col("row_key") % 9))


@query("role_bucket", "row_key:i bucket:i",
       "select row_key, case when minutes = 0 then -1 else least(8, greatest(0, cast(floor((minutes - 4) / 4e0) as bigint))) end as bucket from player_games")
def _(t):
    from closeline.operators import players
    return t.player_games.withColumn("bucket", C.minutes_bucket(F.when(F.col("minutes") > 0, F.col("minutes")), players.BUCKET_EDGES))


@query("game_tier", "game_id:i tier:s",
       """select game_id, case greatest(nullif(coalesce(home_id, 0) % 4, 3), nullif(away_id % 4, 3)) when 0 then 'high_major' when 1 then 'mid_major' when 2 then 'low_major' else 'unplaced' end as tier from schedule""")
def _(t):
    from closeline.operators import schedules
    names = F.array(*[F.lit(x) for x in schedules.TIERS])
    pick = lambda c: F.element_at(names, (F.coalesce(F.col(c), F.lit(0)) % 4 + 1).cast("int"))
    return t.schedule.withColumn("tier", schedules.game_tier(pick("home_id"), pick("away_id")))
