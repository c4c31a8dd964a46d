"""Adapter views: the given tables read as quotes, captures, games, plays, forecasts.

Each view is one portable SQL text, run by Spark over the parquet tables and placed as
a common table expression in front of the comparison SQL. They only rename and
recompute columns of every row: no row is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

# One staked row: event, day, subject, market, tier and the units won or lost.
VIEWS["bets"] = """
select l_orderkey as event_id, cast(l_shipdate as date) as slate_date, l_suppkey as subject,
       l_returnflag as market, l_linestatus as tier,
       case when l_partkey % 2 = 0 then 'home' else 'away' end as selection,
       case when l_discount >= 0.05e0 then l_tax * 20e0 else -1e0 end as profit_units
from {lineitem}"""

# One graded quote: identity, price, opinion, result.
VIEWS["quote_rows"] = """
select cast(l_shipdate as date) as slate_date, l_orderkey as event_id,
       'Home ' || cast(l_orderkey % 97 as string) as home_team, 'Away ' || cast(l_orderkey % 89 as string) as away_team,
       case when l_linenumber >= 6 then 'player_points' when l_linenumber % 3 = 0 then 'moneyline'
            when l_linenumber % 3 = 1 then 'spread' else 'total_points' end as market,
       'game' as segment,
       case when l_linenumber >= 6 then 'Player ' || cast(l_orderkey % 7 as string) else '' end as player,
       case when l_linenumber >= 6 or l_linenumber % 3 = 2
            then case when l_partkey % 2 = 0 then 'over' else 'under' end
            else case when l_partkey % 2 = 0 then 'home' else 'away' end end as selection,
       case when l_linenumber >= 6 then 10.5e0 + l_linenumber
            when l_linenumber % 3 = 0 then null
            when l_linenumber % 3 = 1 then (l_linenumber * 3 - 6) * 0.5e0 * case when l_partkey % 2 = 0 then 1 else -1 end
            else 140.5e0 + l_linenumber end as line,
       'book' || cast(l_suppkey % 5 as string) as book,
       case when l_partkey % 4 < 2 then 100e0 + 5 * (l_quantity - 1) else -(105e0 + 5 * l_quantity) end as american_odds,
       case l_returnflag when 'A' then 'high_major' when 'N' then 'mid_major' else 'low_major' end as tier,
       case when l_tax >= 0.08e0 then null else ((l_partkey * 37 + l_suppkey * 11) % 980 + 10) / 1000e0 end as model_probability,
       case when l_discount > 0.055e0 then 'won' when l_discount > 0.045e0 then 'push'
            when l_discount < 0.005e0 then 'void' else 'lost' end as outcome,
       l_partkey as partkey, l_suppkey as suppkey,
       l_partkey * 1000000 + l_suppkey as store_order
from {lineitem}"""

VIEWS["quotes"] = """
select q.*, case when american_odds > 0 then american_odds / 100e0 else -100e0 / american_odds end as payout,
       case when american_odds > 0 then 1e0 / (1e0 + american_odds / 100e0) else 1e0 / (1e0 - 100e0 / american_odds) end as raw_implied,
       model_probability * (1e0 + case when american_odds > 0 then american_odds / 100e0 else -100e0 / american_odds end) - 1e0 as edge,
       case outcome when 'won' then case when american_odds > 0 then american_odds / 100e0 else -100e0 / american_odds end
            when 'lost' then -1e0 else 0e0 end as profit_units
from {quote_rows} q"""

# Captures of the board of an event: half-yearly stamps, five books, two sides.
VIEWS["board_rows"] = """
select cast(l_suppkey as bigint) as event_id,
       make_date(cast(year(l_shipdate) as int), case when month(l_shipdate) <= 6 then 1 else 7 end, 1) as captured_at,
       date '2000-01-01' + cast((l_suppkey % 3) * 365 as int) as commence_time,
       l_linenumber % 3 as kind, l_linenumber as linenumber, l_orderkey as orderkey, l_partkey as partkey,
       case when l_partkey % 2 = 0 then 'first' else 'second' end as side,
       'book' || cast(l_orderkey % 5 as string) as book,
       case when l_partkey % 4 < 2 then 100e0 + l_partkey % 10 else -(105e0 + 5 * (l_orderkey % 4)) end as american_odds,
       case l_returnflag when 'A' then 'high_major' when 'N' then 'mid_major' else 'low_major' end as tier,
       ((l_partkey * 37 + l_orderkey * 11) % 980 + 10) / 1000e0 as model_probability,
       case when l_discount > 0.055e0 then 'won' when l_discount > 0.045e0 then 'push' else 'lost' end as outcome
from {lineitem}"""

VIEWS["board"] = """
select captured_at as slate_date, captured_at, commence_time, event_id,
       case kind when 0 then 'moneyline' when 1 then 'spread' else 'total_points' end as market,
       'game' as segment, '' as player,
       case when kind = 2 then case side when 'first' then 'over' else 'under' end
            else case side when 'first' then 'home' else 'away' end end as selection,
       case kind when 0 then null when 1 then (event_id % 7 - 3 + year(captured_at) % 2) * case side when 'first' then 1e0 else -1e0 end
            else 130e0 + event_id % 20 + year(captured_at) % 3 end as line,
       book, american_odds, tier, model_probability, outcome,
       model_probability * (1e0 + case when american_odds > 0 then american_odds / 100e0 else -100e0 / american_odds end) - 1e0 as edge,
       case outcome when 'won' then case when american_odds > 0 then american_odds / 100e0 else -100e0 / american_odds end
            when 'lost' then -1e0 else 0e0 end as profit_units,
       orderkey, partkey, linenumber
from {board_rows}"""

# Schedule: one row per game.
VIEWS["schedule"] = """
select o_orderkey as game_id, cast(o_orderdate as date) as slate_date,
       cast(year(o_orderdate) as bigint) as season,
       cast(case when o_orderkey % 101 = 0 then null else c_nationkey end as bigint) as home_id,
       cast((c_nationkey + 1 + o_custkey % 24) % 25 as bigint) as away_id,
       case when o_orderkey % 53 = 0 then null else o_orderkey % 4 = 0 end as neutral_site,
       cast(case when o_orderkey % 4 = 0 and o_orderkey % 3 = 0 then c_nationkey else (c_nationkey * 3 + o_custkey) % 40 end as bigint) as venue_id,
       'City ' || cast((c_nationkey + case when o_orderkey % 6 = 0 then 0 else o_custkey % 9 end) % 30 as string) as venue_city,
       'State ' || cast(c_nationkey % 5 as string) as venue_state_code,
       cast(c_nationkey % 5 as bigint) as home_conference_id,
       cast(((c_nationkey + 1 + o_custkey % 24) % 25) % 5 as bigint) as away_conference_id,
       case o_orderstatus when 'F' then 'STATUS_FINAL' when 'O' then 'STATUS_SCHEDULED' when 'P' then 'STATUS_POSTPONED' else 'STATUS_CANCELED' end as status_name,
       case when o_orderpriority = '5-LOW' and o_orderkey % 50 = 1 then 'Annual Exhibition game' else o_orderpriority end as headline,
       cast(floor(o_totalprice / 1000) as bigint) % 60 + 50 as home_score,
       cast(floor(o_totalprice) as bigint) % 60 + 50 as away_score,
       o_custkey as custkey
from {orders} join {customer} on o_custkey = c_custkey"""

# Two rows per game, one per side, with a box score.
VIEWS["sides"] = """
select game_id, season, slate_date, coalesce(home_id, 0) as team_id, case when away_id = coalesce(home_id, 0) then (away_id + 1) % 25 else away_id end as opponent_id,
       'home' as home_away, home_score as team_score, away_score as opponent_score, 1 as k, neutral_site, custkey from {schedule}
union all
select game_id, season, slate_date, case when away_id = coalesce(home_id, 0) then (away_id + 1) % 25 else away_id end, coalesce(home_id, 0),
       'away', away_score, home_score, 2, neutral_site, custkey from {schedule}"""

VIEWS["team_games"] = """
select game_id, season, slate_date, team_id, opponent_id, home_away, coalesce(neutral_site, false) as neutral_site, team_score, opponent_score,
       team_score - opponent_score as margin, team_score + opponent_score as total,
       case when neutral_site is null then 'unknown' when neutral_site then 'neutral' else 'home' end as venue_state,
       cast(floor(team_score / 2) as bigint) as team_score_h1, cast(floor(opponent_score / 2) as bigint) as opponent_score_h1,
       case when game_id % 17 = 0 then 3 else 2 end as periods, game_id % 17 = 0 as overtime,
       50 + (game_id * k) % 21 as field_goals_attempted, 18 + (game_id * 7 * k) % 15 as field_goals_made,
       15 + (game_id * k) % 11 as three_attempted, 4 + (game_id * 3 * k) % 9 as three_made,
       10 + (game_id * 5 * k) % 15 as free_throws_attempted, 6 + (game_id * 5 * k) % 10 as free_throws_made,
       5 + (game_id * 11 * k) % 10 as offensive_rebounds, 18 + (game_id * 13 * k) % 12 as defensive_rebounds,
       8 + (game_id * k) % 13 as assists, 3 + (game_id * k) % 8 as steals, 1 + (game_id * k) % 6 as blocks, 7 + (game_id * 17 * k) % 12 as turnovers,
       (50 + (game_id * k) % 21) - (5 + (game_id * 11 * k) % 10) + (7 + (game_id * 17 * k) % 12) + 0.475e0 * (10 + (game_id * 5 * k) % 15) as possessions
from {sides}"""

# One row per player and game.
VIEWS["player_games"] = """
select l_orderkey as game_id, l_linenumber as seq, cast(year(l_shipdate) as bigint) as season, cast(l_shipdate as date) as slate_date,
       l_partkey as athlete_id, 'Player ' || cast(l_partkey as string) as athlete_name, l_suppkey % 25 as team_id,
       l_returnflag = 'R' as did_not_play, l_linestatus = 'F' as starter,
       case when l_returnflag = 'R' then 0e0 else cast(l_quantity as double) * 0.8e0 end as minutes,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice) as bigint) % 31 end as points,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 10) as bigint) % 12 end as rebounds,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 100) as bigint) % 10 end as assists,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 3) as bigint) % 5 end as steals,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 7) as bigint) % 4 end as blocks,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 9) as bigint) % 6 end as turnovers,
       case when l_returnflag = 'R' then 0 else 4 + cast(floor(l_extendedprice / 11) as bigint) % 14 end as field_goals_attempted,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 13) as bigint) % 5 end as field_goals_made,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 17) as bigint) % 3 end as three_made,
       case when l_returnflag = 'R' then 0 else 2 + cast(floor(l_extendedprice / 19) as bigint) % 6 end as free_throws_attempted,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 23) as bigint) % 3 end as free_throws_made,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 29) as bigint) % 4 end as offensive_rebounds,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 31) as bigint) % 7 end as defensive_rebounds,
       case when l_returnflag = 'R' then 0 else cast(floor(l_extendedprice / 37) as bigint) % 5 end as fouls,
       (l_orderkey * 8 + l_linenumber) * 10000000 + l_suppkey * 10000 + cast(l_quantity as bigint) * 100 + cast(round(l_discount * 100) as bigint) as row_key
from {lineitem}"""

# One row per play; the event stream in order of its id.
VIEWS["plays"] = """
select user_id as game_id, event_id as play_no, cast(ts as date) as slate_date,
       user_id * 2 + event_id % 2 as team_id, user_id * 2 as home_team_id, user_id * 2 + 1 as away_team_id,
       case event_type when 'click' then 'JumpShot' when 'view' then case when event_id % 3 = 0 then 'DunkShot' else 'LayUpShot' end
            when 'purchase' then 'MadeFreeThrow' when 'signup' then 'Defensive Rebound' else 'Lost Ball Turnover' end as type_text,
       event_type in ('click', 'view') as shooting_play,
       event_type = 'purchase' or (event_type in ('click', 'view') and event_id % 5 < 2) as scoring_play,
       case event_type when 'click' then case when event_id % 7 < 3 then 3 else 2 end when 'view' then 2 when 'purchase' then 1 else 0 end as score_value,
       case when event_id % 31 = 0 then -214748340e0 else case when event_id % 2 = 0 then 1e0 else -1e0 end * (47e0 - cast(floor(value) as bigint) % 40) end as coordinate_x,
       case when event_id % 31 = 0 then -214748365e0 else cast(floor(value * 10) as bigint) % 51 - 25e0 end as coordinate_y,
       case when hour(ts) < 12 then 1 when hour(ts) < 22 then 2 else 3 end as period_number,
       event_id % 40 as athlete_id, value, ts
from {events}"""

# Probabilities with results.
VIEWS["forecasts"] = """
select d.doc_id as event_id, date '2024-01-01' + cast(d.doc_id % 60 as int) as slate_date, (n_chars % 1000) / 1000e0 as p, quality as won,
       source as market, lang as tier, toxic,
       0.3e0 + (n_chars % 400) / 1000e0 as market_implied, 0.32e0 + (n_chars % 400) / 1000e0 as market_implied_raw
from {documents} d join {labels} l on d.doc_id = l.doc_id"""

# Names to resolve: unique, ambiguous and unknown ones, in changed spelling.
VIEWS["spelled"] = """
select 'c' || cast(c_custkey as string) as row_key, upper(replace(c_name, '#', '  # ')) as spelled from {customer}
union all select 'p' || cast(p_partkey as string), '  ' || upper(p_name) || '. ' from {part}
union all select 'x' || cast(c_custkey as string), c_name || ' Annex' from {customer}"""

VIEWS["named"] = """
select c_custkey as id, c_name as name from {customer} union all select 10000000 + p_partkey, p_name from {part}"""

_TOKEN = re.compile(r"\{(\w+)\}")


class Tables:
    """The parquet tables of one folder and the views over them, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                parts = {k: getattr(self, k) for k in set(_TOKEN.findall(text))}
                self._made[name] = self.spark.sql(text, **parts)
        return self._made[name]


def _add(name: str, found: list[str]) -> None:
    """Append a view after the views it is built from."""
    if name in VIEWS and name not in found:
        for inner in _TOKEN.findall(VIEWS[name]):
            _add(inner, found)
        found.append(name)


def with_views(sql: str) -> str:
    """Put the definitions of the views a statement uses in front of it."""
    names: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            _add(name, names)
    if not names:
        return sql
    ctes = ", ".join(f"{n} as ({_TOKEN.sub(lambda m: m.group(1), VIEWS[n])})" for n in names)
    return f"with {ctes} {sql}"
