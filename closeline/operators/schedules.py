"""Schedules: game and venue states, tiers, fixtures, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from closeline.functions import text as T
from closeline.operators import segments as G

# Status words, exhibition markers, tier margins.
STATUS_STATES = {
    "STATUS_FINAL": "countable", "STATUS_SCHEDULED": "scheduled", "STATUS_POSTPONED": "postponed",
    "STATUS_CANCELED": "cancelled", "STATUS_CANCELLED": "cancelled",
}
EXHIBITION = "exhibition|scrimmage"
TIERS = ("high_major", "mid_major", "low_major", "unplaced")
HIGH_MARGIN, MID_MARGIN, MINIMUM_GAMES = 8.0, -3.0, 8


def division_ids(schedule: DataFrame) -> DataFrame:
    """Teams that carry a conference."""
    side = lambda s: schedule.filter(F.col(f"{s}_conference_id").isNotNull()).select(F.col(f"{s}_id").alias("team_id"))
    return side("home").unionByName(side("away")).filter("team_id is not null").distinct()


def _flag(frame: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    marked = ids.select(F.col("team_id").alias(column), F.lit(True).alias(flag))
    return frame.join(marked, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def usual_venues(schedule: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Modal venue, city and state of each team's home games; lowest value on ties."""
    at_home = schedule.filter(~F.coalesce(F.col("neutral_site"), F.lit(True)))
    return at_home.filter("home_id is not null").groupBy(*by, F.col("home_id").alias("team_id")).agg(
        *[F.mode(c, True).alias(f"usual_{c}") for c in ("venue_id", "venue_city", "venue_state_code")])


def _with_usual(frame: DataFrame, venues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds each side's usual venue as a struct."""
    for side in ("home", "away"):
        usual = venues.select(*by, F.col("team_id").alias(f"{side}_id"), F.struct("usual_venue_id", "usual_venue_city", "usual_venue_state_code").alias(f"__{side}"))
        frame = frame.join(usual, [*by, f"{side}_id"], "left")
    return frame


def _near(side: str) -> Column:
    """Whether a side plays in its usual venue or city."""
    return F.coalesce(F.col(f"__{side}.usual_venue_id") == F.col("venue_id"), F.lit(False)) | F.coalesce(
        (F.col(f"__{side}.usual_venue_city") == F.col("venue_city")) & F.col(f"__{side}.usual_venue_state_code").eqNullSafe(F.col("venue_state_code")), F.lit(False))


def _venue_state() -> Column:
    return (
        F.when(F.col("neutral_site").isNull(), "unknown").when(~F.col("neutral_site"), "home")
        .when(F.col("venue_id").isNull() & F.col("venue_city").isNull(), "unknown")
        .when(_near("home") | _near("away"), "quasi_neutral").otherwise("neutral")
    )


def classify(schedule: DataFrame, ids: DataFrame | None = None, venues: DataFrame | None = None) -> DataFrame:
    """Add ``game_state`` and ``venue_state``."""
    ids = division_ids(schedule) if ids is None else ids
    venues = usual_venues(schedule) if venues is None else venues
    work = _with_usual(_flag(_flag(schedule, ids, "home_id", "__hd"), ids, "away_id", "__ad"), venues)
    table = F.create_map(*[F.lit(x) for kv in STATUS_STATES.items() for x in kv])
    state = (
        F.when(F.lower(F.coalesce("headline", F.lit(""))).rlike(EXHIBITION), "exhibition")
        .when(F.col("home_id").isNull() | F.col("away_id").isNull(), "unknown")
        .when(~F.col("__hd") | ~F.col("__ad"), "non_di_opponent")
        .otherwise(F.coalesce(F.try_element_at(table, F.col("status_name")), F.lit("unknown")))
    )
    return work.select(*schedule.columns, state.alias("game_state"), _venue_state().alias("venue_state"))


def local_sides(schedule: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """Which team of each game is at home in its place, with the reason where none is.

    A host is at home. On neutral ground the label says nothing: the side whose usual
    venue or city it is (of the games of its season) is local, if it is the only one; in
    the city of both nobody is. Columns: game_id, venue_state, venue_id, local_team_id,
    local_side.
    """
    work = _with_usual(schedule, usual_venues(schedule, by), by)
    state, home, away = _venue_state(), _near("home"), _near("away")
    at_home, quasi = state == "home", state == "quasi_neutral"
    local = F.when(at_home | (quasi & home & ~away), F.col("home_id")).when(quasi & away & ~home, F.col("away_id"))
    side = (F.when(at_home & F.col("home_id").isNull(), "host unknown").when(at_home, "host").when(quasi & home & away, "both local")
            .when(quasi & home, "home side local").when(quasi, "away side local").when(state == "unknown", "venue unknown").otherwise("nobody local"))
    return work.select("game_id", state.alias("venue_state"), "venue_id", local.alias("local_team_id"), side.alias("local_side"))


def state_counts(classified: DataFrame) -> DataFrame:
    """Games per state pair beside the total they must sum to."""
    counts = classified.groupBy("game_state", "venue_state").agg(F.count("*").alias("games"))
    return counts.crossJoin(F.broadcast(classified.agg(F.count("*").alias("total"))))


def fittable(classified: DataFrame) -> DataFrame:
    return classified.filter((F.col("game_state") == "countable") & (F.col("venue_state") != "unknown"))


def cardable(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("game_state").isin("countable", "scheduled") & (F.col("venue_state") != "unknown"))


def played(schedule: DataFrame) -> DataFrame:
    """Games with a truthy completed flag, or a completed status where there is no flag."""
    if "completed" in schedule.columns:
        return schedule.filter(F.lower(F.trim(F.col("completed").cast("string"))) == "true")
    return schedule.filter(F.col("status_name") == "STATUS_FINAL")


def both_sides(schedule: DataFrame) -> DataFrame:
    """Two rows per game, one from each side."""
    side = lambda a, b: F.struct(
        F.lit(a).alias("home_away"), F.col(f"{a}_id").alias("team_id"), F.col(f"{b}_id").alias("opponent_id"), F.col(f"{a}_conference_id").alias("conference_id"),
        F.col(f"{b}_conference_id").alias("opponent_conference_id"), F.col(f"{a}_score").alias("points_for"), F.col(f"{b}_score").alias("points_against"))
    return schedule.select("game_id", "season", "slate_date", F.inline(F.array(side("home", "away"), side("away", "home"))))


def _tier(margin: Column) -> Column:
    return F.when(margin >= HIGH_MARGIN, TIERS[0]).when(margin >= MID_MARGIN, TIERS[1]).otherwise(TIERS[2])


def tier_table(schedule: DataFrame) -> DataFrame:
    """Tier of each team from the median of team margins in its conference.

    Only played games between conferences and inside the division count, both teams known. A conference
    has as many values as teams, so its median is small.
    """
    done = played(schedule)
    long = both_sides(done).filter("team_id is not null and opponent_id is not null and conference_id is not null and opponent_conference_id is not null and points_for is not null and points_against is not null")
    long = long.filter(F.col("conference_id") != F.col("opponent_conference_id"))
    # Both sides of such a row carry a conference, so both are division teams.
    per_team = long.groupBy("team_id").agg(F.count("*").alias("games"), F.avg(F.col("points_for") - F.col("points_against")).alias("margin"), F.max("conference_id").alias("conference_id"))
    members = long.select("team_id", "conference_id").distinct().join(per_team.select("team_id", "margin"), "team_id")
    conference = members.groupBy("conference_id").agg(F.percentile("margin", F.lit(0.5)).alias("conference_margin"))
    placed = per_team.join(conference, "conference_id", "left")
    tier = F.when(F.col("games") < MINIMUM_GAMES, TIERS[3]).otherwise(_tier(F.coalesce("conference_margin", "margin")))
    return placed.select("team_id", "conference_id", "games", "margin", "conference_margin", tier.alias("tier"))


def game_tier(home: Column | str, away: Column | str) -> Column:
    """The weaker of the known tiers."""
    rank = lambda c: F.when(c == TIERS[0], 0).when(c == TIERS[1], 1).when(c == TIERS[2], 2)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    worst = F.greatest(rank(as_col(home)), rank(as_col(away)))
    return F.when(worst == 0, TIERS[0]).when(worst == 1, TIERS[1]).when(worst == 2, TIERS[2]).otherwise(TIERS[3])


def division_only(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with both teams in the set."""
    mark = lambda c: ids.select(F.col("team_id").alias(c))
    return frame.join(mark("team_id"), "team_id", "left_semi").join(mark("opponent_id"), "opponent_id", "left_semi")


def pair_key(day: str, a: str, b: str) -> list[Column]:
    return [F.col(day).alias("__day"), F.least(a, b).alias("__low"), F.greatest(a, b).alias("__high")]


def resolve_fixtures(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """Events (day, home_id, away_id; ids may be null) to game ids.

    First the unordered pair of the day, if one game has it; then, with one side
    unknown, the game of the known side if it plays only once that day. Adds
    ``game_id``, ``flipped`` and ``how``.
    """
    games = schedule.filter("home_id is not null and away_id is not null").select("game_id", F.col("slate_date").alias("__day"), "home_id", "away_id")
    one = lambda g: g.agg(F.min(F.struct("game_id", F.col("home_id").alias("h"))).alias("g"), F.count("*").alias("n")).filter("n = 1").drop("n")
    pairs = one(games.groupBy("__day", F.least("home_id", "away_id").alias("__low"), F.greatest("home_id", "away_id").alias("__high")))
    per_team = one(games.select("game_id", "__day", "home_id", F.explode(F.array("home_id", "away_id")).alias("__team")).groupBy("__day", "__team"))
    work = events.select("*", *pair_key("slate_date", "home_id", "away_id"))
    both = F.col("home_id").isNotNull() & F.col("away_id").isNotNull()
    work = work.withColumn("__team", F.when(~both, F.coalesce("home_id", "away_id")))
    work = work.withColumn("__low", F.when(both, F.col("__low"))).withColumn("__high", F.when(both, F.col("__high")))
    work = work.join(pairs.withColumnRenamed("g", "__p"), ["__day", "__low", "__high"], "left").join(per_team.withColumnRenamed("g", "__s"), ["__day", "__team"], "left")
    found = F.coalesce("__p", "__s")
    flipped = F.when(F.col("home_id").isNotNull(), found["h"] != F.col("home_id")).otherwise(found["h"] == F.col("away_id"))
    how = F.when(F.col("__p").isNotNull(), "pair").when(F.col("__s").isNotNull(), "one side").otherwise("unresolved")
    return work.select(*events.columns, found["game_id"].alias("game_id"), F.when(found.isNotNull(), flipped).alias("flipped"), how.alias("how"))


def lined_games(lines: DataFrame, schedule: DataFrame, key: str = "event_id") -> DataFrame:
    """Closing lines on their games, signs turned when the sides differ."""
    placed = resolve_fixtures(lines, schedule).filter("game_id is not null")
    sign = F.when(F.col("flipped"), -1.0).otherwise(1.0)
    games = schedule.select("game_id", F.col("home_id").alias("game_home_id"), F.col("away_id").alias("game_away_id"))
    return placed.join(games, "game_id").select(
        key, "game_id", "slate_date", "game_home_id", "game_away_id", (-sign * F.col("close_spread")).alias("market_margin"), F.col("close_total").alias("market_total"), "flipped")


def unique_fill(frame: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Fill a missing id when the key has exactly one known candidate."""
    known = frame.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    one = known.filter("__lo = __hi").select(*keys, F.col("__lo").alias("__fill"))
    return frame.join(one, list(keys), "left").withColumn(column, F.coalesce(column, "__fill")).drop("__fill")


def missing_days(archive: DataFrame, schedule: DataFrame) -> DataFrame:
    """Schedule days strictly inside the archive's range that it does not hold."""
    ends = archive.agg(F.min("slate_date").alias("a"), F.max("slate_date").alias("b"))
    days = schedule.select("slate_date").distinct().crossJoin(F.broadcast(ends)).filter("slate_date > a and slate_date < b").select("slate_date")
    return days.join(archive.select("slate_date").distinct(), "slate_date", "left_anti")


def placement(board: DataFrame, schedule: DataFrame) -> DataFrame:
    """Games of the schedule and priced events, matched or listed alone."""
    events = board.select("slate_date", "home_id", "away_id").distinct()
    games = schedule.select("game_id", "slate_date", "home_id", "away_id")
    joined = games.join(events.withColumn("__priced", F.lit(True)), ["slate_date", "home_id", "away_id"], "full_outer")
    state = F.when(F.col("game_id").isNull(), "event without game").when(F.col("__priced").isNull(), "game without price").otherwise("placed")
    return joined.withColumn("placement", state).drop("__priced")


def expected_runs(runs: DataFrame, crons: DataFrame, job: str = "job") -> DataFrame:
    """Each expected instant and the run that claims it: a run takes the latest
    expected instant of its day at or before it, the earliest such run keeps the claim.

    The as-of scan is cut by the minute, so a day of a busy job is many segments.
    """
    keys = [job, "slot_day"]
    found = G.as_of(runs.select(*keys, "at", F.col("run_id").cast("long").alias("run_id")), crons.select(*keys, "at").distinct(), keys, "at", [], [F.date_trunc("minute", "at")], right_at="expected")
    claimed = found.filter("expected is not null").groupBy(*keys, "expected").agg(F.min_by(F.struct("run_id", "at"), F.struct("at", "run_id")).alias("r"))
    out = crons.select(*keys, F.col("at").alias("expected")).distinct().join(claimed, [*keys, "expected"], "left")
    return out.select(*keys, "expected", F.col("r.run_id").alias("run_id"),
                      ((F.unix_micros(F.col("r.at").cast("timestamp")) - F.unix_micros(F.col("expected").cast("timestamp"))) / 6e7).alias("minutes_late"))


def day_shape(schedule: DataFrame) -> DataFrame:
    days = schedule.groupBy("slate_date").agg(F.count("*").alias("games"))
    return days.agg(F.count("*").alias("days"), F.min("games").alias("low"), F.percentile("games", F.lit(0.5)).alias("median"),
                    F.percentile("games", F.lit(0.9)).alias("p90"), F.max("games").alias("high"), F.avg("games").alias("mean"))
