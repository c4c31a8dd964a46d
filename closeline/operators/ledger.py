"""Accounting: identities that must reconcile, censuses, verdicts over seasons."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from closeline.functions import prices as P, text as T
from closeline.operators import intervals as I

# Declared criteria.
PROMOTION_BETS, PROMOTION_POINTS = 2000, 1.5
DEMOTION_BETS, DEMOTION_FLOOR = 500, -0.02
FLOOR_OPINIONS, FLOOR_GAMES = 10_000, 2_000
PLAUSIBLE_EDGE = 0.05
_LOOK_PLACES = 60
KEY_COVERAGE, CONVENTION_RATE, SIDE_BIAS = 0.5, 0.99, 0.75


def measurable(frame: DataFrame, refused_markets: Sequence[str] = ()) -> DataFrame:
    """Won, lost or pushed rows with a numeric profit, declared markets left out."""
    rows = frame.filter(F.lower(F.trim("outcome")).isin("won", "lost", "push") & P.number("profit_units").isNotNull())
    return without_markets(rows, refused_markets)


def without_markets(frame: DataFrame, markets: Sequence[str]) -> DataFrame:
    return frame.filter(~F.col("market").isin(*markets)) if markets else frame


def closed_cells(frame: DataFrame, gate: DataFrame) -> DataFrame:
    """Drop opinions in (tier, market) cells a gate closed."""
    return frame.join(gate.select("tier", "market"), ["tier", "market"], "left_anti")


def assert_walk_forward(frame: DataFrame, day: str = "slate_date", through: str = "priced_through") -> DataFrame:
    """Fail the job on any row priced with knowledge of its own day or later."""
    ok = F.coalesce(F.col(through) < F.col(day), F.col(through).isNull())
    return frame.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("a row was priced through its own day"))))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one result missing in the other, by multiset difference both ways."""
    same = right.select(*left.columns)
    return left.exceptAll(same).withColumn("only_in", F.lit("left")).unionByName(same.exceptAll(left).withColumn("only_in", F.lit("right")))


def counts_by(frame: DataFrame, bucket: str, *by: str) -> DataFrame:
    """Rows per bucket beside the total, so that a dropped row shows."""
    counts = frame.groupBy(*by, bucket).agg(F.count("*").alias("n"))
    total = frame.groupBy(*by).agg(F.count("*").alias("total"))
    return counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))


def accounting_bucket() -> Column:
    """The one bucket of the accounting identity a priced row lands in."""
    return (
        F.when(P.payout("american_odds").isNull(), "unparseable")
        .when(F.col("ambiguous"), "ambiguous")
        .when(F.col("gated"), "gated")
        .when(F.col("model_probability").isNull(), "no_opinion")
        .when(F.col("edge") < P.EDGE_THRESHOLD, "below_threshold")
        .otherwise("bet")
    )


def wager_census(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quotes, raw and folded distinct wagers per market, and spelling collisions."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    folded = T.normalise_subject("player")
    raw_key = F.struct(*[text(k) for k in keys])
    fold_key = F.struct(*[folded if k == "player" else text(k) for k in keys])
    # One row per raw wager first; the distinct counts then run over those.
    per = frame.groupBy("market", raw_key.alias("raw"), fold_key.alias("folded")).agg(F.count("*").alias("n"))
    per_fold = per.groupBy("market", "folded").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))
    return per_fold.groupBy("market").agg(
        F.sum("n").alias("quotes"), F.sum("spellings").alias("wagers_raw"), F.count("*").alias("wagers_folded"),
        F.count_if(F.col("spellings") > 1).alias("collisions"))


def spellings(frame: DataFrame, column: str = "player") -> DataFrame:
    """Distinct raw spellings per folded name."""
    pairs = frame.select(T.normalise_subject(column).alias("folded"), F.col(column).alias("raw")).filter("folded <> ''").distinct()
    return pairs.groupBy("folded").agg(F.count("*").alias("spellings"), F.array_sort(F.collect_list("raw")).alias("forms"))


def reconcile(offered: DataFrame, accounted: DataFrame, key: str = "market") -> DataFrame:
    """Offered against accounted wagers per market; the residual must be zero."""
    out = offered.join(accounted, key, "full_outer").na.fill(0, ["offered", "accounted"])
    return out.withColumn("residual", F.col("offered") - F.col("accounted"))


def retention(asked: DataFrame, seen: DataFrame, keys: DataFrame) -> DataFrame:
    """Per market: events fully asked, priced, absent, incomplete.

    ``asked`` (event_id, tier, provider_key), ``seen`` (event_id, provider_key, rows,
    books), ``keys`` (market, provider_key) of the fixed registry.
    """
    need = keys.groupBy("market").agg(F.count("*").alias("need"))
    per = asked.join(F.broadcast(keys), "provider_key").join(seen, ["event_id", "provider_key"], "left")
    event = per.groupBy("market", "event_id").agg(
        F.max("tier").alias("tier"), F.countDistinct("provider_key").alias("answered"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    event = event.join(F.broadcast(need), "market").withColumn("complete", F.col("answered") == F.col("need")).withColumn("priced", F.col("rows") > 0)
    return event.groupBy("market").agg(
        F.count_if("complete").alias("fully_asked"), F.count_if("priced").alias("priced"), F.count_if(F.col("complete") & ~F.col("priced")).alias("absent"),
        F.count_if(~F.col("complete") & ~F.col("priced")).alias("incomplete"), F.sum("rows").alias("rows"),
        *[F.count_if(F.col("complete") & (F.col("tier") == t)).alias(f"asked_{t}") for t in ("high_major", "mid_major", "low_major")])


def sample_balance(sample: DataFrame, population: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Share of each axis value in the sample against the population."""
    long = lambda d: d.select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])))
    count = lambda d, n: long(d).groupBy("axis", "value").agg(F.count("*").alias(n))
    totals = sample.agg(F.count("*").alias("ts")).crossJoin(F.broadcast(population.agg(F.count("*").alias("tp"))))
    out = count(population, "population").join(count(sample, "bought"), ["axis", "value"], "full_outer").na.fill(0, ["population", "bought"]).crossJoin(F.broadcast(totals))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select("axis", "value", "population", "bought", F.round(share("population", "tp"), 4).alias("population_share"), F.round(share("bought", "ts"), 4).alias("bought_share"),
                      F.round(share("bought", "ts") - share("population", "tp"), 4).alias("difference"))


def looks_summary(ledger: DataFrame, key: Sequence[str] = ("search", "name")) -> DataFrame:
    """Distinct hypotheses by search, by week and in all, from one rollup."""
    first = ledger.groupBy(*key).agg(F.min("week").alias("week"))
    sets = F.explode(F.array(F.struct(F.lit("all").alias("axis"), F.lit("").alias("value")), F.struct(F.lit("search").alias("axis"), F.col("search").cast("string").alias("value")),
                             F.struct(F.lit("week").alias("axis"), F.col("week").cast("string").alias("value"))))
    return first.select(sets.alias("a")).groupBy("a.axis", "a.value").agg(F.count("*").alias("looks"))


def correction_factor(looks: int) -> float:
    """How much wider the interval gets at this many looks."""
    return 1.0 if looks <= 1 else NormalDist().inv_cdf(1.0 - 0.025 / looks) / I.Z95


def restated(cells: DataFrame, looks: int) -> DataFrame:
    """Adjusted bounds of stored cells at a new look count."""
    return I.bounds(cells.select([c for c in cells.columns if c not in ("low", "high", "adjusted_low", "adjusted_high", "verdict")]), looks)


def season_record(picks: DataFrame) -> DataFrame:
    """Wins, losses, pushes and units by night and for the season, in one rollup."""
    out = picks.rollup("season", "slate_date").agg(
        F.count_if(F.col("outcome") == "won").alias("wins"), F.count_if(F.col("outcome") == "lost").alias("losses"), F.count_if(F.col("outcome") == "push").alias("pushes"),
        F.sum(F.col("profit_units") * F.col("stake")).alias("units"), F.sum(F.when(F.col("outcome").isin("won", "lost"), F.col("stake")).otherwise(0.0)).alias("staked"))
    return out.filter("season is not null")


def pick_record(picks: DataFrame) -> DataFrame:
    """Counts by category and outcome, with the mean closing value."""
    return picks.groupBy("category", "outcome").agg(F.count("*").alias("n"), F.avg("clv").alias("mean_clv"), F.count("clv").alias("graded"))


def earliest_wins(cards: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per identity by date, slot and source."""
    fields = [c for c in cards.columns if c not in keys]
    return cards.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("r")).select(*keys, "r.*")


def replication(claims: DataFrame, holdout: DataFrame, minimum_bets: int = PROMOTION_BETS) -> DataFrame:
    """Discovery cells against held-out cells of each season: six states.

    Both tables carry market, tier, roi, bets, adjusted_low, adjusted_high, verdict;
    the held-out one also season.
    """
    seasons = holdout.select("season").distinct()
    a = claims.select("market", "tier", F.signum("roi").alias("sign"), F.col("verdict").isin("demonstrated edge", "demonstrated deficit").alias("claims")).crossJoin(F.broadcast(seasons))
    b = holdout.select("season", "market", "tier", F.col("bets").alias("held_bets"), F.signum("roi").alias("held_sign"), F.col("verdict").isin("demonstrated edge", "demonstrated deficit").alias("clear"))
    joined = a.join(b, ["season", "market", "tier"], "left")
    state = (
        F.when(F.coalesce("held_bets", F.lit(0)) <= 0, "untestable")
        .when(F.col("held_bets") < minimum_bets, "not enough evidence")
        .when(~F.col("claims"), "nothing to replicate")
        .when(~F.col("clear"), "did not replicate")
        .when(F.col("held_sign") != F.col("sign"), "reversed")
        .otherwise("replicated")
    )
    return joined.select("season", "market", "tier", F.coalesce("held_bets", F.lit(0)).alias("held_bets"), state.alias("state"))


FAILURES = ("reversed", "did not replicate", "not enough evidence", "untestable")


def combined_state(states: DataFrame) -> DataFrame:
    """One state per cell over its seasons: all replicated, else the first failure."""
    has = lambda s: F.bool_or(F.col("state") == s)
    out = F.when(F.bool_and(F.col("state") == "replicated"), "replicated").when(has("nothing to replicate"), "nothing to replicate")
    for s in FAILURES:
        out = out.when(has(s), s)
    return states.groupBy("market", "tier").agg(out.otherwise("untestable").alias("state"), F.count("*").alias("seasons"))


def promotion(results: DataFrame, by: Sequence[str], factor: float = 1.0, minimum_bets: int = PROMOTION_BETS) -> DataFrame:
    """Season results (bets, margin_points, low, high) against the declared criteria."""
    centre, half = (F.col("high") + F.col("low")) / 2.0, (F.col("high") - F.col("low")) / 2.0 * factor
    spans = (centre - half <= 0) & (centre + half >= 0)
    out = results.groupBy(*by).agg(
        F.count("*").alias("seasons"), F.count_if(F.col("bets") < minimum_bets).alias("thin"),
        F.count_if(F.col("margin_points") < PROMOTION_POINTS).alias("short"), F.count_if(spans).alias("spanning"))
    return out.withColumn("promoted", (F.col("thin") == 0) & (F.col("short") == 0) & (F.col("spanning") == 0))


def demotion(cells: DataFrame, declarations: DataFrame) -> DataFrame:
    """Approved markets against their own floor: withdraw only when the whole interval
    is below it."""
    joined = declarations.join(cells, "market", "left").na.fill(0, ["bets"])
    floor, need = F.col("roi_floor"), F.greatest("minimum_bets", F.lit(DEMOTION_BETS))
    state = (F.when(F.col("bets") < need, "not enough evidence").when(F.col("high") < floor, "withdraw")
             .when(F.col("roi") < floor, "below floor, interval reaches it").otherwise("above floor"))
    return joined.withColumn("finding", state)


def search_budget(tests: DataFrame, supply: DataFrame, edge: float = PLAUSIBLE_EDGE, floor: int = FLOOR_OPINIONS) -> DataFrame:
    """Whether a market's search has spent so much that an edge worth having could not clear it.

    ``tests`` (market, looks) says how often each market was looked at, ``supply`` (market,
    supply) how many bets a season brings. A correction for the looks widens the interval by
    a factor, and the bets that show the edge grow by its square; more than the supply is
    exhausted. ``bites_at`` is the number of looks at which that happens first (of the
    supply, and of the least sample that counts at all). Bets are taken as independent, so
    the need is a lower bound.
    """
    needed_once = math.ceil((I.Z95 / edge) ** 2)
    factor = lambda looks: F.when(looks <= 1, 1.0).otherwise(P.upper_quantile(F.lit(0.025) / looks) / I.Z95)
    needed = lambda looks: F.ceil(needed_once * F.pow(factor(looks), 2))

    def bites(limit: Column) -> Column:
        # The most looks that still fit, one binary place after the other.
        places = F.array(*[F.lit(1 << b).cast("long") for b in range(_LOOK_PLACES - 1, -1, -1)])
        most = F.aggregate(places, F.lit(0).cast("long"), lambda held, more: F.when(needed((held + more).cast("double")) <= limit, held + more).otherwise(held))
        return F.greatest(most + 1, F.lit(2))

    looks = F.greatest(F.coalesce("looks", F.lit(0)), F.lit(1))
    rows = tests.join(supply, "market", "full_outer").select("market", looks.cast("long").alias("looks"), F.coalesce("supply", F.lit(0)).cast("long").alias("supply"))
    many = F.col("looks").cast("double")
    return rows.select(
        "market", "looks", "supply", factor(many).alias("correction_factor"), F.lit(needed_once).cast("long").alias("needed_uncorrected"), needed(many).alias("needed"),
        (needed(many) > F.col("supply")).alias("exhausted"), (needed(many) > floor).alias("exhausted_at_floor"), bites(F.col("supply")).alias("bites_at"), bites(F.lit(floor)).alias("bites_at_floor"))


def decision(cells: DataFrame, opinions: int = FLOOR_OPINIONS, games: int = FLOOR_GAMES) -> DataFrame:
    """Ordered verdict from floors, interval and the surviving return."""
    out = (
        F.when((F.col("opinions") < opinions) | (F.col("games") < games), "did not run")
        .when(F.col("adjusted_high") < 0, "stop: loses")
        .when(F.col("adjusted_low") <= 0, "stop: no edge")
        .when(F.col("survived_roi") <= 0, "not reachable")
        .otherwise("candidate")
    )
    return cells.withColumn("decision", out)


def claim_rows(backtest: DataFrame, forward: DataFrame) -> DataFrame:
    """Result cells of two tests as one claim table."""
    keep = ["market", "tier", "roi", "bets", "adjusted_low", "adjusted_high", "verdict"]
    part = lambda d, n: d.select(F.lit(n).alias("test"), *keep)
    both = part(backtest, "backtest").unionByName(part(forward, "forward"))
    claim = F.when(F.col("verdict") == "demonstrated edge", "edge").when(F.col("verdict") == "demonstrated deficit", "deficit").otherwise("none")
    return both.withColumn("claim", claim)


def baseline_side() -> Column:
    s = F.col("selection")
    return F.when(s.isin("home", "away", "over", "under"), s).when(s.contains("_"), F.split_part(s, F.lit("_"), F.lit(2))).otherwise("")


def null_baseline(universe: DataFrame, looks: int = 1) -> DataFrame:
    """Return of always taking one side, the favourite or the underdog, per cell.

    Favourite and underdog come from groups of exactly two quotes: counts and the
    lowest payout are one aggregate, joined back to its rows.
    """
    rows = universe.filter(P.number("profit_units").isNotNull()).withColumn("__pay", P.payout("american_odds"))
    keys = ["market", "tier", "event_id", "segment", "player", "line"]
    pairs = rows.filter("__pay is not null").groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__pay").alias("__low")).filter("__n = 2")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    two = rows.alias("a").join(pairs.alias("b"), on).select("a.*", "b.__low")
    fav = two.withColumn("side", F.when(F.col("__pay") == F.col("__low"), "favourite").otherwise("underdog")).drop("__low")
    sides = rows.withColumn("side", baseline_side()).filter("side <> ''")
    both = sides.unionByName(fav)
    return I.interval(both, [["market", "tier", "side"]], {"game": "event_id", "day": "slate_date"}, "profit_units", looks)


def side_concentration(bets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most common side and its share; first by name on ties."""
    counts = bets.withColumn("side", baseline_side()).filter("side <> ''").groupBy(*by, "side").agg(F.count("*").alias("n"))
    out = counts.groupBy(*by).agg(F.min_by("side", F.struct(-F.col("n"), F.col("side"))).alias("side"), (F.max("n") / F.sum("n")).alias("share"))
    return out.withColumn("biased", F.col("share") >= SIDE_BIAS)


def key_numbers(frame: DataFrame, value: str, coverage: float = KEY_COVERAGE) -> DataFrame:
    """Most frequent absolute rounded values until they cover the share."""
    counts = frame.filter(F.col(value).isNotNull()).groupBy(F.abs(F.bround(value, 0)).cast("long").alias("number")).agg(F.count("*").alias("games"))
    # One row per distinct margin: a small, fixed range of numbers.
    order = W.orderBy(F.col("games").desc(), "number")
    total = counts.withColumn("__all", F.sum("games").over(W.partitionBy()))
    cum = total.withColumn("__before", F.coalesce(F.sum("games").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = cum.filter(F.col("__before") < coverage * F.col("__all"))
    return kept.select("number", "games", (F.col("games") / F.col("__all")).alias("share"), ((F.col("__before") + F.col("games")) / F.col("__all")).alias("covered"))


def ticket_margin() -> Column:
    """Points by which a ticket won or lost, from the settled number and the line."""
    actual, line, side = P.number("actual"), F.coalesce(P.number("line"), F.lit(0.0)), baseline_side()
    return (F.when(F.col("selection") == "home", actual + line).when(F.col("selection") == "away", line - actual)
            .when(side == "over", actual - line).when(side == "under", line - actual))


def convention_check(bets: DataFrame) -> DataFrame:
    m = ticket_margin()
    rows = bets.filter(m.isNotNull() & F.col("outcome").isin("won", "lost"))
    out = rows.agg(F.count("*").alias("checked"), F.count_if((m > 0) == (F.col("outcome") == "won")).alias("agreed"))
    out = out.withColumn("rate", F.coalesce(F.try_divide(F.col("agreed"), F.col("checked")), F.lit(0.0)))
    return out.withColumn("verified", (F.col("rate") >= CONVENTION_RATE) & (F.col("checked") > 0))


def half_points(bets: DataFrame, numbers: DataFrame, looks: int = 1) -> DataFrame:
    """Return of bets decided by half a point, of those at a key number, and the rest;
    nothing when the margin convention does not hold."""
    keys = numbers.select(F.col("number").alias("__key"), F.lit(True).alias("__is_key"))
    rows = bets.withColumn("__key", F.abs(F.bround(P.number("line"), 0)).cast("long")).join(F.broadcast(keys), "__key", "left")
    close = F.abs(ticket_margin()) <= 0.5
    part = F.array_compact(F.array(F.when(close, F.lit("half point")), F.when(close & F.col("__is_key"), F.lit("half point at a key number")), F.when(~close, F.lit("view of the game"))))
    tagged = rows.withColumn("part", F.explode(part))
    ok = convention_check(bets).filter("verified").select("verified")
    return I.interval(tagged, [["part"]], {"game": "event_id", "day": "slate_date"}, "profit_units", looks).crossJoin(F.broadcast(ok))


def _shuffled(ident: str, seed: int) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))


def stratified_sample(frame: DataFrame, strata: Sequence[str], ident: str, n: int, seed: int = 7) -> DataFrame:
    """n rows per stratum in a seeded hash order; a top-n cut before the shuffle."""
    order = _shuffled(ident, seed)
    w = W.partitionBy(*strata).orderBy(order, F.col(ident))
    return frame.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def stratified_order(frame: DataFrame, strata: Sequence[str], ident: str, seed: int = 7) -> DataFrame:
    """Proportional interleave of strata: (rank - 1/2) / size, by a seeded order.

    Ranks come from segmented running counts over ranges of the hash, so one large
    stratum spreads over many tasks.
    """
    from closeline.operators import segments as G

    hashed = frame.withColumn("__h", _shuffled(ident, seed))
    ranked = G.running_before(hashed, list(strata), ["__h", ident], {"__r": F.lit(1)}, [F.substring("__h", 1, 2)])
    sizes = frame.groupBy(*strata).agg(F.count("*").alias("__size"))
    return ranked.join(sizes, list(strata)).withColumn("position", (F.col("__r") + 0.5) / F.col("__size")).drop("__h", "__r", "__size")


def unresolved_top(frame: DataFrame, name: str, n: int = 40) -> DataFrame:
    return frame.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), name).limit(n)


def hold_days(frame: DataFrame, frozen: str, settled: str) -> DataFrame:
    return frame.withColumn("hold_days", F.datediff(settled, frozen))
