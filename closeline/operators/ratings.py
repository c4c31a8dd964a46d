"""Team ratings: ridge fits on pair sums, simple ratings, graph, projections.

Games are first summed per pair of teams. What is left is as large as the number of
pairs that met, not the number of games: for a declared number of teams it is solved
with one small linear system, beyond that by conjugate gradients whose products are a
join and an aggregate over the pair table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from closeline import session
from closeline.functions import prices as P
from closeline.operators import history as H, intervals as I

DRIVER_TEAMS = 500
MINIMUM_POSSESSIONS, REGULATION = 40.0, 2
TIER_EFFECT_SHRINK, VENUE_RIDGE = 50.0, 1.0
VENUE_TIERS = ("high_major", "mid_major", "low_major", "unplaced")
# Names of the venue effects, in the order of their columns.
VENUE_COLUMNS = ("league offence", "league defence", *[f"{t} offence" for t in VENUE_TIERS], *[f"{t} defence" for t in VENUE_TIERS], "quasi offence", "quasi defence")


def _prepared(classified: DataFrame, local: DataFrame | None) -> DataFrame:
    """Rows with ``game_possessions``, the team at home in the place, and ``left_out`` with the first reason that applies."""
    rows = H.with_opponent(classified, ["possessions"])
    home = F.col("home_away") == "home"
    local_id = F.when(F.col("venue_state") == "home", F.when(home, F.col("team_id")).otherwise(F.col("opponent_id")))
    if local is not None:
        rows = rows.join(local.select("game_id", F.col("local_team_id").alias("__local")), "game_id", "left")
        local_id = F.when(F.col("venue_state") == "quasi_neutral", F.col("__local")).otherwise(local_id)
    countable = F.coalesce(F.col("game_state") == "countable", F.lit(False)) if "game_state" in classified.columns else F.lit(True)
    poss = (F.col("possessions") + F.col("possessions_opp")) / 2.0
    reason = (F.when(~countable, "not countable").when(F.col("venue_state") == "unknown", "venue unknown").when(F.col("periods").isNull(), "periods unknown")
              .when(F.col("periods") != REGULATION, "overtime").when(F.coalesce(poss < MINIMUM_POSSESSIONS, F.lit(True)), "too few possessions"))
    return rows.withColumns({"game_possessions": poss, "local_team_id": local_id, "left_out": reason}).drop("__local")


def prepare(classified: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Countable regulation games with enough shared possessions; adds efficiency and the local side.

    ``local`` (game_id, local_team_id: ``schedules.local_sides``) names the team at home on
    quasi-neutral ground, where the label is wrong a third of the time. Without it, and
    where it names none, such a game has no local side.
    """
    rows = _prepared(classified, local).filter("left_out is null").drop("left_out")
    is_local = lambda c: F.coalesce(F.col("local_team_id") == F.col(c), F.lit(False))
    return rows.withColumns({"efficiency": 100.0 * F.col("team_score") / F.col("game_possessions"), "is_local": is_local("team_id"), "opponent_is_local": is_local("opponent_id")})


def preparation_counts(classified: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Rows left out of the fit, each under the first reason that applies, and rows kept; of these, quasi-neutral ones without a local side apart."""
    kept = F.when((F.col("venue_state") == "quasi_neutral") & F.col("local_team_id").isNull(), "kept, local side unknown").otherwise("kept")
    return _prepared(classified, local).groupBy(F.coalesce("left_out", kept).alias("reason")).agg(F.count("*").alias("rows"))


def league_means(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return prepared.groupBy(*by).agg(F.avg("efficiency").alias("league_efficiency"), F.avg("game_possessions").alias("league_tempo"))


def pair_sums(rows: DataFrame, response: Column, by: Sequence[str] = ()) -> DataFrame:
    """Games, summed response and its squares per ordered pair of teams (map-side combined)."""
    return rows.groupBy(*by, F.col("team_id").alias("i"), F.col("opponent_id").alias("j")).agg(F.count("*").alias("n"), F.sum(response).alias("y"), F.sum(response * response).alias("yy"))


def _small(pairs: DataFrame) -> bool:
    teams = pairs.select("i").union(pairs.select("j")).distinct()
    return teams.limit(DRIVER_TEAMS + 1).count() <= DRIVER_TEAMS


def ridge(pairs: DataFrame, strength: tuple[float, float], signs: tuple[float, float] = (1.0, 1.0), shared: bool = False, priors: DataFrame | None = None, force_distributed: bool = False, tolerance: float = 1e-10) -> DataFrame:
    """Ridge of the pair response on an effect of i and an effect of j.

    ``shared`` uses one effect per team for both places (with ``signs``), otherwise an
    attack effect of i and a defence effect of j. Output: team_id, a, b (b null when
    shared), weight_a, weight_b (share of the prior), alike from either solver.
    """
    if _small(pairs) and not force_distributed:
        return _ridge_small(pairs, strength, signs, shared, priors)
    return _ridge_cg(pairs, strength, signs, shared, priors, tolerance)


def _ridge_small(pairs, strength, signs, shared, priors) -> DataFrame:
    rows = pairs.select("i", "j", "n", "y").toPandas()  # at most DRIVER_TEAMS squared
    teams = np.unique(np.concatenate([rows["i"], rows["j"]]))
    at = {int(t): k for k, t in enumerate(teams)}
    size = len(teams)
    dim = size if shared else 2 * size
    lam = np.full(dim, float(strength[0]))
    if not shared:
        lam[size:] = strength[1]
    centre = np.zeros(dim)
    if priors is not None:
        known = pairs.select(F.col("i").alias("team_id")).union(pairs.select("j")).distinct()
        for r in priors.join(known, "team_id", "left_semi").collect():  # at most DRIVER_TEAMS
            centre[at[r["team_id"]]] = r["a"]
            if not shared:
                centre[size + at[r["team_id"]]] = r["b"]
    normal, right = np.diag(lam), lam * centre
    s, t = signs
    n, y = rows["n"].to_numpy(float), rows["y"].to_numpy(float)
    p = np.searchsorted(teams, rows["i"])
    q = np.searchsorted(teams, rows["j"]) + (0 if shared else size)
    for r, c, v in ((p, p, s * s), (q, q, t * t), (p, q, s * t), (q, p, s * t)):
        np.add.at(normal, (r, c), v * n)
    np.add.at(right, p, s * y)
    np.add.at(right, q, t * y)
    theta = np.linalg.solve(normal, right)
    share = np.clip(np.linalg.solve(normal, lam), 0.0, 1.0)
    out = [(t, float(theta[k]), None if shared else float(theta[size + k]), float(share[k]), None if shared else float(share[size + k])) for t, k in at.items()]
    return pairs.sparkSession.createDataFrame(out, "team_id long, a double, b double, weight_a double, weight_b double")


def _ridge_cg(pairs, strength, signs, shared, priors, tolerance, rounds: int = 400) -> DataFrame:
    """Conjugate gradients with vectors as DataFrames (slot, team, value)."""
    s, t = signs
    pairs = session.cut_lineage(pairs.select("i", "j", "n", "y"))
    second = "a" if shared else "b"
    # Sparse normal matrix by slot and team, without the penalty.
    entries = F.array(
        F.struct(F.lit("a").alias("rs"), F.col("i").alias("r"), F.lit("a").alias("cs"), F.col("i").alias("c"), (s * s * F.col("n")).alias("v")),
        F.struct(F.lit(second).alias("rs"), F.col("j").alias("r"), F.lit(second).alias("cs"), F.col("j").alias("c"), (t * t * F.col("n")).alias("v")),
        F.struct(F.lit("a").alias("rs"), F.col("i").alias("r"), F.lit(second).alias("cs"), F.col("j").alias("c"), (s * t * F.col("n")).alias("v")),
        F.struct(F.lit(second).alias("rs"), F.col("j").alias("r"), F.lit("a").alias("cs"), F.col("i").alias("c"), (s * t * F.col("n")).alias("v")))
    matrix = session.cut_lineage(pairs.select(F.inline(entries)).groupBy("rs", "r", "cs", "c").agg(F.sum("v").alias("v")))
    rhs = pairs.select(F.inline(F.array(F.struct(F.lit("a").alias("slot"), F.col("i").alias("team"), (s * F.col("y")).alias("v")), F.struct(F.lit(second).alias("slot"), F.col("j").alias("team"), (t * F.col("y")).alias("v")))))
    rhs = rhs.groupBy("slot", "team").agg(F.sum("v").alias("b"))
    teams = rhs.select("team").distinct()
    slots = teams.select("team", F.explode(F.array(*[F.lit(x) for x in (["a"] if shared else ["a", "b"])])).alias("slot"))
    lam = F.when(F.col("slot") == "a", float(strength[0])).otherwise(float(strength[1]))
    base = slots.join(rhs, ["slot", "team"], "left").na.fill(0.0, ["b"])
    if priors is not None:
        centre = priors.select(F.col("team_id").alias("team"), F.inline(F.array(F.struct(F.lit("a").alias("slot"), F.col("a").alias("m")), F.struct(F.lit("b").alias("slot"), F.col("b").alias("m")))))
        base = base.join(centre, ["slot", "team"], "left").na.fill(0.0, ["m"])
    else:
        base = base.withColumn("m", F.lit(0.0))
    # Start at the prior mean: the residual is b - A m (the penalty terms cancel).
    state = base.select("slot", "team", F.col("m").alias("x"), lam.alias("lam"), "b")
    product = lambda v: matrix.join(v.select(F.col("slot").alias("cs"), F.col("team").alias("c"), F.col("p").alias("__p")), ["cs", "c"]).groupBy(F.col("rs").alias("slot"), F.col("r").alias("team")).agg(F.sum(F.col("v") * F.col("__p")).alias("q"))
    start = state.join(product(state.withColumn("p", F.col("x"))), ["slot", "team"], "left").na.fill(0.0, ["q"])
    effects = _solve(start.select("slot", "team", "x", "lam", (F.col("b") - F.col("q")).alias("r")), product, tolerance, rounds)
    # Shares of the prior solve the same system with the penalties on the right.
    shares = _solve(slots.select("slot", "team", F.lit(0.0).alias("x"), lam.alias("lam"), lam.alias("r")), product, tolerance, rounds)
    state = effects.join(shares.select("slot", "team", F.col("x").alias("share")), ["slot", "team"])
    at = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    share = lambda slot: F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(slot, "share")))
    none = F.lit(None).cast("double")
    return state.groupBy(F.col("team").alias("team_id")).agg(at("a", "x").alias("a"), at("b", "x").alias("b"), share("a").alias("weight_a"), (none if shared else share("b")).alias("weight_b"))


def _solve(start: DataFrame, product, tolerance: float, rounds: int) -> DataFrame:
    """Conjugate gradients from (slot, team, x, lam, r); raises if they don't converge."""
    state = session.cut_lineage(start.withColumn("p", F.col("r")))
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
    goal = tolerance * tolerance * max(rr or 0.0, 1.0)
    for _ in range(rounds):
        if not rr or rr <= goal:
            return state
        step = state.join(product(state), ["slot", "team"], "left").na.fill(0.0, ["q"]).withColumn("q", F.col("q") + F.col("lam") * F.col("p"))
        step = session.cut_lineage(step)
        alpha = rr / step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        step = step.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("q")})
        fresh = step.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = session.cut_lineage(step.withColumn("p", F.col("r") + (fresh / rr) * F.col("p")).drop("q"))
        rr = fresh
    if rr and rr > goal:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return state


def _both(pairs: DataFrame, effects: DataFrame, names: dict[str, str]) -> DataFrame:
    """Pairs with the sum of the attack effect of i and the defence effect of j, for each (a, b) of names."""
    side = lambda k, cols: effects.select(F.col("team_id").alias(k), *[F.col(c).alias(f"__{k}_{n}") for n, c in enumerate(cols)])
    met = pairs.join(side("i", names), "i").join(side("j", names.values()), "j")
    return met.select(*pairs.columns, *[(F.col(f"__i_{n}") + F.col(f"__j_{n}")).alias(f"m{n}") for n in range(len(names))])


def _spread(total: Column, square: Column, n: Column) -> Column:
    """Sample deviation from sums."""
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), square - total * total / n) / (n - 1))).otherwise(0.0)


def residual_spread(pairs: DataFrame, effects: DataFrame) -> DataFrame:
    """One row: deviation of what is left of the response, from the sums per pair alone."""
    r = _both(pairs, effects, {"a": "b"})
    m, n, y = F.col("m0"), F.col("n"), F.col("y")
    sums = r.agg(F.sum(n).alias("n"), F.sum(y - n * m).alias("t"), F.sum(F.col("yy") - 2.0 * m * y + n * m * m).alias("s"))
    return sums.select(_spread(F.col("t"), F.col("s"), F.col("n")).alias("residual_sd"))


def _placed(rows: DataFrame, effects: DataFrame, tiers: DataFrame, departures: DataFrame | None) -> DataFrame:
    """Adds the venue effects, the tier of ``local_team_id`` and the departure of ``venue_id`` (columns with two underscores)."""
    one = effects.agg(*[F.coalesce(F.max(F.when(F.col("effect") == n, F.col("value"))), F.lit(0.0)).alias(f"__{n}") for n in VENUE_COLUMNS])
    rows = rows.crossJoin(F.broadcast(one)).join(tiers.select(F.col("team_id").alias("local_team_id"), F.col("tier").alias("__tier")), "local_team_id", "left")
    if departures is None:
        return rows.withColumn("__own", F.lit(0.0))
    return rows.join(departures.select("venue_id", F.col("departure").alias("__own")), "venue_id", "left").na.fill(0.0, ["__own"])


def _venue_term(own: Column, other: Column) -> Column:
    """What the place adds to the side that is local (``own``) or meets the local side (``other``)."""
    tier = F.coalesce("__tier", F.lit(VENUE_TIERS[-1]))
    of = lambda side: F.col(f"__league {side}") + sum((F.when(tier == t, F.col(f"__{t} {side}")).otherwise(0.0) for t in VENUE_TIERS), F.lit(0.0))
    at_home, quasi = F.col("venue_state") == "home", F.col("venue_state") == "quasi_neutral"
    half = F.col("__own") / 2.0
    return (F.when(at_home & own, of("offence") + half).when(at_home & other, of("defence") - half)
            .when(quasi & own, F.col("__quasi offence")).when(quasi & other, F.col("__quasi defence")).otherwise(0.0))


def with_venue_term(prepared: DataFrame, effects: DataFrame, tiers: DataFrame, departures: DataFrame | None = None) -> DataFrame:
    """Adds ``venue_term``: what the place adds to a side's efficiency.

    ``effects`` are those of ``venue_effects``: at home the league's and the local tier's
    effect on the local side's offence, or on its opponent's (the defence effect); on
    quasi-neutral ground one pair of effects for all. ``departures`` add half a venue's own
    to the local side and take half from the other.
    """
    return _placed(prepared, effects, tiers, departures).select(*prepared.columns, _venue_term(F.col("is_local"), F.col("opponent_is_local")).alias("venue_term"))


def fit(prepared: DataFrame, strength: tuple[float, float] = (8.0, 8.0), tempo_strength: float = 8.0, priors: DataFrame | None = None) -> DataFrame:
    """Attack, defence and tempo per team, with the league means and the residual spread on every row.

    A ``venue_term`` of the rows is taken out of the response before the fit.
    """
    league = league_means(prepared)
    rows = prepared.crossJoin(F.broadcast(league))
    venue = F.col("venue_term") if "venue_term" in prepared.columns else F.lit(0.0)
    pairs = session.cut_lineage(pair_sums(rows, F.col("efficiency") - F.col("league_efficiency") - venue))
    efficiency = ridge(pairs, strength, priors=priors)
    one_side = rows.filter(F.col("home_away") == "home")
    tempo = ridge(pair_sums(one_side, F.col("game_possessions") - F.col("league_tempo")), (tempo_strength, tempo_strength), shared=True)
    out = efficiency.select("team_id", F.col("a").alias("offence"), F.col("b").alias("defence"), F.col("weight_a").alias("offence_weight"), F.col("weight_b").alias("defence_weight"))
    out = out.join(tempo.select("team_id", F.col("a").alias("tempo"), F.col("weight_a").alias("tempo_weight")), "team_id", "left")
    return out.crossJoin(F.broadcast(league)).crossJoin(F.broadcast(residual_spread(pairs, efficiency)))


def season_fit(prepared: DataFrame, strength: tuple[float, float] = (1.0, 1.0), penalty: float = VENUE_RIDGE, force_distributed: bool = False) -> DataFrame:
    """Attack and defence of a completed season beside its venue effects, fitted together.

    The normal equations are an arrow: a block of teams, and a few columns that all rows
    share. The team block is eliminated by solving it once for the response and once for
    each shared column, which are further sums per pair; what is left is a system of the
    size of the shared columns. The residual spread comes from the same sums. A place
    that no game was played in gets an effect of zero.
    """
    at_home, quasi = F.col("venue_state") == "home", F.col("venue_state") == "quasi_neutral"
    shared = {"home_offence": at_home & F.col("is_local"), "home_defence": at_home & F.col("opponent_is_local"),
              "quasi_offence": quasi & F.col("is_local"), "quasi_defence": quasi & F.col("opponent_is_local")}
    names = list(shared)
    k = len(names)
    rows = prepared.crossJoin(F.broadcast(league_means(prepared)))
    rows = rows.select("team_id", "opponent_id", (F.col("efficiency") - F.col("league_efficiency")).alias("y"), *[c.cast("double").alias(n) for n, c in shared.items()])
    y = F.col("y")
    per = rows.groupBy(F.col("team_id").alias("i"), F.col("opponent_id").alias("j")).agg(
        F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), *[F.sum(n).alias(n) for n in names], *[F.sum(F.col(n) * y).alias(f"{n}_y") for n in names],
        *[F.sum(F.col(names[p]) * F.col(names[q])).alias(f"d{p}{q}") for p in range(k) for q in range(p, k)])
    pairs = session.cut_lineage(per)
    effects = ridge(pairs, strength, force_distributed=force_distributed).select("team_id", F.col("a").alias("a0"), F.col("b").alias("b0"))
    for m, name in enumerate(names, 1):
        one = ridge(pairs.withColumn("y", F.col(name)), strength, force_distributed=force_distributed)
        effects = effects.join(one.select("team_id", F.col("a").alias(f"a{m}"), F.col("b").alias(f"b{m}")), "team_id")
    effects = session.cut_lineage(effects)
    met = _both(pairs, effects, {f"a{m}": f"b{m}" for m in range(k + 1)})
    sums = met.agg(
        *[F.sum(F.col(n) * F.col(f"m{m}")).alias(f"x{p}{m}") for p, n in enumerate(names) for m in range(k + 1)],
        *[F.sum(f"{n}_y").alias(f"s{p}") for p, n in enumerate(names)], *[F.sum(f"d{p}{q}").alias(f"d{p}{q}") for p in range(k) for q in range(p, k)]).first()
    d = np.array([[sums[f"d{min(p, q)}{max(p, q)}"] or 0.0 for q in range(k)] for p in range(k)])
    x = np.array([[sums[f"x{p}{m}"] or 0.0 for m in range(k + 1)] for p in range(k)])
    s = np.array([sums[f"s{p}"] or 0.0 for p in range(k)])
    gamma = np.linalg.solve(d + penalty * np.eye(k) - x[:, 1:], s - x[:, 0])
    take = lambda c: F.col(f"{c}0") - sum((float(g) * F.col(f"{c}{m}") for m, g in enumerate(gamma, 1)), F.lit(0.0))
    teams = effects.select("team_id", take("a").alias("a"), take("b").alias("b"))
    # Squares of what is left: response, minus team effects, minus shared columns.
    left = _both(pairs, teams, {"a": "b"})
    m, n = F.col("m0"), F.col("n")
    g = [float(v) for v in gamma]
    shift = sum((g[p] * F.col(names[p]) for p in range(k)), F.lit(0.0))
    cross = sum((g[p] * F.col(f"{names[p]}_y") for p in range(k)), F.lit(0.0))
    square = sum((g[p] * g[q] * (1.0 if p == q else 2.0) * F.col(f"d{p}{q}") for p in range(k) for q in range(p, k)), F.lit(0.0))
    rest = left.agg(F.sum(n).alias("n"), F.sum(F.col("y") - n * m - shift).alias("t"), F.sum(F.col("yy") - 2.0 * m * F.col("y") + n * m * m - 2.0 * cross + 2.0 * m * shift + square).alias("s"))
    spread = rest.select(_spread(F.col("t"), F.col("s"), F.col("n")).alias("residual_sd"))
    return teams.select("team_id", F.col("a").alias("offence"), F.col("b").alias("defence"), *[F.lit(v).alias(name) for name, v in zip(names, g)]).crossJoin(F.broadcast(spread))


def market_fit(lined: DataFrame, strength: float = 2.0) -> DataFrame:
    """Ratings from closing margins and totals. Home edge is the mean signed margin."""
    margin = lined.filter("market_margin is not null")
    edge = margin.agg(F.avg("market_margin").alias("edge"), F.count("*").alias("games"))
    level = lined.filter("market_total is not null").agg(F.avg("market_total").alias("level"))
    name = lambda d: d.withColumnsRenamed({"game_home_id": "team_id", "game_away_id": "opponent_id"})
    m = ridge(pair_sums(name(margin).crossJoin(F.broadcast(edge)), F.col("market_margin") - F.col("edge")), (strength, strength), (1.0, -1.0), shared=True)
    t = ridge(pair_sums(name(lined.filter("market_total is not null")).crossJoin(F.broadcast(level)), F.col("market_total") - F.col("level")), (strength, strength), shared=True)
    return m.select("team_id", F.col("a").alias("margin_rating")).join(t.select("team_id", F.col("a").alias("total_rating")), "team_id", "full_outer").crossJoin(F.broadcast(edge)).crossJoin(F.broadcast(level))


def simple_ratings(games: DataFrame, sweeps: int = 200, tolerance: float = 1e-9, every: int = 8) -> DataFrame:
    """Margin plus mean opponent rating, swept to a fixed point and centred, by season.

    Sweeps run on the pair table, whose weights are each opponent's share of a team's
    games, so one sweep is a join and a sum. A constant added to all ratings of a season
    passes through a sweep unchanged, so centring waits until the lineage is cut. The
    number of sweeps is a rule; ``converged`` tells whether they were enough.
    """
    met = games.groupBy("season", "team_id", "opponent_id").agg(F.count("*").alias("n"), F.sum("margin").alias("m"))
    team = W.partitionBy("season", "team_id")  # as many rows as opponents met
    pairs = session.cut_lineage(met.select("season", "team_id", "opponent_id", "n", (F.col("n") / F.sum("n").over(team)).alias("w"), (F.sum("m").over(team) / F.sum("n").over(team)).alias("margin")))
    base = session.cut_lineage(pairs.groupBy("season", "team_id").agg(F.max("margin").alias("margin"), F.sum("n").alias("games")))
    own = base.select("season", "team_id", F.col("margin").alias("part"))
    current = base.select("season", "team_id", F.col("margin").alias("rating"))
    done, settled = 0, False
    while done < sweeps and not settled:
        steps = min(every, sweeps - done)
        for _ in range(steps):
            last = current
            other = current.select("season", F.col("team_id").alias("opponent_id"), F.col("rating").alias("o"))
            parts = pairs.join(other, ["season", "opponent_id"]).select("season", "team_id", (F.col("w") * F.col("o")).alias("part")).unionByName(own)
            current = parts.groupBy("season", "team_id").agg(F.sum("part").alias("rating"))
        done += steps
        both = current.join(last.withColumnRenamed("rating", "last"), ["season", "team_id"])
        centre = both.groupBy("season").agg(F.avg("rating").alias("c"), F.avg("last").alias("cl"))
        both = session.cut_lineage(both.join(centre, "season").select("season", "team_id", (F.col("rating") - F.col("c")).alias("rating"), (F.col("last") - F.col("cl")).alias("last")))
        gap = both.agg(F.max(F.abs(F.col("rating") - F.col("last")))).first()[0]
        current = both.select("season", "team_id", "rating")
        settled = gap is None or gap < tolerance
    return base.join(current, ["season", "team_id"]).withColumn("converged", F.lit(settled))


def schedule_strength(games: DataFrame, ratings: DataFrame) -> DataFrame:
    other = ratings.select("season", F.col("team_id").alias("opponent_id"), F.col("rating").alias("o"))
    pairs = games.groupBy("season", "team_id", "opponent_id").agg(F.count("*").alias("n"))
    return pairs.join(other, ["season", "opponent_id"]).groupBy("season", "team_id").agg((F.sum(F.col("n") * F.col("o")) / F.sum("n")).alias("strength"))


def components(edges: DataFrame, left: str = "team_id", right: str = "opponent_id", limit: int = 60) -> DataFrame:
    """Connected components: every node takes the least label around it, then its
    label's label, until nothing changes. One row per node; edges are made distinct."""
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    e = session.cut_lineage(e.union(e.select("b", "a")).distinct())
    labels = session.cut_lineage(e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(limit):
        near = e.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        merged = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = merged.select(F.col("node").alias("label"), F.col("label").alias("up"))
        fresh = session.cut_lineage(merged.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = fresh.filter("label <> old").limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components not found in {limit} rounds")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(sizes, "label").select("node", F.col("label").alias("component"), "size")


def matchups(fixtures: DataFrame, ratings: DataFrame, parts: DataFrame | None = None, effects: DataFrame | None = None, tiers: DataFrame | None = None, departures: DataFrame | None = None) -> DataFrame:
    """Expected score of each side, margin, total, tempo and whether it may be priced.

    With ``effects`` and ``tiers`` the place adds what it adds to the rows of a fit: a host
    is local; on quasi-neutral ground the fixture's ``local_team_id`` says who is, and
    without one the game is refused.
    """
    cols = ["offence", "defence", "tempo"]
    side = lambda s: ratings.select(F.col("team_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    league = ratings.agg(F.max("league_efficiency").alias("league_efficiency"), F.max("league_tempo").alias("league_tempo"))
    named = F.col("local_team_id") if "local_team_id" in fixtures.columns else F.lit(None).cast("long")
    local = F.when(F.col("venue_state") == "home", F.coalesce(named, F.col("home_id"))).when(F.col("venue_state") == "quasi_neutral", named)
    rows = fixtures.withColumn("local_team_id", local).join(side("home"), "home_id", "left").join(side("away"), "away_id", "left").crossJoin(F.broadcast(league))
    terms = {"home": F.lit(0.0), "away": F.lit(0.0)}
    if effects is not None:
        rows = _placed(rows, effects, tiers, departures)
        at = {s: F.coalesce(F.col("local_team_id") == F.col(f"{s}_id"), F.lit(False)) for s in terms}
        terms = {"home": _venue_term(at["home"], at["away"]), "away": _venue_term(at["away"], at["home"])}
    home = F.col("league_efficiency") + F.col("home_offence") + F.col("away_defence") + terms["home"]
    away = F.col("league_efficiency") + F.col("away_offence") + F.col("home_defence") + terms["away"]
    tempo = F.col("league_tempo") + F.col("home_tempo") + F.col("away_tempo")
    reason = F.when(F.col("venue_state") == "unknown", "venue unknown").when((F.col("venue_state") == "quasi_neutral") & F.col("local_team_id").isNull(), "local side unknown")
    if parts is not None:
        p = lambda s: parts.select(F.col("node").alias(f"{s}_id"), F.col("component").alias(f"{s}_part"))
        rows = rows.join(p("home"), "home_id", "left").join(p("away"), "away_id", "left")
        reason = reason.when(~F.coalesce(F.col("home_part") == F.col("away_part"), F.lit(False)), "not connected")
    reason = reason.when(F.col("home_offence").isNull() | F.col("away_offence").isNull(), "no rating")
    out = rows.withColumns({"home_per_100": home, "away_per_100": away, "possessions": tempo, "reason": reason})
    points = lambda c: F.col(c) * F.col("possessions") / 100.0
    out = out.withColumns({"margin": points("home_per_100") - points("away_per_100"), "total": points("home_per_100") + points("away_per_100"), "priceable": F.col("reason").isNull()})
    return out.select(*fixtures.columns, "margin", "total", "possessions", "priceable", "reason")


def season_pairs(ratings: DataFrame, value: str, roster: DataFrame | None = None) -> DataFrame:
    """Team value of this and the season before, each centred over shared teams."""
    now = ratings.select("season", "team_id", F.col(value).alias("current"))
    last = ratings.select((F.col("season") + 1).alias("season"), "team_id", F.col(value).alias("previous"))
    both = now.join(last, ["season", "team_id"])
    means = both.groupBy("season").agg(F.avg("current").alias("mc"), F.avg("previous").alias("mp"))
    out = both.join(means, "season").select("season", "team_id", (F.col("previous") - F.col("mp")).alias("previous"), (F.col("current") - F.col("mc")).alias("current"))
    return out if roster is None else out.join(roster, ["season", "team_id"], "left").na.fill(0.0)


def carryover(pairs: DataFrame) -> DataFrame:
    """Slope through the origin over all seasons, and the spread of the last season's
    residuals under the slope of the others."""
    last = pairs.agg(F.max("season").alias("__last"))
    rows = pairs.crossJoin(F.broadcast(last))
    early, late = F.col("season") < F.col("__last"), F.col("season") == F.col("__last")
    x, y = F.col("previous"), F.col("current")
    s = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    sums = rows.agg(
        F.count("*").alias("pairs"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), s(early, x * y).alias("exy"), s(early, x * x).alias("exx"),
        F.count_if(late).alias("held"), s(late, x).alias("lx"), s(late, y).alias("ly"), s(late, x * x).alias("lxx"), s(late, x * y).alias("lxy"), s(late, y * y).alias("lyy"))
    b = F.try_divide(F.col("exy"), F.col("exx"))
    n = F.col("held")
    mean = (F.col("ly") - b * F.col("lx")) / n
    square = F.col("lyy") - 2 * b * F.col("lxy") + b * b * F.col("lxx") - n * mean * mean
    return sums.select("pairs", F.try_divide(F.col("xy"), F.col("xx")).alias("carryover"), "held", F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), square) / (n - 1))).alias("residual_sd"))


def venue_effects(prepared: DataFrame, ratings: DataFrame, tiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Home effect of the league and of each tier (ridge on twelve columns), and each
    venue's departure by variance components."""
    r = lambda c, a, n: ratings.select(F.col("team_id").alias(c), F.col(a).alias(n))
    rows = prepared.join(r("team_id", "offence", "__o"), "team_id", "left").join(r("opponent_id", "defence", "__d"), "opponent_id", "left").na.fill(0.0, ["__o", "__d"])
    rows = rows.crossJoin(F.broadcast(league_means(prepared)))
    rows = rows.join(tiers.select(F.col("team_id").alias("local_team_id"), F.col("tier").alias("__tier")), "local_team_id", "left")
    names = VENUE_TIERS
    home = (F.col("venue_state") == "home").cast("double")
    quasi = (F.col("venue_state") == "quasi_neutral").cast("double")
    own, other = home * F.col("is_local").cast("double"), home * F.col("opponent_is_local").cast("double")
    tier = F.coalesce("__tier", F.lit("unplaced"))
    cols = [own, other, *[own * (tier == t).cast("double") for t in names], *[other * (tier == t).cast("double") for t in names], quasi * F.col("is_local").cast("double"), quasi * F.col("opponent_is_local").cast("double")]
    labels = VENUE_COLUMNS
    k = len(cols)
    y = F.col("efficiency") - F.col("league_efficiency") - F.col("__o") - F.col("__d")
    rows = rows.select("game_id", "home_away", "is_local", "venue_id", home.alias("__home"), y.alias("__y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    got = rows.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"x{i}") * F.col("__y")).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    penalty = np.zeros(k)
    penalty[2:10] = TIER_EFFECT_SHRINK
    beta, *_ = np.linalg.lstsq(a + np.diag(penalty), np.array([got[f"b{i}"] or 0.0 for i in range(k)]), rcond=None)
    spark = prepared.sparkSession
    effects = spark.createDataFrame([(n, float(b)) for n, b in zip(labels, beta)], "effect string, value double")
    rest = rows.withColumn("__e", F.col("__y") - sum((float(b) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))).filter("__home = 1 and venue_id is not null")
    games = rest.groupBy("game_id", "venue_id").agg(F.avg(F.when(F.col("is_local"), F.col("__e"))).alias("l"), F.avg(F.when(~F.col("is_local"), F.col("__e"))).alias("v")).filter("l is not null and v is not null")
    per = games.groupBy("venue_id").agg(F.count("*").alias("games"), F.avg((F.col("l") - F.col("v")) / 2.0).alias("mean"), F.var_samp((F.col("l") - F.col("v")) / 2.0).alias("var"))
    use = per.filter("games >= 5").agg(
        F.count("*").alias("m"), (F.sum(F.coalesce("var", F.lit(0.0)) * F.col("games")) / F.sum("games")).alias("within"),
        (F.count("*") / F.sum(1.0 / F.col("games"))).alias("harmonic"), F.var_samp("mean").alias("observed"))
    between = F.greatest(F.lit(0.0), F.col("observed") - F.col("within") / F.col("harmonic"))
    weight = F.when(between > 0, F.col("games") / (F.col("games") + F.col("within") / between)).otherwise(0.0)
    departures = per.crossJoin(F.broadcast(use)).select("venue_id", "games", (weight * F.col("mean")).alias("departure"))
    return effects, departures


def reciprocal_home_edge(games: DataFrame, tiers: DataFrame, looks: int = 1) -> DataFrame:
    """Home margin of pairs that hosted each other, per tier; the pair is the cluster."""
    home = games.filter((F.col("home_away") == "home") & (F.col("venue_state") == "home"))
    pair = ["season", "__lo", "__hi"]
    keyed = home.withColumns({"__lo": F.least("team_id", "opponent_id"), "__hi": F.greatest("team_id", "opponent_id")})
    per = keyed.groupBy(*pair).agg(
        F.avg(F.when(F.col("team_id") == F.col("__lo"), F.col("margin"))).alias("m1"), F.avg(F.when(F.col("team_id") == F.col("__hi"), F.col("margin"))).alias("m2")).filter("m1 is not null and m2 is not null")
    per = per.withColumn("edge", (F.col("m1") + F.col("m2")) / 2.0)
    t = lambda c, n: tiers.select(F.col("team_id").alias(c), F.col("tier").alias(n))
    per = per.join(t("__lo", "t1"), "__lo", "left").join(t("__hi", "t2"), "__hi", "left")
    from closeline.operators import schedules as S

    rows = per.withColumn("tier", S.game_tier("t1", "t2")).withColumn("pair", F.concat_ws("-", "__lo", "__hi"))
    return I.interval(rows, [["tier"]], {"game": "pair"}, "edge", looks)


def score_fit(games: DataFrame) -> DataFrame:
    """Residual scores after team and opponent means: spread and correlation of the
    two sides of a game, per season."""
    own = games.groupBy("season", "team_id").agg(F.avg("team_score").alias("o"))
    against = games.groupBy("season", F.col("opponent_id")).agg(F.avg("team_score").alias("d"))
    level = games.groupBy("season").agg(F.avg("team_score").alias("g"))
    rows = games.join(own, ["season", "team_id"]).join(against, ["season", "opponent_id"]).join(level, "season")
    rows = rows.withColumn("e", F.col("team_score") - F.col("o") - F.col("d") + F.col("g"))
    sides = rows.groupBy("season", "game_id").agg(F.max(F.when(F.col("home_away") == "home", F.col("e"))).alias("h"), F.max(F.when(F.col("home_away") == "away", F.col("e"))).alias("a"))
    return sides.groupBy("season").agg(F.count("*").alias("games"), F.var_samp("h").alias("home_variance"), F.var_samp("a").alias("away_variance"), F.corr("h", "a").alias("correlation"),
                                       F.var_samp(F.col("h") - F.col("a")).alias("margin_variance"), F.var_samp(F.col("h") + F.col("a")).alias("total_variance"))


def accuracy(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors of projected margins and totals, and the share of winners."""
    m = F.col("actual_margin") - F.col("pred_margin")
    t = F.col("actual_total") - F.col("pred_total")
    right = (F.signum("actual_margin") == F.signum("pred_margin")) & (F.col("pred_margin") != 0)
    return games.groupBy(*by).agg(F.count("*").alias("games"), F.avg(F.abs(m)).alias("margin_mae"), F.avg(m).alias("margin_bias"), F.avg(F.abs(t)).alias("total_mae"), F.avg(t).alias("total_bias"), F.avg(right.cast("double")).alias("winners"))


def rating_moves(before: DataFrame, after: DataFrame, value: str = "rating") -> DataFrame:
    b = before.select("team_id", F.col(value).alias("before"))
    a = after.select("team_id", F.col(value).alias("after"))
    out = b.join(a, "team_id", "full_outer").withColumn("move", F.col("after") - F.col("before"))
    return out.orderBy(F.abs("move").desc_nulls_last(), "team_id")


# Floors of the layer audit.
MOVE_FLOOR, LAYER_GAMES, LAYER_DAYS, DROP_Z, ADD_Z = 0.01, 200, 5, -2.0, 2.0


def layer_gains(frame: DataFrame) -> DataFrame:
    """Squared-error gain of a layer per game. Needs layer, on, move_m, move_t,
    pred_margin, pred_total, actual_margin, actual_total."""
    rows = frame.filter("move_m is not null and move_t is not null").filter(F.abs("move_m") + F.abs("move_t") > MOVE_FLOOR)
    with_ = lambda p, m: F.when(F.col("on"), F.col(p)).otherwise(F.col(p) + F.col(m))
    rows = rows.withColumns({"__wm": with_("pred_margin", "move_m"), "__wt": with_("pred_total", "move_t")})
    rm, rt = F.col("actual_margin") - F.col("__wm") + F.col("move_m"), F.col("actual_total") - F.col("__wt") + F.col("move_t")
    gain = F.pow(rm, 2) - F.pow(F.col("actual_margin") - F.col("__wm"), 2) + F.pow(rt, 2) - F.pow(F.col("actual_total") - F.col("__wt"), 2)
    return rows.withColumns({"gain": gain, "resid_m": rm, "resid_t": rt}).drop("__wm", "__wt")


def layer_verdicts(gains: DataFrame) -> DataFrame:
    """Mean gain, its clustered error, best scale and whether the layer goes on or off."""
    mean = I.clustered_mean(gains, "gain", "day", ["layer"])
    extra = gains.groupBy("layer").agg(
        F.max("on").alias("default_on"), F.countDistinct("day").alias("days"), F.sum(F.pow("move_m", 2) + F.pow("move_t", 2)).alias("mm"),
        F.sum(F.col("move_m") * F.col("resid_m") + F.col("move_t") * F.col("resid_t")).alias("mr"))
    out = mean.join(extra, "layer").withColumn("z", F.col("mean") / F.col("standard_error"))
    k = F.try_divide(F.col("mr"), F.nullif(F.col("mm"), F.lit(0.0)))
    best_gain = (2 * k * F.col("mr") - k * k * F.col("mm")) / F.col("rows")
    thin = (F.col("rows") < LAYER_GAMES) | (F.col("days") < LAYER_DAYS) | F.col("z").isNull()
    on = F.when(thin, F.col("default_on")).when(F.col("default_on") & (F.col("z") <= DROP_Z), False).when(~F.col("default_on") & (F.col("z") >= ADD_Z), True).otherwise(F.col("default_on"))
    return out.select("layer", F.col("rows").alias("games"), "days", F.col("mean").alias("gain"), "standard_error", "z", k.alias("best_scale"), best_gain.alias("gain_at_best_scale"), on.alias("on"))
