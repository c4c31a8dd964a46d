import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from closeline.operators import ratings as R


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(8)
    n = 600
    i = rng.integers(0, 12, n)
    j = (i + rng.integers(1, 12, n)) % 12
    pdf = pd.DataFrame({"team_id": i, "opponent_id": j, "y": rng.normal(0, 10, n) + i - 0.5 * j})
    return pdf, R.pair_sums(spark.createDataFrame(pdf), F.col("y")).cache()


def solve(pdf, lam):
    x = np.zeros((len(pdf), 24))
    x[np.arange(len(pdf)), pdf["team_id"]] = 1
    x[np.arange(len(pdf)), pdf["opponent_id"] + 12] = 1
    return np.linalg.solve(x.T @ x + lam * np.eye(24), x.T @ pdf["y"])


def test_ridge_equals_the_dense_solution(pairs):
    pdf, sums = pairs
    out = {r["team_id"]: r for r in R.ridge(sums, (5.0, 5.0)).collect()}
    want = solve(pdf, 5.0)
    for t in range(12):
        assert out[t]["a"] == pytest.approx(want[t], abs=1e-9) and out[t]["b"] == pytest.approx(want[t + 12], abs=1e-9)
        assert 0 < out[t]["weight_a"] < 1


def test_distributed_solver_equals_the_small_one(pairs):
    _, sums = pairs
    small = {r["team_id"]: (r["a"], r["b"]) for r in R.ridge(sums, (20.0, 20.0)).collect()}
    large = {r["team_id"]: (r["a"], r["b"]) for r in R.ridge(sums, (20.0, 20.0), force_distributed=True, tolerance=1e-6).collect()}
    for t, v in small.items():
        assert large[t] == pytest.approx(v, abs=1e-3)


def test_simple_ratings_reach_the_fixed_point(spark):
    rng = np.random.default_rng(9)
    i = rng.integers(0, 8, 200)
    j = (i + rng.integers(1, 8, 200)) % 8
    m = rng.normal(0, 8, 200) + 2.0 * (i - j)
    rows = [(2024, int(a), int(b), float(x)) for a, b, x in zip(i, j, m)] + [(2024, int(b), int(a), -float(x)) for a, b, x in zip(i, j, m)]
    pdf = pd.DataFrame(rows, columns=["season", "team_id", "opponent_id", "margin"])
    out = R.simple_ratings(spark.createDataFrame(pdf)).toPandas().set_index("team_id")["rating"]
    again = pdf.groupby("team_id")["margin"].mean() + pdf.assign(o=pdf["opponent_id"].map(out)).groupby("team_id")["o"].mean()
    np.testing.assert_allclose((again - again.mean()).sort_index(), out.sort_index(), atol=1e-7)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 201)]
    rows = {r["node"]: (r["component"], r["size"]) for r in R.components(spark.createDataFrame(chain, "team_id long, opponent_id long")).collect()}
    assert all(rows[i] == (0, 41) for i in range(41)) and rows[102] == (100, 3) and rows[201] == (200, 2)


def test_unknown_venues_are_not_priced(spark):
    ratings = spark.createDataFrame([(1, 5.0, -2.0, 1.0, 100.0, 70.0), (2, -1.0, 3.0, -1.0, 100.0, 70.0)], "team_id long, offence double, defence double, tempo double, league_efficiency double, league_tempo double")
    games = spark.createDataFrame([(1, 1, 2, "home"), (2, 1, 2, "unknown"), (3, 1, 9, "neutral"), (4, 1, 2, "quasi_neutral")], "game_id long, home_id long, away_id long, venue_state string")
    effects = spark.createDataFrame([("league offence", 2.0), ("league defence", -2.0), ("quasi offence", 1.0), ("quasi defence", -3.0)], "effect string, value double")
    tiers = spark.createDataFrame([(1, "high_major")], "team_id long, tier string")
    out = {r["game_id"]: r for r in R.matchups(games, ratings, effects=effects, tiers=tiers).collect()}
    assert out[1]["priceable"] and out[1]["margin"] == pytest.approx((110 - 95) * 70 / 100)
    assert [out[i]["reason"] for i in (2, 3, 4)] == ["venue unknown", "no rating", "local side unknown"]
    named = games.filter("game_id = 4").withColumn("local_team_id", F.lit(2).cast("long"))
    got = R.matchups(named, ratings, effects=effects, tiers=tiers).first()
    assert got["priceable"] and got["margin"] == pytest.approx((108 - 3 - (97 + 1)) * 70 / 100)


def season(rng, teams=7, n=240):
    """Team games with home, neutral and quasi-neutral places; some quasi ones without a local side."""
    rows = []
    for g in range(n):
        a = int(rng.integers(teams))
        b = int((a + rng.integers(1, teams)) % teams)
        state = str(rng.choice(["home", "neutral", "quasi_neutral"], p=[0.6, 0.2, 0.2]))
        local = a if state == "home" else [a, b, None][int(rng.integers(3))] if state == "quasi_neutral" else None
        poss = float(rng.integers(60, 80))
        for team, other, side in ((a, b, "home"), (b, a, "away")):
            at = 3.0 if team == local else -2.0 if other == local else 0.0
            rows.append((g, team, other, side, state, 2, poss, float(round(70 + 2 * team - other + at + rng.normal(0, 4))), "countable", local, g % 9))
    return pd.DataFrame(rows, columns=["game_id", "team_id", "opponent_id", "home_away", "venue_state", "periods", "possessions", "team_score", "game_state", "local", "venue_id"])


@pytest.fixture(scope="module")
def games(spark):
    pdf = season(np.random.default_rng(4))
    frame = spark.createDataFrame(pdf.drop(columns="local"))
    local = spark.createDataFrame(pdf[["game_id", "local"]].drop_duplicates().astype({"local": "float"}).itertuples(index=False, name=None), "game_id long, l double").selectExpr("game_id", "cast(nanvl(l, null) as long) as local_team_id")
    return pdf, R.prepare(frame, local).cache()


def columns(pdf):
    eff = 100 * pdf["team_score"] / pdf["possessions"]
    own, other = pdf["local"] == pdf["team_id"], pdf["local"] == pdf["opponent_id"]
    at, quasi = pdf["venue_state"] == "home", pdf["venue_state"] == "quasi_neutral"
    team = np.zeros((len(pdf), 14))
    team[np.arange(len(pdf)), pdf["team_id"]] = 1
    team[np.arange(len(pdf)), pdf["opponent_id"] + 7] = 1
    return (eff - eff.mean()).to_numpy(), team, np.column_stack([at & own, at & other, quasi & own, quasi & other]).astype(float)


@pytest.mark.parametrize("distributed", [False, True])
def test_season_fit_equals_the_dense_solution(games, distributed):
    pdf, prepared = games
    y, team, place = columns(pdf)
    x = np.hstack([team, place])
    want = np.linalg.solve(x.T @ x + np.eye(18), x.T @ y)
    rows = {r["team_id"]: r for r in R.season_fit(prepared, force_distributed=distributed).collect()}
    for t in range(7):
        assert rows[t]["offence"] == pytest.approx(want[t], abs=1e-6) and rows[t]["defence"] == pytest.approx(want[7 + t], abs=1e-6)
    assert [rows[0][c] for c in ("home_offence", "home_defence", "quasi_offence", "quasi_defence")] == pytest.approx(list(want[14:]), abs=1e-6)
    assert rows[0]["residual_sd"] == pytest.approx(np.std(y - x @ want, ddof=1), abs=1e-6)


def test_season_fit_without_quasi_games_gives_no_effect_there(games):
    _, prepared = games
    rows = R.season_fit(prepared.filter("venue_state <> 'quasi_neutral'")).first()
    assert rows["quasi_offence"] == 0.0 and rows["home_offence"] > 0


def test_venue_terms_and_spread_of_the_fit(games, spark):
    pdf, prepared = games
    tiers = spark.createDataFrame([(t, R.VENUE_TIERS[t % 3]) for t in range(6)], "team_id long, tier string")
    zero = spark.createDataFrame([(t, 0.0, 0.0) for t in range(7)], "team_id long, offence double, defence double")
    effects, departures = R.venue_effects(prepared, zero, tiers)
    y, team, place = columns(pdf)
    tier = pdf["local"].map(lambda t: "unplaced" if t is None or t != t or t == 6 else R.VENUE_TIERS[int(t) % 3])
    x = np.column_stack([place[:, :2], *[place[:, k] * (tier == n) for k in (0, 1) for n in R.VENUE_TIERS], place[:, 2:]])
    penalty = np.diag([0.0] * 2 + [50.0] * 8 + [0.0] * 2)
    beta = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    got = {r["effect"]: r["value"] for r in effects.collect()}
    assert [got[n] for n in R.VENUE_COLUMNS] == pytest.approx(list(beta), abs=1e-8) and got["quasi offence"] != 0
    own = {r["venue_id"]: r["departure"] for r in departures.collect()}
    termed = R.with_venue_term(prepared, effects, tiers, departures)
    half = pdf["venue_id"].map(own).to_numpy() / 2
    want = x @ beta + half * (place[:, 0] - place[:, 1])
    terms = {(r["game_id"], r["team_id"]): r["venue_term"] for r in termed.collect()}
    assert [terms[k] for k in zip(pdf["game_id"], pdf["team_id"])] == pytest.approx(list(want), abs=1e-8)
    fitted = R.fit(termed, strength=(3.0, 5.0)).collect()
    normal = team.T @ team + np.diag([3.0] * 7 + [5.0] * 7)
    theta = np.linalg.solve(normal, team.T @ (y - want))
    for r in fitted:
        assert (r["offence"], r["defence"]) == pytest.approx((theta[r["team_id"]], theta[7 + r["team_id"]]), abs=1e-8)
        assert r["residual_sd"] == pytest.approx(np.std(y - want - team @ theta, ddof=1), abs=1e-8)


def test_local_sides(spark):
    from closeline.operators import schedules as D

    played = [(1, 2024, 1, 2, False, 10, "A", "S"), (2, 2024, 2, 1, False, 20, "B", "S"), (3, 2024, 3, 1, False, 30, "A", "S"), (9, 2025, 1, 2, False, 99, "Z", "S")]
    asked = [(4, 2024, 2, 1, True, 55, "A", "S"), (5, 2024, 1, 3, True, 56, "A", "S"), (6, 2024, 1, 2, True, 57, "C", "S"), (7, 2024, 1, 2, None, 10, "A", "S"),
             (8, 2025, 1, 2, True, 10, "A", "S"), (10, 2024, 1, 2, True, 20, "Q", "T"), (11, 2024, None, 2, False, 10, "A", "S"), (12, 2024, 1, 2, True, None, None, None)]
    frame = spark.createDataFrame(played + asked, "game_id long, season long, home_id long, away_id long, neutral_site boolean, venue_id long, venue_city string, venue_state_code string")
    got = {r["game_id"]: (r["venue_state"], r["local_team_id"], r["local_side"]) for r in D.local_sides(frame).collect()}
    assert got[1] == ("home", 1, "host") and got[11] == ("home", None, "host unknown")
    assert got[4] == ("quasi_neutral", 1, "away side local") and got[5] == ("quasi_neutral", None, "both local")
    assert got[6] == ("neutral", None, "nobody local") and got[7] == ("unknown", None, "venue unknown") and got[12] == ("unknown", None, "venue unknown")
    assert got[8] == ("neutral", None, "nobody local") and got[10] == ("quasi_neutral", 2, "away side local")
