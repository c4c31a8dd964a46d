"""Intervals and scores against numpy, and the degenerate cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from closeline.operators import calibration as K, intervals as I


def by_definition(pdf, cluster):
    g = pdf.groupby(cluster)["profit_units"].agg(["sum", "size"])
    roi = g["sum"].sum() / g["size"].sum()
    r = g["sum"] - roi * g["size"]
    n = len(g)
    return roi, math.sqrt((r**2).sum() / (n * (n - 1))) / (g["size"].sum() / n)


@pytest.fixture(scope="module")
def bets(spark):
    rng = np.random.default_rng(1)
    n = 5000
    # A third of all rows in one game.
    pdf = pd.DataFrame({"event_id": np.where(rng.random(n) < 0.33, 0, rng.integers(1, 400, n)), "slate_date": rng.integers(0, 30, n), "subject": rng.integers(0, 60, n),
                        "tier": rng.choice(["a", "b"], n), "profit_units": rng.normal(0.02, 1, n)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_interval_matches_its_definition(bets):
    pdf, frame = bets
    got = {(r["tier"], r["grouping"]): r for r in I.interval(frame, [["tier"], []], {"game": "event_id"}, looks=5).collect()}
    for tier in ("a", "b", None):
        part = pdf if tier is None else pdf[pdf["tier"] == tier]
        roi, se = by_definition(part, "event_id")
        row = got[(tier, 1 if tier is None else 0)]
        assert row["roi"] == pytest.approx(roi, abs=1e-12) and row["standard_error"] == pytest.approx(se, rel=1e-9)
        assert row["adjusted_high"] - row["roi"] == pytest.approx(I.adjusted_z(5) * se, rel=1e-9)


def test_the_widest_unit_is_kept(bets):
    pdf, frame = bets
    row = I.interval(frame, [[]], {"game": "event_id", "day": "slate_date", "athlete": "subject"}).first()
    errors = {u: by_definition(pdf, c)[1] for u, c in (("game", "event_id"), ("day", "slate_date"), ("athlete", "subject"))}
    assert row["unit"] == max(errors, key=errors.get) and row["standard_error"] == pytest.approx(max(errors.values()), rel=1e-9)


def test_interval_agrees_with_a_bootstrap_over_clusters(bets):
    pdf, frame = bets
    se = I.interval(frame, [[]], {"day": "slate_date"}).first()["standard_error"]
    g = pdf.groupby("slate_date")["profit_units"].agg(["sum", "size"]).to_numpy()
    rng = np.random.default_rng(2)
    draws = [(lambda s: s[:, 0].sum() / s[:, 1].sum())(g[rng.integers(0, len(g), len(g))]) for _ in range(3000)]
    assert se == pytest.approx(np.std(draws), rel=0.15)


def test_degenerate_intervals_are_infinite(spark):
    one = spark.createDataFrame([(1, 1, 0.5), (1, 1, -0.2)], "event_id int, slate_date int, profit_units double")
    flat = spark.createDataFrame([(i, i, 0.1) for i in range(50)], "event_id int, slate_date int, profit_units double")
    for frame in (one, flat):
        row = I.interval(frame, [[]], {"game": "event_id"}).first()
        assert row["low"] == -math.inf and row["high"] == math.inf and row["standard_error"] == 0.0
        assert row["verdict"] == "not enough evidence"


def test_clustered_regression(spark):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"event_id": rng.integers(0, 300, n), "slate_date": rng.integers(0, 40, n), "a": rng.random(n), "b": rng.normal(0, 0.1, n)})
    pdf["won"] = (rng.random(n) < pdf["a"]).astype(float)
    out = {r["name"]: r for r in K.ols_clustered(spark.createDataFrame(pdf), "won", ["a", "b"], {"game": "event_id", "day": "slate_date"}, [0, 1, 0]).collect()}
    x = np.column_stack([np.ones(n), pdf["a"], pdf["b"]])
    beta, *_ = np.linalg.lstsq(x, pdf["won"], rcond=None)
    bread, resid = np.linalg.inv(x.T @ x), pdf["won"] - x @ beta
    errors = []
    for c in ("event_id", "slate_date"):
        s = pd.DataFrame(x * resid.to_numpy()[:, None]).groupby(pdf[c]).sum().to_numpy()
        g = len(s)
        errors.append(np.sqrt(np.diag(bread @ (s.T @ s) @ bread) * g / (g - 1) * (n - 1) / (n - 3)))
    for i, name in enumerate(("intercept", "a", "b")):
        assert out[name]["estimate"] == pytest.approx(beta[i], rel=1e-8)
        assert out[name]["standard_error"] == pytest.approx(max(e[i] for e in errors), rel=1e-6)


def test_a_constant_column_is_not_fitted(spark):
    frame = spark.createDataFrame([(i, i, 0.5, float(i % 2)) for i in range(20)], "event_id int, slate_date int, a double, won double")
    assert K.ols_clustered(frame, "won", ["a"], {"game": "event_id"}, [0, 1]).count() == 0


def test_calibration_bins_use_the_printed_edges(spark):
    frame = spark.createDataFrame([(p, 1.0) for p in (0.0, 0.3, 0.7, 0.99, 1.0)], "p double, won double")
    counts = {r["bucket"]: r["n"] for r in K.calibration_table(frame).collect()}
    assert len(counts) == 10 and {k: v for k, v in counts.items() if v} == {0: 1, 3: 1, 7: 1, 9: 2}


def test_edge_buckets_keep_empty_ones(spark):
    rows = [(1, "2024-01-01", 0.03, 0.5, 0.5, 1.0, 0.9)] * 3
    frame = spark.createDataFrame(rows, "event_id int, slate_date string, edge double, model_implied double, market_implied double, won double, profit_units double")
    out = K.edge_buckets(frame).orderBy("bucket").collect()
    assert [r["rows"] for r in out] == [0, 0, 0, 0, 3, 0, 0, 0]


def test_brier_prefers_the_truth(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0.2, 0.8, 4000)
    pdf = pd.DataFrame({"event_id": np.arange(4000) // 4, "slate_date": np.arange(4000) // 100, "won": (rng.random(4000) < p).astype(float), "model_implied": p, "market_implied": 0.5, "market_implied_raw": 0.52})
    row = K.brier(spark.createDataFrame(pdf)).first()
    assert row["skill_vs_devigged"] > 0 and row["fair_verdict"] == "demonstrated edge" and not row["loses_to_market"]
    assert row["base_rate_reference"] == pytest.approx(pdf["won"].var(ddof=0))


def test_an_interval_says_what_it_could_have_shown(spark):
    from statistics import NormalDist

    from closeline.operators import intervals as I

    rows = [(0.1, 0.02, 500, 0.05, 0.15), (0.1, 0.02, 100, 0.05, 0.15), (0.1, 0.0, 500, 0.1, 0.1), (-0.1, 0.01, 500, -0.12, -0.08), (0.0, 0.01, 500, -0.1, 0.1), (0.5, 0.01, 500, -0.1, 0.1), (0.1, 0.0, 500, float("nan"), float("nan"))]
    got = I.record(spark.createDataFrame(rows, "roi double, standard_error double, bets long, adjusted_low double, adjusted_high double").coalesce(1), looks=10).collect()
    z = NormalDist().inv_cdf(1 - 0.0025)
    assert [r["survives_correction"] for r in got] == [True, False, False, True, False, False, False]
    assert [r["enough_evidence"] for r in got] == [True, False, True, True, True, True, True]
    assert [r["inside_bounds"] for r in got][:6] == [True, True, True, True, True, False]
    assert got[0]["detectable_effect"] == pytest.approx(z * 0.02) and got[2]["detectable_effect"] is None
    assert got[0]["powered_effect"] == pytest.approx((z + NormalDist().inv_cdf(0.8)) * 0.02)


def test_upper_quantile_and_search_budget(spark):
    import math
    from statistics import NormalDist

    from closeline.functions import prices as P
    from closeline.operators import ledger as L

    tails = [10.0**-e for e in range(2, 19)] + [0.07, 0.025, 0.0005]
    got = spark.createDataFrame([(t,) for t in tails], "t double").select("t", P.upper_quantile(F.col("t")).alias("z")).collect()
    for r in got:
        assert r["z"] == pytest.approx(-NormalDist().inv_cdf(r["t"]), abs=1e-12)
    tests = spark.createDataFrame([("a", 1), ("b", 98), ("c", 10**6), ("d", None)], "market string, looks long")
    supply = spark.createDataFrame([("a", 1000), ("b", 5000), ("c", 23_000), ("e", 2000)], "market string, supply long")
    out = {r["market"]: r for r in L.search_budget(tests, supply).collect()}
    z = lambda n: NormalDist().inv_cdf(1 - 0.025 / n) if n < 10**12 else -NormalDist().inv_cdf(0.025 / n)
    need = lambda n: math.ceil(1537 * (z(n) / z(1)) ** 2) if n > 1 else 1537
    assert out["a"]["exhausted"] and out["a"]["bites_at"] == 2 and out["a"]["needed"] == 1537
    assert out["b"]["needed"] == need(98) and out["b"]["exhausted"] == (need(98) > 5000)
    assert not out["c"]["exhausted"] and out["c"]["correction_factor"] == pytest.approx(z(10**6) / z(1))
    bite = out["b"]["bites_at"]
    assert need(bite) > 5000 >= need(bite - 1)
    floor = out["b"]["bites_at_floor"]
    assert need(floor) > 10_000 >= need(floor - 1)
    assert out["d"]["looks"] == 1 and out["d"]["exhausted"] and out["e"]["looks"] == 1 and not out["e"]["exhausted"]


def test_refined_credibility_is_the_least_loss(spark):
    from closeline.operators import players as L

    rng = np.random.default_rng(2)
    n = 3000
    pm, m = rng.integers(60, 900, n).astype(float), rng.integers(5, 40, n).astype(float)
    skill = rng.normal(0.5, 0.1, n)
    bank, stat = (skill + rng.normal(0, 1, n) / np.sqrt(pm)) * pm, (skill + rng.normal(0, 0.3, n)) * m
    rows = spark.createDataFrame([(int(i % 2), float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(pm, m, bank, stat))] + [(0, 0.0, 5.0, 0.0, 1.0)], "bucket long, prior_minutes double, minutes double, bank_points double, points double")
    priors = spark.createDataFrame([(0, 0.5), (1, 0.48)], "bucket long, points double")
    k, loss = L.credibility(rows, priors, "points")
    prior = np.where(np.arange(n) % 2 == 0, 0.5, 0.48)
    of = lambda k: float(np.sum(m * (stat / m - prior - pm / (pm + k) * (bank / pm - prior)) ** 2) / m.sum())
    grid = np.exp(np.linspace(np.log(0.1), np.log(10_000), 200_001))
    best = min(grid, key=of)
    assert k == pytest.approx(best, rel=1e-3) and loss == pytest.approx(of(k), rel=1e-9)
    assert L.credibility(rows.filter("false"), priors, "points")[0] != L.credibility(rows.filter("false"), priors, "points")[0]


def test_the_best_credibility_is_told_from_one_pass(spark):
    from closeline.operators import players as L

    rows = spark.createDataFrame([(i % 3, 10.0 + i % 7, 5.0 + i % 4, 80.0 + i, 40.0 + i) for i in range(300)], "bucket int, minutes double, points double, prior_minutes double, bank_points double")
    out = L.credibility_losses(rows, L.role_priors(rows, ["points"]), "points", [1.0, 10.0, 100.0]).collect()
    assert [r["best"] for r in out].count(True) == 1 and min(out, key=lambda r: r["loss"])["best"]


def _worked_out(spark, make):
    """How often the rows behind a result were made, with the result's rows."""
    made = spark.sparkContext.accumulator(0)

    def rows(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    base = spark.range(60, numPartitions=1).select(F.col("id").alias("event_id"), F.expr("date '2024-01-01' + cast(id % 20 as int)").alias("slate_date"), (F.col("id") % 2).cast("double").alias("won"), ((F.col("id") % 7) / 50).alias("edge"),
                                  (0.3 + (F.col("id") % 11) / 50).alias("model_implied"), (0.3 + (F.col("id") % 5) / 50).alias("market_implied"), (F.col("id") % 3 - 1.0).alias("profit_units"))
    out = make(base.mapInArrow(rows, base.schema)).collect()
    return made.value, out


def test_rows_of_a_regression_and_of_buckets_are_made_once(spark):
    from closeline.operators import calibration as K

    made, out = _worked_out(spark, lambda d: K.ols_clustered(d, "won", ["market_implied", "edge"], {"game": "event_id", "day": "slate_date"}, [0.0, 1.0, 0.0]))
    assert made == 60 and len(out) == 3
    made, out = _worked_out(spark, K.edge_buckets)
    assert made == 60 and sum(r["rows"] for r in out) == 60
