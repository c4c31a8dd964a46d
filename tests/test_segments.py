"""Segmented scans against plain windows and numpy, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from closeline.operators import history as H, players as L, segments as G


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 20, n)), "day": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n), "D"),
        "id": rng.permutation(n), "x": rng.normal(size=n)})
    pdf["day"] = pdf["day"].dt.date
    pdf.loc[pdf.index % 13 == 0, "x"] = np.nan
    frame = spark.createDataFrame(pdf, "k long, day date, id long, x double")
    return frame.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("k", F.when(F.col("k") != 5, F.col("k"))).cache()


def test_running_before_equals_the_window(spark, skewed):
    w = W.partitionBy("k").orderBy("day", "id").rowsBetween(W.unboundedPreceding, -1)
    plain = skewed.withColumn("s", F.coalesce(F.sum("x").over(w), F.lit(0.0))).withColumn("n", F.coalesce(F.count("x").over(w), F.lit(0)))
    split = G.running_before(skewed, ["k"], ["day", "id"], {"s": F.col("x"), "n": F.when(F.col("x").isNotNull(), 1)}, [F.col("day"), F.floor(F.col("id") / 500)])
    a, b = plain.select("id", "s", "n").toPandas().set_index("id").sort_index(), split.select("id", "s", "n").toPandas().set_index("id").sort_index()
    assert len(a) == len(b) == 4000
    np.testing.assert_allclose(a["s"], b["s"], atol=1e-9)
    assert (a["n"] == b["n"]).all()


def test_previous_and_next_row(spark, skewed):
    w = W.partitionBy("k").orderBy("day", "id")
    plain = skewed.withColumns({"p": F.lag("id").over(w), "f": F.lead("id").over(w)})
    split = G.next_row(G.previous_row(skewed, ["k"], ["day", "id"], {"p": F.col("id")}, F.col("day")), ["k"], ["day", "id"], {"f": F.col("id")}, F.col("day"))
    key = lambda d: sorted((r["id"], r["p"], r["f"]) for r in d.select("id", F.coalesce("p", F.lit(-1)).alias("p"), F.coalesce("f", F.lit(-1)).alias("f")).collect())
    assert key(plain) == key(split)


def test_exact_quantiles(spark, skewed):
    got = {r["k"]: (r["q0"], r["q1"], r["q2"]) for r in G.exact_quantiles(skewed, ["k"], "x", [0.1, 0.5, 0.9], cuts=4).collect()}
    for k, part in skewed.toPandas().groupby("k", dropna=False):
        want = part["x"].dropna().quantile([0.1, 0.5, 0.9]).tolist()
        assert got[None if pd.isna(k) else int(k)] == pytest.approx(want, abs=1e-12)


def test_exact_quantile_without_keys_and_with_ties(spark):
    frame = spark.createDataFrame([(float(i // 7),) for i in range(1000)], "x double")
    assert G.exact_quantiles(frame, [], "x", [0.5]).first()[0] == pytest.approx(np.quantile([i // 7 for i in range(1000)], 0.5))


def test_prior_means_do_not_see_the_future(spark, skewed):
    rows = skewed.withColumnsRenamed({"day": "slate_date", "id": "game_id"})
    whole = H.prior_means(rows, ["k"], ["x"]).filter("slate_date < '2024-01-20'").select("game_id", F.round("prior_x", 9))
    cut = H.prior_means(H.before(rows, "2024-01-20"), ["k"], ["x"]).select("game_id", F.round("prior_x", 9))
    assert sorted(map(tuple, whole.na.fill(-9.0).collect())) == sorted(map(tuple, cut.na.fill(-9.0).collect()))


def test_trailing_mean_over_many_blocks(spark):
    """History far longer than one block of 128 half-lives, absences included."""
    rng = np.random.default_rng(5)
    n, half = 3000, 2.0
    pdf = pd.DataFrame({"season": 1, "athlete_id": 1, "slate_date": (pd.Timestamp("2000-01-01") + pd.to_timedelta(np.arange(n), "D")).date, "row_key": np.arange(n),
                        "did_not_play": rng.random(n) < 0.2, "minutes": rng.uniform(1, 40, n)})
    for c in L.STATS:
        pdf[c] = rng.integers(0, 9, n)
    out = L.with_trailing(spark.createDataFrame(pdf), half_lives=(half,)).orderBy("row_key").toPandas()
    played = ~pdf["did_not_play"]
    ewm = pdf["minutes"].where(played)[played].ewm(halflife=half).mean().reindex(pdf.index).shift(1).ffill()
    np.testing.assert_allclose(out["projected_minutes"].iloc[50:], ewm.iloc[50:], rtol=1e-12)
    assert (out["prior_games"] == played.cumsum().shift(1).fillna(0)).all()


def test_as_of_equals_the_search(spark):
    """Newest right row at or before each left row, by key; ties, null keys, null times, strict or not."""
    rng = np.random.default_rng(12)
    key = lambda n: [None if k == 4 else int(k) if k else 1 for k in np.where(rng.random(n) < 0.6, 0, rng.integers(2, 9, n))]
    stamp = lambda n: [None if t == 77 else int(t) for t in rng.integers(0, 400, n)]
    left = [(i, k, t) for i, (k, t) in enumerate(zip(key(800), stamp(800)))]
    right = [(k, t, int(v), None if v % 5 == 0 else f"v{v}") for k, t, v in zip(key(300), stamp(300), rng.integers(0, 1000, 300))] + [(30, 5, 1, "a")]
    a = spark.createDataFrame(left, "id long, k long, at long")
    b = spark.createDataFrame(right, "k long, at long, v long, w string")
    for strict in (False, True):
        for width in (1, 7, 1000):
            got = {r["id"]: (r["v"], r["w"], r["found"]) for r in G.as_of(a, b, ["k"], "at", ["v", "w"], [F.floor(F.col("at") / width)], strict, "found").collect()}
            assert len(got) == 800
            for i, k, t in left:
                seen = [] if t is None else [(s, v, w or "", w) for q, s, v, w in right if q == k and s is not None and (s < t or (s == t and not strict))]
                best = max(seen, default=None)
                assert got[i] == ((None, None, None) if best is None else (best[1], best[3], best[0]))


def test_as_of_of_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 1, 5)], "id long, k long, at long"), spark.createDataFrame([], "k long, at long, v long")
    assert [tuple(r) for r in G.as_of(a, b, ["k"], "at", ["v"], [F.col("at")]).collect()] == [(1, 1, 5, None)]
    assert G.as_of(a.filter("false"), a.select("k", "at", F.col("id").alias("v")), ["k"], "at", ["v"], [F.col("at")]).count() == 0


def test_as_of_has_no_range_join_and_no_window_over_a_key(spark, skewed):
    plan = G.as_of(skewed, skewed.select("k", "day", F.col("id").alias("v")), ["k"], "day", ["v"], [F.trunc("day", "month")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "<=" not in plan.replace("<=>", "")


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_equal_the_window(spark, skewed, descending):
    rows = skewed.withColumn("y", F.round("x", 1)).filter("k is null or k < 12")
    w = W.partitionBy("k").orderBy(F.col("y").desc_nulls_last() if descending else F.col("y").asc_nulls_last())
    plain = rows.withColumn("rank", F.when(F.col("y").isNotNull(), F.rank().over(w))).withColumn("field", F.count("y").over(W.partitionBy("k")))
    pick = lambda d: sorted((r["id"], r["rank"] or 0, r["field"]) for r in d.collect())
    assert pick(G.ranked(rows, ["k"], "y", descending, cuts=5)) == pick(plain)
    assert G.ranked(rows.filter("false"), ["k"], "y").count() == 0


def test_parts_of_a_shuffle_are_cut_by_size(spark):
    from closeline import session

    session.ensure(spark)
    rows = spark.range(400_000).select((F.col("id") % 200_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        assert rows.groupBy("k").agg(F.max("x").alias("x")).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        session.ensure(spark)
