"""Quotes from capture to capture: survival, consensus, moves, closing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from closeline import session
from closeline.functions import prices as P, text as T
from closeline.operators import intervals as I, quotes as Q, segments as G

MARGIN_SD, TOTAL_SD, TEAM_TOTAL_SD = 11.0, 16.0, 9.7
HIGH_HOLD = ("alternate_spread", "alternate_total_points", "team_total")
MAIN_OF = {
    "moneyline": "moneyline", "spread": "spread", "alternate_spread": "spread",
    "total_points": "total_points", "alternate_total_points": "total_points",
}
FIGHT_SHRINK, MIN_MOVE_PROB, MIN_MOVE_POINTS = 0.5, 0.02, 1.0
ALARM_ROWS, ALARM_GAMES = 100, 20
MIN_CAPTURES, MIN_JUDGED = 2, 1000


def next_stamps(store: DataFrame) -> DataFrame:
    """Each capture stamp and the one after it, found month by month. Stamps are as many as polls, not quotes."""
    stamps = store.select("captured_at").filter("captured_at is not null").distinct()
    return G.next_row(stamps, [], ["captured_at"], {"next_capture": F.col("captured_at")}, F.trunc("captured_at", "month"))


def label_next(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Add ``next_capture`` and ``label`` to rows, whose ``captured_at`` may be null for the first sighting.

    unknown: no next capture, or it does not cover the event's market; survived: the
    identity, price included, is there; gone otherwise. The store is reduced to one row
    per identity, and one per event and market, with the captures that show it: these
    are the polls of one event, and one join answers both the first sighting and the next.
    """
    identity = list(Q.QUOTE_IDENTITY)
    shown = lambda keys, name: store.groupBy(*keys).agg(F.collect_set("captured_at").alias(name))
    work = rows.join(shown(identity, "__seen"), identity, "left").withColumn("captured_at", F.coalesce("captured_at", F.array_min("__seen")))
    work = work.join(F.broadcast(next_stamps(store)), "captured_at", "left").withColumn("__there", F.array_contains("__seen", F.col("next_capture"))).drop("__seen")
    work = work.join(shown(["event_id", "market"], "__covered"), ["event_id", "market"], "left")
    label = (
        F.when(F.coalesce(F.array_contains("__covered", F.col("next_capture")), F.lit(False)), F.when(F.col("__there"), "survived").otherwise("gone"))
        .otherwise("unknown")
    )
    return work.withColumn("label", label).drop("__there", "__covered")


def survival(store: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Survived, gone and unknown quotes per consecutive capture pair and extra keys.

    Each distinct quote of a capture speaks twice: it is there at its own capture, and
    it is looked for at the next one. Grouping both by identity and capture answers the
    looking without a join; whether the event's market was covered at all is the same
    question one level up.
    """
    canonical = Q.normalise_identity(store)
    extra = [c for c in by if c not in Q.QUOTE_IDENTITY]
    counted = canonical.groupBy("captured_at", *Q.QUOTE_IDENTITY, *extra).agg(F.count("*").alias("n"))
    work = counted.join(next_stamps(store), "captured_at", "left")
    said = F.array(F.struct(F.col("captured_at").alias("slot"), F.lit(True).alias("here"), F.lit(None).cast(store.schema["captured_at"].dataType).alias("asked_at"), F.lit(0).cast("long").alias("asks")),
                   F.struct(F.col("next_capture").alias("slot"), F.lit(False).alias("here"), F.col("captured_at").alias("asked_at"), F.col("n").alias("asks")))
    rows = work.select(*Q.QUOTE_IDENTITY, *extra, F.inline(said)).filter("slot is not null")
    # Presence is of the quote, whatever else (a tier) the asking row carries.
    per = rows.groupBy(*Q.QUOTE_IDENTITY, "slot").agg(
        F.max("here").alias("here"), F.max("asked_at").alias("asked_at"), *([F.sum("asks").alias("asks")] if not extra else
        [F.collect_set(F.when(F.col("asks") > 0, F.struct(*extra, "asks"))).alias("said")]))
    if extra:
        # One element per value of the extra keys a quote was asked under.
        per = per.select(*Q.QUOTE_IDENTITY, "slot", "here", "asked_at", F.inline_outer("said")).na.fill(0, ["asks"])
    held, missed = F.when(F.col("here"), F.col("asks")).otherwise(0), F.when(F.col("here"), 0).otherwise(F.col("asks"))
    keys = ["event_id", "market", *[c for c in by if c not in ("event_id", "market")]]
    sums = per.groupBy(*keys, "slot").agg(F.max("here").alias("here"), F.max("asked_at").alias("captured_at"), F.sum(held).alias("held"), F.sum(missed).alias("missed"))
    if len(keys) > 2:
        # From the store itself: asking ``per`` would work it out twice.
        covered = canonical.select("event_id", "market", F.col("captured_at").alias("slot"), F.lit(True).alias("covered")).distinct()
        sums = sums.join(covered, ["event_id", "market", "slot"], "left").na.fill(False, ["covered"])
    else:
        sums = sums.withColumn("covered", F.col("here"))
    asked = sums.filter("held + missed > 0").withColumnRenamed("slot", "next_capture")
    known = lambda c, name: F.sum(F.when(F.col("covered"), F.col(c)).otherwise(0)).alias(name)
    out = asked.groupBy("captured_at", "next_capture", *by).agg(known("held", "survived"), known("missed", "gone"), F.sum(F.when(F.col("covered"), 0).otherwise(F.col("held") + F.col("missed"))).alias("unknown"))
    return out.withColumn("rate", F.try_divide(F.col("survived"), F.col("survived") + F.col("gone")))


def label_bets(bets: DataFrame, store: DataFrame) -> DataFrame:
    """Add ``reachability`` to staked quotes; an unstamped one takes its first sighting."""
    staked = Q.normalise_identity(bets, Q.QUOTE_IDENTITY)
    if "captured_at" not in bets.columns:
        staked = staked.withColumn("captured_at", F.lit(None).cast(store.schema["captured_at"].dataType))
    return label_next(staked, Q.normalise_identity(store)).withColumnRenamed("label", "reachability").drop("next_capture")


def store_summary(store: DataFrame) -> DataFrame:
    """Counts of a capture store, with judged quotes and the evidence flag."""
    judged = survival(store).agg(F.coalesce(F.sum(F.col("survived") + F.col("gone")), F.lit(0)).alias("judged_quotes"))
    counts = store.agg(
        F.count("*").alias("quotes"), F.countDistinct("captured_at").alias("captures"), F.min("captured_at").alias("first_capture"),
        F.max("captured_at").alias("last_capture"), F.countDistinct("event_id").alias("events"), F.countDistinct("book").alias("books"),
        F.countDistinct("slate_date").alias("slate_days"))
    out = counts.crossJoin(F.broadcast(judged))
    return out.withColumn("enough_evidence", (F.col("captures") >= MIN_CAPTURES) & (F.col("judged_quotes") >= MIN_JUDGED))


def _full_game(store: DataFrame) -> DataFrame:
    return store.filter(F.col("segment").isin(*Q.FULL_GAME) & (T.clean_text("player") == ""))


def consensus(rows: DataFrame) -> DataFrame:
    """Per event and capture: median home probability, spread and total over books.

    Lines are multiples of a half, so their exact median keeps few counters; the
    moneyline is one pair per book.
    """
    keys = ["event_id", "captured_at"]
    main = _full_game(rows).filter(F.col("market").isin(*Q.MAIN_MARKETS))
    line = lambda m, s: F.percentile(F.when((F.col("market") == m) & (F.col("selection") == s), P.number("line")), F.lit(0.5))
    by_book = main.groupBy(*keys, "book").agg(
        *[F.max_by(P.implied("american_odds"), F.when((F.col("market") == "moneyline") & (F.col("selection") == s), P.payout("american_odds"))).alias(s) for s in ("home", "away")])
    money = by_book.groupBy(*keys).agg(F.percentile(F.col("home") / (F.col("home") + F.col("away")), F.lit(0.5)).alias("moneyline"))
    lines = main.groupBy(*keys).agg(line("spread", "home").alias("spread"), line("total_points", "over").alias("total_points"))
    return lines.join(money, keys)


def capture_consensus(rows: DataFrame) -> DataFrame:
    """The consensus of each capture of an event in one aggregate, so that a stream can take it too.

    Same values as ``consensus``; a capture without main markets has nulls. The pairs of
    a capture's moneyline (books times sides) are the only rows gathered. Carries the
    latest commence_time that the capture names.
    """
    market, selection = F.col("market"), F.col("selection")
    line = lambda m, s: F.percentile(F.when((market == m) & (selection == s), P.number("line")), F.lit(0.5))
    money = F.when((market == "moneyline") & selection.isin("home", "away"), F.struct("book", "selection", P.payout("american_odds").alias("payout"), P.implied("american_odds").alias("chance")))
    per = _full_game(rows).groupBy("event_id", "captured_at").agg(
        F.max("commence_time").alias("commence_time"), line("spread", "home").alias("spread"), line("total_points", "over").alias("total_points"), F.collect_set(money).alias("__money"))
    best = lambda book, s: F.array_max(F.transform(F.filter("__money", lambda m: (m["book"] == book) & (m["selection"] == s)), lambda m: F.struct(m["payout"].alias("p"), m["chance"].alias("c"))))["c"]
    shares = F.transform(F.array_distinct(F.transform("__money", lambda m: m["book"])), lambda book: best(book, "home") / (best(book, "home") + best(book, "away")))
    ordered = F.sort_array(F.filter(shares, lambda x: x.isNotNull()))
    n = F.size(ordered)
    at = lambda i: F.try_element_at(ordered, i.cast("int"))
    median = F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2.0)
    return per.select("event_id", "captured_at", "commence_time", median.alias("moneyline"), "spread", "total_points")


def moves_by_capture(store: DataFrame) -> DataFrame:
    """Consensus of every capture up to the start against that of the event's first one, per market.

    Rows where both are known. The stream's rows are these, whatever the batches.
    """
    every = capture_consensus(store.filter("captured_at <= commence_time"))
    first = every.groupBy("event_id").agg(F.min_by(F.struct(F.col("captured_at").alias("at"), *Q.MAIN_MARKETS), "captured_at").alias("f"))
    later = every.join(first, "event_id").filter("captured_at > f.at")
    rows = later.select("event_id", "captured_at", F.col("f.at").alias("first_at"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("market"), F.col(f"f.{m}").alias("opened"), F.col(m).alias("now")) for m in Q.MAIN_MARKETS])))
    return rows.filter("opened is not null and now is not null")


def closing_consensus(store: DataFrame) -> DataFrame:
    """Consensus at the last capture at or before the start, one row per event."""
    before = store.filter(F.col("captured_at") <= F.col("commence_time"))
    last = _full_game(before).groupBy("event_id").agg(F.max("captured_at").alias("last"))
    every = consensus(before)
    values = F.struct("moneyline", "spread", "total_points")
    closed = every.groupBy("event_id").agg(F.max_by(values, "captured_at").alias("v"), F.max("captured_at").alias("closed_at"))
    return closed.join(last, "event_id").filter(F.col("closed_at") == F.col("last")).select(
        "event_id", "closed_at", F.col("v.moneyline").alias("close_moneyline"), F.col("v.spread").alias("close_spread"), F.col("v.total_points").alias("close_total"))


def with_closing(rows: DataFrame, closing: DataFrame) -> DataFrame:
    """Join the closing numbers of the event; add ``close_chance`` and ``clv``.

    The chance is the normal tail at the closing line; its standardised argument is a
    column of its own, so the distribution function is written once in the plan. The
    closing value is in the market's own unit: points of line, or probability.
    """
    joined = rows.join(closing, "event_id", "left")
    market, selection, line = F.col("market"), F.col("selection"), P.number("line")
    ml, spread, total = F.col("close_moneyline"), F.col("close_spread"), F.col("close_total")
    home, away = selection == "home", selection == "away"
    turned = F.when(selection.endswith("over"), 1.0).when(selection.endswith("under"), -1.0)
    centre = F.when(selection.startswith("home_"), (total - spread) / 2.0).when(selection.startswith("away_"), (total + spread) / 2.0)
    is_spread, is_total = market.isin("spread", "alternate_spread"), market.isin("total_points", "alternate_total_points")
    z = (
        F.when(is_spread & home, (line - spread) / MARGIN_SD).when(is_spread & away, (line + spread) / MARGIN_SD)
        .when(is_total & selection.isin("over", "under"), turned * (total - line) / TOTAL_SD)
        .when((market == "team_total") & selection.contains("_"), turned * (centre - line) / TEAM_TOTAL_SD)
    )
    staged = joined.withColumns({"__z": z, "__quoted": P.implied("american_odds")})
    money = F.when(home, ml).when(away, 1.0 - ml)
    staged = staged.withColumn("close_chance", F.when(market == "moneyline", money).when(F.col("__z").isNotNull(), P.normal_cdf("__z")))
    value = (
        F.when(market.isin(*HIGH_HOLD), F.col("close_chance") - F.col("__quoted"))
        .when(market == "moneyline", money - F.col("__quoted"))
        .when((market == "spread") & home, line - spread).when((market == "spread") & away, line + spread)
        .when((market == "total_points") & selection.isin("over", "under"), turned * (total - line))
    )
    return staged.withColumn("clv", value).drop("__z", "__quoted")


def leans(ledger: DataFrame, threshold: float = P.EDGE_THRESHOLD) -> DataFrame:
    rows = _full_game(ledger).filter(F.col("market").isin(*Q.MAIN_MARKETS, *HIGH_HOLD) & (F.trim(F.coalesce("outcome", F.lit(""))) != ""))
    return rows.filter(P.number("edge") >= threshold)


def closing_alarm(ledger: DataFrame, store: DataFrame, looks: int = 1) -> DataFrame:
    """Mean closing value per tier and market, with the alarm when it is surely negative."""
    rows = label_bets(leans(ledger), store)
    close = closing_consensus(store).withColumn("event_id", F.col("event_id").cast("string"))
    rows = with_closing(rows, close)
    hit = lambda v: F.count_if(F.col("reachability") == v).alias(v)
    counts = rows.groupBy("tier", "market").agg(
        F.count("*").alias("leans"), F.count("clv").alias("graded"), F.countDistinct(F.when(F.col("clv").isNotNull(), F.col("event_id"))).alias("games"),
        hit("survived"), hit("gone"), hit("unknown"),
        F.try_divide(F.count_if(F.col("clv") > 0), F.count("clv")).alias("beat_close"))
    cells = I.interval(rows, [["tier", "market"]], {"game": "event_id"}, "clv", looks)
    out = counts.join(cells.select("tier", "market", F.col("roi").alias("mean"), F.col("adjusted_low").alias("low"), F.col("adjusted_high").alias("high")), ["tier", "market"], "left")
    alarm = (F.col("graded") >= ALARM_ROWS) & (F.col("games") >= ALARM_GAMES) & (F.col("high") < 0)
    return out.withColumn("alarm", F.coalesce(alarm, F.lit(False)))


def moves(store: DataFrame, as_of: Column | None = None) -> DataFrame:
    """First against last capture consensus per event and market, two captures at least."""
    rows = store if as_of is None else store.filter(F.col("captured_at") <= as_of)
    every = consensus(rows)
    stamps = _full_game(rows).groupBy("event_id").agg(F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))
    values = F.struct("captured_at", "moneyline", "spread", "total_points")
    ends = every.groupBy("event_id").agg(F.min_by(values, "captured_at").alias("a"), F.max_by(values, "captured_at").alias("b"))
    both = ends.join(stamps, "event_id").filter("a.captured_at = first_at and b.captured_at = last_at and first_at < last_at")
    unpivoted = both.select("event_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("market"), F.col(f"a.{m}").alias("opened"), F.col(f"b.{m}").alias("now")) for m in Q.MAIN_MARKETS])))
    return unpivoted.filter("opened is not null and now is not null")


def toward(opened: Column, now: Column) -> Column:
    """Movement towards the wager's side: positive when the market agreed."""
    change = now - opened
    selection, market = F.col("selection"), F.col("market")
    sign = (
        F.when(market == "moneyline", F.when(selection == "home", 1.0).when(selection == "away", -1.0))
        .when(market.contains("spread"), F.when(selection == "home", -1.0).when(selection == "away", 1.0))
        .otherwise(F.when(selection == "over", 1.0).when(selection == "under", -1.0))
    )
    return sign * change


def with_moves(wagers: DataFrame, move_rows: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in MAIN_OF.items() for x in kv])
    keyed = wagers.withColumn("__main", F.try_element_at(table, F.col("market")))
    joined = keyed.join(move_rows.withColumnRenamed("market", "__main"), ["event_id", "__main"], "left").drop("__main")
    bar = F.when(F.col("market") == "moneyline", MIN_MOVE_PROB).otherwise(MIN_MOVE_POINTS)
    return joined.withColumn("toward", toward(F.col("opened"), F.col("now"))).withColumn("move_bar", bar)


def advice() -> Column:
    return F.when(F.col("toward") >= F.col("move_bar"), "now").otherwise("near tip")


def restrained(trusted: Column, market: Column) -> Column:
    """Halve a positive lean the market moved against by at least the bar."""
    lean = trusted - market
    against = (lean > 0) & (F.col("toward") <= -F.col("move_bar"))
    return F.when(against, market + FIGHT_SHRINK * lean).otherwise(trusted)


def line_history(store: DataFrame) -> DataFrame:
    """Per event and capture: best home moneyline, modal spread and total; events with
    at least two captures; opening values from the first one."""
    main = _full_game(store)
    pick = lambda m, s: F.when((F.col("market") == m) & (F.col("selection") == s), F.col("line"))
    price = F.when((F.col("market") == "moneyline") & (F.col("selection") == "home"), F.col("american_odds"))
    per = main.groupBy("event_id", "captured_at").agg(
        F.max(price).alias("home_price"), F.mode(pick("spread", "home"), True).alias("spread_line"), F.mode(pick("total_points", "over"), True).alias("total_line"))
    ends = per.groupBy("event_id").agg(F.count("*").alias("captures"), F.min_by(F.struct("home_price", "spread_line", "total_line"), "captured_at").alias("open"))
    return per.join(ends, "event_id").filter("captures >= 2").select(
        "event_id", "captured_at", "home_price", "spread_line", "total_line", "captures",
        F.col("open.home_price").alias("open_price"), F.col("open.spread_line").alias("open_spread"), F.col("open.total_line").alias("open_total"))


def first_capture_of_day(store: DataFrame) -> DataFrame:
    return store.groupBy("slate_date").agg(F.min("captured_at").alias("first_capture"))


def opening_split(bets: DataFrame, store: DataFrame, looks: int = 1) -> DataFrame:
    """Return of bets taken at their day's first capture against later ones."""
    joined = bets.join(first_capture_of_day(store), "slate_date", "left")
    tagged = joined.withColumn("taken", F.when(F.col("captured_at") == F.col("first_capture"), "at first capture").otherwise("later"))
    return I.interval(tagged, [["taken"]], {"game": "event_id", "day": "slate_date"}, "profit_units", looks)


def reachability_split(bets: DataFrame, looks: int = 1, by: str = "tier") -> DataFrame:
    """Return by group and survival, and pooled over groups, in one pass."""
    return I.interval(bets, [[by, "reachability"], ["reachability"]], {"game": "event_id", "day": "slate_date"}, "profit_units", looks).withColumn(
        by, F.when(F.col("grouping") == 1, "pooled").otherwise(F.col(by)))


def reachability_verdict(split: DataFrame, by: str = "tier") -> DataFrame:
    """One verdict per group from its survived and gone cells."""
    cell = lambda label, c: F.max(F.when(F.col("reachability") == label, F.col(c)))
    out = split.groupBy(by).agg(
        cell("survived", "verdict").alias("s"), cell("gone", "verdict").alias("g"),
        F.coalesce(cell("survived", "bets"), F.lit(0)).alias("survived_bets"), F.coalesce(cell("gone", "bets"), F.lit(0)).alias("gone_bets"),
        F.coalesce(cell("unknown", "bets"), F.lit(0)).alias("unknown_bets"))
    verdict = (
        F.when(F.col("s") == "demonstrated edge", "reachable in surviving prices")
        .when(F.col("g") == "demonstrated edge", "not reachable")
        .when((F.col("survived_bets") < I.MINIMUM_BETS) & (F.col("gone_bets") < I.MINIMUM_BETS), "not enough evidence")
        .otherwise("no demonstrated edge")
    )
    return out.select(by, "survived_bets", "gone_bets", "unknown_bets", verdict.alias("verdict"))


def trust_posterior(seed: float, pairs: DataFrame, closes: DataFrame | None = None) -> DataFrame:
    """Ridge slope of result on disagreement, pulled to a prior, plus the closing term."""
    penalty = 2000.0 * 0.01
    d, r = F.col("model_probability") - F.col("market_implied"), F.col("won") - F.col("market_implied")
    sums = pairs.agg(F.coalesce(F.sum(d * r), F.lit(0.0)).alias("dr"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("dd"), F.count("*").alias("settled"))
    if closes is None:
        both = sums.withColumns({"cdr": F.lit(0.0), "cdd": F.lit(0.0), "closed": F.lit(0)})
    else:
        c = F.col("close") - F.col("market_implied")
        late = closes.agg(F.coalesce(F.sum(d * c), F.lit(0.0)).alias("cdr"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("cdd"), F.count("*").alias("closed"))
        both = sums.crossJoin(F.broadcast(late))
    weight = (penalty * seed + F.col("dr") + 4.0 * F.col("cdr")) / (penalty + F.col("dd") + 4.0 * F.col("cdd"))
    return both.withColumn("weight", P.clamp(weight, 0.0, 1.0))
