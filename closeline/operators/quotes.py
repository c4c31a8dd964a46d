"""Quotes and wagers: identity, best prices, pairing, margin removal, boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from closeline.functions import prices as P, text as T

QUOTE_IDENTITY = ("event_id", "market", "segment", "player", "selection", "line", "book", "american_odds")
PRICE_IDENTITY = ("slate_date", "event_id", "market", "segment", "player", "selection", "line", "book")
SELECTIONS = ("home", "away", "over", "under", "home_over", "home_under", "away_over", "away_under")
MAIN_MARKETS = ("moneyline", "spread", "total_points")
SEGMENTS = ("game", "h1", "h2")
FULL_GAME = ("game", "full_game")
MIN_BOOKS = 3
SHOP_EDGE, ALERT_EDGE = 0.02, 0.03
MIN_GRADED = 30


def normalise_identity(frame: DataFrame, columns: Sequence[str] = QUOTE_IDENTITY) -> DataFrame:
    """Identity columns as canonical text; a missing one is empty."""
    kinds = {f.name: f.dataType for f in frame.schema}
    texts = [c for c in columns if c in kinds and kinds[c].typeName() == "string"]
    if not texts:
        return frame.withColumns({c: T.canonical_value(c, kinds[c]) if c in kinds else F.lit("") for c in columns})
    staged = frame.withColumn("__texts", T.canonical_texts(texts))
    exprs = {c: F.col("__texts")[texts.index(c)] if c in texts else T.canonical_value(c, kinds[c]) if c in kinds else F.lit("") for c in columns}
    return staged.withColumns(exprs).drop("__texts")


def best_by(frame: DataFrame, keys: Sequence[Column], rank: Sequence[Column]) -> DataFrame:
    """The top row of each key, as a partial aggregate: a hot key is reduced map-side."""
    row = F.struct(*[F.col(c) for c in frame.columns])
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return frame.groupBy(*named).agg(F.max_by(row, F.struct(*rank)).alias("__r")).select("__r.*")


def dedupe_prices(frame: DataFrame, tie: str, odds: str = "american_odds") -> DataFrame:
    """Best payout per full price identity; the earliest row (``tie``) on equal payouts."""
    keys = [F.col(c) for c in PRICE_IDENTITY if c in frame.columns]
    return best_by(frame, keys, [P.ranked_payout(odds), -F.col(tie)])


def best_price_per_wager(frame: DataFrame, tie: str, odds: str = "american_odds") -> DataFrame:
    """Best payout per wager over all books; names compare after folding."""
    keys = [T.normalise_subject(c) if c == "player" else F.col(c)
            for c in PRICE_IDENTITY if c != "book" and c in frame.columns]
    return best_by(frame, keys, [P.ranked_payout(odds), -F.col(tie)])


def one_bet_per_wager(frame: DataFrame, tie: str, phase: str | None = None) -> DataFrame:
    """Best quote per wager of a single price window; more than one window refuses."""
    best = best_price_per_wager(dedupe_prices(frame, tie), tie)
    if phase is None:
        return best
    seen = frame.agg(F.min(phase).alias("__lo"), F.max(phase).alias("__hi"))
    check = F.assert_true(F.col("__lo") == F.col("__hi"), "prices of more than one window")
    return best.crossJoin(F.broadcast(seen)).filter(F.coalesce(check.cast("string"), F.lit("ok")) == "ok").drop("__lo", "__hi")


def refusal_reason(frame: DataFrame, markets: DataFrame) -> DataFrame:
    """Add ``refusal``: the first reason a price row cannot become a wager, or ''.

    ``markets`` is the registry of known market keys, a fixed list: it goes to the rows,
    which would else be dealt by market into as many tasks as there are markets.
    """
    known = F.broadcast(markets.select(F.col("market"), F.lit(True).alias("__known")))
    joined = frame.join(known, "market", "left")
    odds = P.number("american_odds")
    reason = (
        F.when(F.col("__known").isNull(), "unknown market")
        .when(~F.coalesce(F.col("segment"), F.lit("")).isin(*SEGMENTS), "unknown segment")
        .when(~F.coalesce(F.col("selection"), F.lit("")).isin(*SELECTIONS), "unknown selection")
        .when(odds.isNull() | (odds == 0), "unreadable price")
        .when((T.clean_text("event_id") == "") | (T.clean_text("home_team") == "") | (T.clean_text("away_team") == ""), "no event or team")
        .when(F.col("slate_date").isNull(), "no key")
        .otherwise("")
    )
    return joined.select(*frame.columns, reason.alias("refusal"))


def build_wagers(frame: DataFrame, markets: DataFrame) -> DataFrame:
    """One row per wager with its quotes; refused rows stay out.

    A wager's array holds one best quote per book and price, so its length is bounded
    by books times prices, not by how often the quote was seen.
    """
    accepted = refusal_reason(frame, markets).filter(F.col("refusal") == "")
    keys = ["slate_date", "event_id", "market", "segment", "player", "selection", "line"]
    quotes = accepted.groupBy(*keys, "book", "american_odds").agg(F.count("*").alias("seen"))
    return quotes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("book", "american_odds", "seen"))).alias("quotes"),
        F.sum("seen").alias("rows"))


def pair_columns(scope_book: bool = False) -> dict[str, Column]:
    """Columns that the two sides of one question share; ``pair_line`` null = no pairing."""
    selection, line = F.col("selection"), P.number("line")
    handicap = selection.isin("home", "away")
    total = selection.isin("over", "under", "home_over", "home_under", "away_over", "away_under")
    oriented = F.when(selection == "away", -F.coalesce(line, F.lit(0.0))).when(selection == "home", F.coalesce(line, F.lit(0.0)))
    out = {
        "pair_kind": F.when(handicap, "handicap").when(total, "total"),
        "pair_side": F.when(selection.contains("_"), F.substring_index(selection, "_", 1)).otherwise(F.lit("")),
        # adding zero turns a negative zero into zero, so that both sides agree
        "pair_line": F.round(F.when(handicap, oriented).when(total, line), 6) + 0.0,
        # by a lambda, which keeps the generated method short enough to be compiled
        "pair_player": F.element_at(F.transform(F.array("player"), lambda x: F.lower(T.clean_text(x))), 1),
    }
    if scope_book:
        out["pair_book"] = T.clean_text("book")
    return out


def complement(selection: Column) -> Column:
    return (
        F.when(selection == "home", "away").when(selection == "away", "home")
        .when(selection.endswith("over"), F.regexp_replace(selection, "over$", "under"))
        .when(selection.endswith("under"), F.regexp_replace(selection, "under$", "over"))
    )


def devig(frame: DataFrame, scope: str = "wager", power: bool = False) -> DataFrame:
    """Margin-free probabilities of two-sided groups, with a refusal for every other row.

    Adds ``market_implied_raw``, ``overround``, ``market_implied`` (proportional), with
    ``power`` also ``fair_power`` and ``devig_exponent``, and ``refusal`` ('' = devigged).
    The pair is found by a map-side aggregate that keeps counts and the extremes only,
    so a group of any size costs one row; its rows are then joined to that one row.
    """
    by_book = scope == "book"
    pairs = pair_columns(by_book)
    raw = F.element_at(F.transform(F.array("american_odds"), P.implied), 1)
    work = frame.withColumns({**pairs, "market_implied_raw": raw})
    # No line for a pair without a kind, so the line tells both.
    unknown = F.col("pair_line").isNull()
    keys = ["event_id", "market", "segment", *pairs]
    usable = ~unknown & F.col("market_implied_raw").isNotNull()
    # Numbers only, so that the sums are hashed on both sides of the shuffle.
    first = F.col("selection").isin("home", "over") | F.col("selection").endswith("_over")
    # Each side's price in a column of its own: the generated method stays short enough to be compiled.
    sided = work.filter(usable).select(*keys, "market_implied_raw", first.alias("__first"))
    sided = sided.select(*keys, F.when(F.col("__first"), F.col("market_implied_raw")).alias("__a"), F.when(~F.col("__first"), F.col("market_implied_raw")).alias("__b"))
    groups = sided.groupBy(*keys).agg(F.count("*").alias("__n"), F.count("__a").alias("__n0"), F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    two_sided = (F.col("__n") == 2) & (F.col("__n0") == 1)
    total = F.col("__a") + F.col("__b")
    groups = groups.withColumn("__total", total)
    if power:
        groups = groups.withColumn("__exp", F.when(two_sided & (F.col("__total") > 1.0), P.power_exponent("__a", "__b")))
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    joined = work.alias("w").join(groups.alias("g"), on + [F.col("w.market_implied_raw").isNotNull()], "left")
    good = two_sided & (F.col("__total") > 1.0)
    if power:
        good = good & F.col("__exp").isNotNull()
    refusal = (
        F.when(F.col("w.pair_line").isNull(), "unknown selection")
        .when(F.col("w.market_implied_raw").isNull(), "unreadable price")
        .when(F.col("__n") == 1, "no complement")
        .when(~two_sided, "not two sided")
        .when(~(F.col("__total") > 1.0), "overround not above one")
        .when(F.lit(power) & ~good, "power unsolved")
        .otherwise("")
    )
    out = [F.col(f"w.{c}") for c in frame.columns] + [
        F.col("w.market_implied_raw"),
        F.when(good, F.col("__total")).alias("overround"),
        F.when(good, F.col("w.market_implied_raw") / F.col("__total")).alias("market_implied"),
    ]
    if power:
        out += [F.when(good, F.pow(F.col("w.market_implied_raw"), F.col("__exp"))).alias("fair_power"),
                F.when(good, F.col("__exp")).alias("devig_exponent")]
    return joined.select(*out, refusal.alias("refusal"))


def fair_board(store: DataFrame, min_books: int = MIN_BOOKS) -> DataFrame:
    """Consensus fair probability and best price per capture, event, market, line, side."""
    selection = F.col("selection")
    first = selection.isin("home", "over")
    line = P.number("line")
    pair_line = F.when(F.col("market") == "moneyline", F.lit(0.0)).otherwise(F.coalesce(
        F.when((F.col("market") == "spread") & (selection == "away"), -line).otherwise(line), F.lit(0.0))) + 0.0
    rows = (
        store.filter(F.col("market").isin(*MAIN_MARKETS) & F.col("segment").isin(*FULL_GAME))
        .filter(T.clean_text("player") == "")
        .filter(F.col("captured_at") < F.col("commence_time"))
        .filter(selection.isin("home", "over", "away", "under"))
        .withColumn("decimal", P.decimal_price("american_odds"))
        .filter(F.col("decimal").isNotNull())
        .withColumn("pair_line", pair_line)
        .withColumn("first_side", first)
    )
    keys = ["captured_at", "event_id", "market", "pair_line"]
    # One row per book first: what follows is bounded by the number of books.
    per_book = rows.groupBy(*keys, "book").agg(
        F.max(F.when(F.col("first_side"), F.col("decimal"))).alias("a"),
        F.max(F.when(~F.col("first_side"), F.col("decimal"))).alias("b"),
        F.max_by(F.struct("american_odds", "line", "selection", "commence_time"), F.when(F.col("first_side"), F.col("decimal"))).alias("ra"),
        F.max_by(F.struct("american_odds", "line", "selection", "commence_time"), F.when(~F.col("first_side"), F.col("decimal"))).alias("rb"),
    )
    per_book = per_book.withColumn("devig", P.power_fair(1.0 / F.col("a"), 1.0 / F.col("b")))
    fair = per_book.groupBy(*keys).agg(
        F.percentile("devig", F.lit(0.5)).alias("fair_first"), F.count("devig").alias("books"),
        F.max_by(F.struct("a", "book", "ra"), F.struct("a", F.col("book"))).alias("best_a"),
        F.max_by(F.struct("b", "book", "rb"), F.struct("b", F.col("book"))).alias("best_b"),
    ).filter(F.col("books") >= min_books)
    side = lambda s, r, p: F.struct(
        F.col(f"best_{s}.{r}.selection").alias("selection"), F.col(f"best_{s}.{r}.line").alias("line"),
        F.col(f"best_{s}.{r}.commence_time").alias("commence_time"), p.alias("fair"),
        F.col(f"best_{s}.{s}").alias("best_decimal"), F.col(f"best_{s}.{r}.american_odds").cast("double").alias("best_american"),
        F.col(f"best_{s}.book").alias("best_book"))
    return fair.select(*keys, "books", F.inline(F.array(side("a", "ra", F.col("fair_first")), side("b", "rb", 1.0 - F.col("fair_first")))))


def shops(board: DataFrame, edge: float = SHOP_EDGE, allowed: Sequence[str] | None = None) -> DataFrame:
    out = board.withColumn("shop_edge", F.col("fair") * F.col("best_decimal") - 1.0)
    out = out.filter((F.col("shop_edge") >= edge) & P.in_price_band("best_american"))
    return out.filter(F.col("market").isin(*allowed)) if allowed is not None else out


def latest(board: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the board's newest capture (one value, broadcast)."""
    newest = board.agg(F.max("captured_at").alias("captured_at"))
    return rows.join(F.broadcast(newest), "captured_at", "left_semi")


SIDE = ("event_id", "market", "pair_line", "selection")


def alerts(board: DataFrame, shop_rows: DataFrame, edge: float = ALERT_EDGE) -> DataFrame:
    """Large edges at the newest capture that the capture before did not show."""
    stamps = board.select("captured_at").distinct().orderBy(F.col("captured_at").desc()).limit(2)
    newest = stamps.agg(F.max("captured_at").alias("captured_at"), F.count("*").alias("n"), F.min("captured_at").alias("prev"))
    big = shop_rows.filter(F.col("shop_edge") >= edge)
    now = big.join(F.broadcast(newest.select("captured_at")), "captured_at", "left_semi")
    before = big.join(F.broadcast(newest.filter("n = 2").select(F.col("prev").alias("captured_at"))), "captured_at", "left_semi")
    return now.join(before.select(*SIDE, "best_book").distinct(), [*SIDE, "best_book"], "left_anti")


def alerts_by_capture(shop_rows: DataFrame, stamps: DataFrame, edge: float = ALERT_EDGE) -> DataFrame:
    """Large edges of every capture that the capture before it did not show.

    ``stamps`` has each capture (captured_at) and the one after it (next_capture).
    """
    big = shop_rows.filter(F.col("shop_edge") >= edge)
    shown = big.select("captured_at", *SIDE, "best_book").distinct().join(stamps.filter("next_capture is not null"), "captured_at")
    return big.join(shown.drop("captured_at").withColumnRenamed("next_capture", "captured_at"), ["captured_at", *SIDE, "best_book"], "left_anti")


def graded_shops(board: DataFrame, shop_rows: DataFrame, now: Column | None = None) -> DataFrame:
    """First sighting of each side against its last quote; a stale close stays null."""
    fields = [c for c in shop_rows.columns if c not in SIDE]
    first = shop_rows.groupBy(*SIDE).agg(F.min_by(F.struct(*fields), "captured_at").alias("f")).select(*SIDE, "f.*")
    if now is not None:
        first = first.filter(F.col("commence_time") <= now)
    close = board.groupBy(*SIDE).agg(F.max_by("fair", "captured_at").alias("close_fair"), F.max("captured_at").alias("closed_at"))
    final = board.groupBy("event_id").agg(F.max("captured_at").alias("final_capture"))
    joined = first.join(close, list(SIDE), "left").join(final, "event_id", "left")
    stale = (F.col("closed_at") != F.col("final_capture")) | (F.col("closed_at") <= F.col("captured_at"))
    joined = joined.withColumn("close_fair", F.when(~stale, F.col("close_fair")))
    return joined.withColumn("clv", F.col("close_fair") * F.col("best_decimal") - 1.0)


def market_probabilities(wagers: DataFrame, min_books: int = MIN_BOOKS) -> DataFrame:
    """Median over books of the pairwise fair probability of each wager side."""
    best = wagers.groupBy("event_id", "market", "segment", "player", "selection", "line", "book").agg(
        F.max_by("american_odds", P.ranked_payout("american_odds")).alias("american_odds"))
    keyed = best.withColumns(pair_columns(True)).withColumn("raw", P.implied("american_odds")).filter("pair_line is not null and raw is not null")
    keys = ["event_id", "market", "segment", "pair_player", "pair_kind", "pair_side", "pair_line", "pair_book"]
    pair = keyed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("selection").rlike("^home$|over$"), F.struct("raw", "selection"))).alias("a"),
        F.max(F.when(~F.col("selection").rlike("^home$|over$"), F.struct("raw", "selection"))).alias("b")).filter("n = 2")
    fair = pair.withColumn("fair", P.power_fair("a.raw", "b.raw")).filter("fair is not null")
    return fair.groupBy(*[k for k in keys if k != "pair_book"]).agg(
        F.percentile("fair", F.lit(0.5)).alias("fair_first"), F.count("*").alias("books")).filter(F.col("books") >= min_books)


def dominated_quotes(wagers: DataFrame) -> DataFrame:
    """Quotes of a ladder that pay less than an easier rung at the same book.

    Going over gets harder as the line rises, going under and taking points as it
    falls. Rungs are reduced to their best payout first; the comparison is then a
    running maximum over the rungs of one ladder, never all pairs of its quotes.
    """
    easier_first = F.when(F.col("selection").endswith("over"), P.number("line")).otherwise(-P.number("line"))
    ladder = ["event_id", "market", "segment", "player", "selection", "book"]
    keyed = wagers.withColumn("__rung", easier_first).withColumn("payout", P.payout("american_odds")).filter("__rung is not null and payout is not null")
    rungs = keyed.groupBy(*ladder, "__rung").agg(F.max("payout").alias("best"), F.max_by("line", "payout").alias("l"))
    before = W.partitionBy(*ladder).orderBy("__rung").rowsBetween(W.unboundedPreceding, -1)
    rungs = rungs.withColumn("easier", F.max(F.struct(F.col("best"), F.col("l"))).over(before))
    joined = keyed.join(rungs.select(*ladder, "__rung", "easier"), [*ladder, "__rung"])
    return joined.filter(F.col("easier.best") > F.col("payout")).select(
        *wagers.columns, F.col("easier.l").alias("easier_line"), F.col("easier.best").alias("easier_payout"))


def main_lines(quotes: DataFrame, ladders: Sequence[str]) -> DataFrame:
    """Most quoted home-oriented line of each event and market; lowest line on ties."""
    line = P.number("line")
    oriented = F.when(F.col("selection") == "away", -line).otherwise(line) + 0.0
    counts = (
        quotes.filter(F.col("market").isin(*ladders) & F.col("segment").isin(*FULL_GAME))
        .withColumn("home_line", oriented).filter("home_line is not null")
        .groupBy("event_id", "market", "home_line").agg(F.count("*").alias("n"))
    )
    return counts.groupBy("event_id", "market").agg(
        F.max_by("home_line", F.struct("n", -F.col("home_line"))).alias("main_line"), F.max("n").alias("quotes"))


def within_rung_cap(quotes: DataFrame, mains: DataFrame, ladders: dict[str, str], cap: float | None) -> DataFrame:
    """Drop ladder quotes farther than ``cap`` from the main line of their event."""
    if cap is None:
        return quotes
    pairs = F.create_map(*[F.lit(x) for kv in ladders.items() for x in kv])
    line = P.number("line")
    oriented = F.when(F.col("selection") == "away", -line).otherwise(line)
    centre = mains.select(F.col("event_id"), F.col("market").alias("__main"), "main_line")
    work = quotes.withColumn("__main", F.try_element_at(pairs, F.col("market")))
    joined = work.join(centre, ["event_id", "__main"], "left")
    far = F.abs(oriented - F.col("main_line")) > cap
    return joined.filter(~F.coalesce(far, F.lit(False))).select(*quotes.columns)


def ladder_steps(frame: DataFrame) -> DataFrame:
    """Each rung's steps along its ladder from the rung whose median price is nearest evens.

    Prices are counted first, so that a rung of any size is a row per different price; its
    exact median comes from running counts. One shuffle of these rows places all that follows.
    """
    over = F.lower(F.trim(F.col("selection"))) == "over"
    raw = P.implied("american_odds")
    keys = ["event_id", "market", "__subject"]
    rows = frame.select("event_id", "market", "player", P.number("line").alias("__line"), F.when(over, raw).otherwise(1.0 - raw).alias("__price"))
    counted = rows.filter("__line is not null").groupBy(*rows.columns).agg(F.count("__price").alias("__n"))
    counted = counted.withColumn("__subject", T.normalise_subject("player")).drop("player").repartition(*keys)
    rung = W.partitionBy(*keys, "__line")
    upto = F.sum("__n").over(rung.orderBy("__price").rowsBetween(W.unboundedPreceding, W.currentRow))
    counted = counted.withColumns({"__upto": upto, "__all": F.sum("__n").over(rung)})
    place = (F.col("__all") - 1) / 2
    reached = lambda at: F.min(F.when(F.col("__upto") > at, F.col("__price")))
    rungs = counted.groupBy(*keys, "__line").agg(reached(F.floor(place)).alias("__low"), reached(F.ceil(place)).alias("__high"))
    median = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(0.5 * F.col("__low") + 0.5 * F.col("__high"))
    ladder = W.partitionBy(*keys)
    placed = rungs.withColumn("__p", median).withColumn("__pos", F.row_number().over(ladder.orderBy("__line")))
    placed = placed.withColumns({
        "__money": F.min_by("__pos", F.when(F.col("__p").isNotNull(), F.struct(F.abs(F.col("__p") - 0.5), "__pos"))).over(ladder),
        "__len": F.max("__pos").over(ladder), "__priced": F.count("__p").over(ladder)})
    centre = F.when(F.col("__priced") > 0, F.col("__money")).otherwise(F.floor((F.col("__len") - 1) / 2) + 1)
    return placed.select(*keys, "__line", F.abs(F.col("__pos") - centre).cast("double").alias("rungs"))


def rungs_from_the_money(frame: DataFrame, ladders: DataFrame | None = None) -> DataFrame:
    """Steps along its ladder between a quote's rung and the rung priced nearest evens.

    ``ladders`` are the quotes the ladders are made of, where ``frame`` holds the same rows
    with costly columns beside them.
    """
    distance = ladder_steps(frame if ladders is None else ladders)
    work = frame.withColumn("__subject", T.normalise_subject("player")).withColumn("__line", P.number("line"))
    out = work.join(distance, ["event_id", "market", "__subject", "__line"], "left")
    return out.select(*frame.columns, F.col("rungs").alias("rungs_from_the_money"))


def bar_of(wagers: DataFrame, approved: Sequence[str], threshold: float = P.EDGE_THRESHOLD,
           band: tuple[float, float] = P.PRICE_BAND) -> DataFrame:
    """Per wager: best playable edge and the first bar that stops it ('' = cleared)."""
    keys = ["slate_date", "event_id", "market", "segment", "player", "selection", "line"]
    ev = P.expected_value("model_probability", "american_odds")
    clears = ev >= threshold
    playable = clears & P.in_price_band("american_odds", band)
    grouped = wagers.groupBy(*keys).agg(
        F.max("model_probability").alias("probability"), F.count("*").alias("quotes_seen"),
        F.max(F.when(clears, 1).otherwise(0)).alias("__clears"),
        F.max_by(F.struct("american_odds", "book"), F.when(playable, F.struct(ev, F.col("book"), F.col("american_odds")))).alias("__best"),
        F.max(F.when(playable, ev)).alias("edge"), F.max("tip_state").alias("tip_state"), F.max("availability").alias("availability"))
    bar = (
        F.when(~F.col("market").isin(*approved), "not_approved")
        .when(F.col("probability").isNull(), "no_opinion")
        .when(F.col("__clears") == 0, "below_threshold")
        .when(F.col("edge").isNull(), "outside_price_band")
        .when((F.col("player") != "") & (F.col("availability") == "out"), "availability")
        .when(F.col("tip_state") != "upcoming", "start_guard")
        .otherwise("")
    )
    return grouped.select(*keys, "probability", "quotes_seen", "edge", F.col("__best.american_odds").alias("american_odds"),
                          F.col("__best.book").alias("book"), bar.alias("bar"))


def exposure_caps(barred: DataFrame, per_event: int = 1, per_slate: int = 20) -> DataFrame:
    """Best ``per_event`` cleared wagers of an event, then ``per_slate`` of a slate.

    Ranks are taken by edge and a full key. Both limits are top-k filters, which the
    engine applies before the shuffle as well as after it.
    """
    label = F.concat_ws("|", "market", "segment", "player", "selection", F.coalesce(F.col("line").cast("string"), F.lit("")))
    cleared = barred.filter(F.col("bar") == "").withColumn("label", label)
    order = [F.col("edge").desc(), F.col("label").asc()]
    per = cleared.withColumn("__e", F.row_number().over(W.partitionBy("slate_date", "event_id").orderBy(*order))).filter(F.col("__e") <= per_event)
    ranked = per.withColumn("slate_rank", F.row_number().over(W.partitionBy("slate_date").orderBy(*order, F.col("event_id")))).filter(F.col("slate_rank") <= per_slate)
    return ranked.drop("__e")
