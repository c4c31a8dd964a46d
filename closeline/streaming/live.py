"""Captures and results as streams.

Each operator has a batch twin in ``operators``; the streaming form only says how state
is bounded (watermarks, the last stored capture) and when a row is final.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from closeline.operators import captures as M, quotes as Q
from closeline.sources import payloads as J, stores as S

IDENTITY = ("captured_at", *Q.QUOTE_IDENTITY)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def capture_stream(spark: SparkSession, path: str, schema: T.StructType, delay: str = "2 days") -> DataFrame:
    """Capture files as they arrive, each canonical identity once within the watermark."""
    rows = S.with_identity(spark.readStream.schema(schema).parquet(path).withWatermark("captured_at", delay), IDENTITY)
    return rows.dropDuplicatesWithinWatermark(S.identity_columns(rows)).select(*schema.fieldNames())


def payload_stream(spark: SparkSession, path: str, delay: str = "2 days") -> DataFrame:
    """Polled payload files staged to board rows, stamped by the file's modification time."""
    raw = spark.readStream.schema(J.QUOTE_SCHEMA).json(path).select("*", F.col("_metadata.file_modification_time").alias("captured_at"))
    return J.stage(raw.withWatermark("captured_at", delay), carry=["captured_at"])


def start(frame: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True):
    """Run a micro-batch function over a stream; ``once`` drains what is there."""
    writer = frame.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="30 seconds").start()


def append_sink(path: str, schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """Idempotent append: a replayed batch adds nothing."""

    def each(batch: DataFrame, _batch_id: int) -> None:
        S.append_capture(batch, path, schema)

    return each


def _arrive(batch: DataFrame, store_path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame, list]:
    """Add a batch to the store. What there is to judge: rows of the batch's captures and
    of those next to them, all stored captures with their next one, and the batch's stamps.

    A capture may come in several batches, late, or again: its rows are judged as the
    store then has them.
    """
    spark = batch.sparkSession
    touched = [r[0] for r in batch.select("captured_at").distinct().collect()]  # captures of one micro-batch
    S.append_capture(batch.select(*schema.fieldNames()).dropDuplicates(list(IDENTITY)), store_path, schema)
    store = S.read_store(spark, store_path, schema)
    stamps = M.next_stamps(store)
    near = stamps.filter(F.col("captured_at").isin(touched) | F.col("next_capture").isin(touched))
    wanted = near.select(F.explode(F.array("captured_at", "next_capture")).alias("captured_at")).distinct()
    return store.join(wanted, "captured_at", "left_semi"), stamps, touched


def _replace(rows: DataFrame, captures: list, out_path: str) -> None:
    """One folder per capture; judging a capture again replaces it, also by nothing."""
    rows = rows.persist()
    try:
        for at in captures:
            rows.filter(F.col("captured_at") == F.lit(at)).write.mode("overwrite").parquet(f"{out_path}/capture={at:%Y%m%dT%H%M%S.%f}")
    finally:
        rows.unpersist()


def survival_sink(store_path: str, out_path: str, schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """Survival counts of each capture and the next: a batch re-judges the pairs that its
    captures begin, end or split, however the captures are dealt to batches."""

    def each(batch: DataFrame, _batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows, stamps, touched = _arrive(batch, store_path, schema)
        pairs = stamps.filter("next_capture is not null").filter(F.col("captured_at").isin(touched) | F.col("next_capture").isin(touched))
        begun = [r[0] for r in pairs.select("captured_at").collect()]
        _replace(M.survival(rows), begun, out_path)

    return each


def alert_sink(store_path: str, out_path: str, schema: T.StructType, edge: float = Q.ALERT_EDGE) -> Callable[[DataFrame, int], None]:
    """New edges of every capture against the capture before it, however they arrive."""

    def each(batch: DataFrame, _batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows, stamps, touched = _arrive(batch, store_path, schema)
        after = [r[0] for r in stamps.filter(F.col("captured_at").isin(touched)).select("next_capture").collect() if r[0] is not None]
        found = Q.alerts_by_capture(Q.shops(Q.fair_board(rows)), stamps, edge)
        _replace(found, sorted({*touched, *after}), out_path)

    return each


def _with_state(frame: DataFrame) -> DataFrame:
    """State of own operators with timers needs the RocksDB store: it is set on the session before the query starts."""
    frame.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return frame


class ClosingState(StatefulProcessor):
    """Keeps an event's consensus at its last capture before the start; says it once.

    State is one row per event. The event-time timer at the start emits and clears it.
    """

    FIELDS = ("captured_us", "close_moneyline", "close_spread", "close_total", "start_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "captured_us long, close_moneyline double, close_spread double, close_total double, start_us long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get() if self.last.exists() else None
        for batch in rows:
            batch = batch[batch["captured_us"] <= batch["start_us"]]
            if not len(batch):
                continue
            top = batch.loc[batch["captured_us"].idxmax()]
            if held is None or top["captured_us"] >= held[0]:
                clean = lambda v: None if pd.isna(v) else float(v)
                held = (int(top["captured_us"]), clean(top["moneyline"]), clean(top["spread"]), clean(top["total_points"]), int(top["start_us"]))
        if held is not None:
            fresh = not self.last.exists()
            self.last.update(held)
            if fresh:
                self.handle.registerTimer(max(held[4] // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(columns=["event_id", *self.FIELDS[:4]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            held = self.last.get()
            self.last.clear()
            yield pd.DataFrame([(key[0], *held[:4])], columns=["event_id", *self.FIELDS[:4]])

    def close(self) -> None:
        pass


def closing_stream(consensus: DataFrame) -> DataFrame:
    """Closing numbers of each event, emitted once when the watermark passes its start.

    Input: event_id (long), captured_at (with a watermark), commence_time, moneyline,
    spread, total_points: the consensus of a capture, one row per event and capture.
    """
    rows = consensus.withColumns({"captured_us": F.unix_micros(F.col("captured_at").cast("timestamp")), "start_us": F.unix_micros(F.col("commence_time").cast("timestamp"))})
    return _with_state(rows).groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=ClosingState(), outputStructType="event_id long, captured_us long, close_moneyline double, close_spread double, close_total double",
        outputMode="Append", timeMode="EventTime")


class MoveState(StatefulProcessor):
    """Keeps the consensus of an event's first capture; says every later one against it.

    State is one row per event. The event-time timer at the start clears it; a start that
    is moved back moves the timer.
    """

    COLUMNS = ("event_id", "captured_us", "first_us", "market", "opened", "now")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "captured_us long, moneyline double, spread double, total_points double, timer_ms long")

    def handleInputRows(self, key, rows, timerValues):
        # The aggregate before lets captures go in the order of the watermark; within a batch they are sorted here.
        seen = pd.concat(list(rows)).sort_values("captured_us")
        held, said = (self.first.get() if self.first.exists() else None), []
        clean = lambda v: None if pd.isna(v) else float(v)
        for row in seen[seen["captured_us"] <= seen["start_us"]].to_dict("records"):
            values = [clean(row[m]) for m in Q.MAIN_MARKETS]
            if held is None:
                held = (int(row["captured_us"]), *values, -1)
            else:
                said += [(key[0], int(row["captured_us"]), int(held[0]), m, a, b) for m, a, b in zip(Q.MAIN_MARKETS, held[1:4], values) if a is not None and b is not None]
            timer = max(int(row["start_us"]) // 1000, timerValues.getCurrentWatermarkInMs()) + 1
            if timer > held[4]:
                if held[4] >= 0:
                    self.handle.deleteTimer(held[4])
                self.handle.registerTimer(timer)
                held = (*held[:4], timer)
        if held is not None:
            self.first.update(held)
        yield pd.DataFrame(said, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.first.clear()
        yield pd.DataFrame(columns=self.COLUMNS)

    def close(self) -> None:
        pass


def move_stream(captures: DataFrame) -> DataFrame:
    """Consensus of each capture against the event's first one, as a capture is complete.

    Two stateful operators in one query: the consensus of a capture is an aggregate that
    ends when the watermark of ``captured_at`` passes it, and behind it stands the state of
    the event. Input: quotes with a watermark on captured_at, and commence_time.
    """
    every = M.capture_consensus(captures)
    rows = every.withColumns({"captured_us": F.unix_micros(F.col("captured_at").cast("timestamp")), "start_us": F.unix_micros(F.col("commence_time").cast("timestamp"))})
    return _with_state(rows).groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=MoveState(), outputStructType="event_id long, captured_us long, first_us long, market string, opened double, now double",
        outputMode="Append", timeMode="EventTime")


def settle_stream(quotes: DataFrame, results: DataFrame, wait_days: int = 14) -> DataFrame:
    """Quotes joined to their result within the wait; a quote whose result never comes
    leaves with nulls when the watermark passes, and is then unsettleable.

    Both sides need watermarks: ``frozen_at`` and ``final_at``.
    """
    bound = F.expr(f"final_at >= frozen_at and final_at <= frozen_at + interval {wait_days} days")
    q, r = quotes.alias("q"), results.alias("r")
    joined = q.join(r, (F.col("q.event_id") == F.col("r.game_id")) & bound, "leftOuter")
    state = F.when(F.col("r.game_id").isNull(), "unsettleable").otherwise("result")
    return joined.select("q.*", "r.margin", "r.final_at", state.alias("state"))


def daily_freeze(captures: DataFrame, keys: Sequence[str] = S.FREEZE_IDENTITY) -> DataFrame:
    """One board per day window: each wager at its first capture, at the best price there."""
    first = F.struct(F.col("captured_at"), -F.col("payout"), F.col("american_odds"))
    return captures.groupBy(F.window("captured_at", "1 day"), *keys).agg(F.min_by("american_odds", first).alias("american_odds"), F.count("*").alias("quotes")).select(
        F.to_date("window.start").alias("snapshot_date"), *keys, "american_odds", "quotes")


def first_last_moves(captures: DataFrame, gap: str = "3 days") -> DataFrame:
    """First and last value per event and market in a session of captures."""
    at = F.col("captured_at")
    return captures.groupBy(F.session_window("captured_at", gap), "event_id", "market").agg(
        F.min_by("line", at).alias("opened"), F.max_by("line", at).alias("now"), F.count("*").alias("captures")).select(
        "event_id", "market", F.col("session_window.start").alias("first_at"), "opened", "now", "captures")


def settle_once_sink(ledger_path: str, schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """Graded rows reach the ledger once per identity, however often a day is settled."""

    def each(batch: DataFrame, _batch_id: int) -> None:
        S.append_ledger(batch, ledger_path, schema)

    return each
