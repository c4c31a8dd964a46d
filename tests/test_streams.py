"""Streams against their batch twins."""

import tempfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from closeline.operators import captures as M, quotes as Q
from closeline.streaming import live as V
from closeline.plans.views import Tables

from test_stores import SCHEMA

SMALL = "/root/testdata/sf0.001"
BOARD = T.StructType([f for f in SCHEMA.fields if f.name not in ("slate_date", "captured_at")])


def tmp():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_survival_stream_equals_the_batch(spark):
    board = Tables(spark, SMALL).board.select(*SCHEMA.fieldNames())
    store, out, source = tmp() + "/store", tmp() + "/out", tmp()
    stamps = sorted(r[0] for r in board.select("captured_at").distinct().collect())
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    sink, check = V.survival_sink(store, out, SCHEMA), tmp()
    for part in (stamps[:5], stamps[5:6], stamps[6:]):
        board.filter(F.col("captured_at").isin(part)).coalesce(1).write.mode("append").parquet(source)
        V.start(stream, check, sink).awaitTermination()
    key = lambda d: sorted(map(tuple, d.select("captured_at", "next_capture", "survived", "gone", "unknown").collect()))
    # The stream keeps each identity once, so the batch twin sees it once too.
    assert key(spark.read.parquet(out)) == key(M.survival(board.distinct()))


def batches(board, stamps, how):
    """The same captures dealt to micro-batches in several ways."""
    whole = [board.filter(F.col("captured_at") == at) for at in stamps]
    if how == "one batch":
        return [board]
    if how == "late":
        return [whole[i] for i in sorted(range(len(whole)), key=lambda i: (i % 2, i))]
    return [board.filter((F.col("captured_at") == at) & (F.abs(F.hash("event_id", "selection", "book")) % 2 == k)) for at in stamps for k in (0, 1)]


@pytest.mark.parametrize("how", ["one batch", "late", "halves"])
def test_sinks_do_not_depend_on_the_batches(spark, how):
    board = Tables(spark, SMALL).board
    schema = T.StructType([*SCHEMA.fields, T.StructField("commence_time", board.schema["commence_time"].dataType)])
    board = board.select(*schema.fieldNames()).distinct()
    stamps = sorted(r[0] for r in board.select("captured_at").distinct().collect())[:4]
    board = board.filter(F.col("captured_at").isin(stamps)).persist()
    survival, alerts = tmp() + "/out", tmp() + "/out"
    sinks = V.survival_sink(tmp() + "/store", survival, schema), V.alert_sink(tmp() + "/store", alerts, schema, 0.02)
    for i, part in enumerate(batches(board, stamps, how)):
        for sink in sinks:
            sink(part, i)
    key = lambda d: sorted(map(tuple, d.select("captured_at", "next_capture", "survived", "gone", "unknown").collect()))
    assert key(spark.read.parquet(survival)) == key(M.survival(board))
    side = lambda d: sorted(map(str, d.select("captured_at", *Q.SIDE, "best_book").collect()))
    want = side(Q.alerts_by_capture(Q.shops(Q.fair_board(board)), M.next_stamps(board), 0.02))
    assert want and side(spark.read.parquet(alerts)) == want


@pytest.mark.parametrize("how", ["one batch", "each capture", "halves"])
def test_move_stream_equals_the_batch(spark, how):
    """Consensus, then the state of the event, in one streaming query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    board = Tables(spark, SMALL).board.filter("event_id <= 6")
    board = board.select("captured_at", "commence_time", *[f.name for f in BOARD.fields]).withColumns({c: F.col(c).cast("timestamp") for c in ("captured_at", "commence_time")}).distinct()
    stamps = sorted(r[0] for r in board.select("captured_at").distinct().collect())[:5]
    board = board.filter(F.col("captured_at").isin(stamps)).persist()
    source = tmp()
    parts = [board] if how == "one batch" else [board.filter(F.col("captured_at") == at) for at in stamps] if how == "each capture" else batches(board, stamps, how)
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{source}/p{i:03}")
    # Far captures of other events let the watermark pass all others.
    after = board.limit(1).withColumns({"event_id": F.lit(99).cast("long"), "captured_at": F.lit(datetime(2030, 1, 1)), "commence_time": F.lit(datetime(2031, 1, 1))})
    for i in range(2):
        after.withColumn("captured_at", F.lit(datetime(2030 + i, 1, 1))).coalesce(1).write.parquet(f"{source}/q{i}")
    stream = spark.readStream.schema(board.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source).withWatermark("captured_at", "1 day")
    got = []
    V.start(V.move_stream(stream), tmp(), lambda b, i: got.extend(map(tuple, b.collect()))).awaitTermination()
    micros = lambda c: F.unix_micros(c)
    want = M.moves_by_capture(board).select("event_id", micros("captured_at"), micros("first_at"), "market", "opened", "now").collect()
    close = lambda rows: sorted((*r[:4], round(r[4], 9), round(r[5], 9)) for r in rows)
    assert want and close(got) == close(map(tuple, want))


def test_move_state_ends_with_the_start(spark):
    """Captures after the start say nothing, and the state is gone then; ties of a capture's books count once each."""
    schema = T.StructType([T.StructField("captured_at", T.TimestampType()), T.StructField("commence_time", T.TimestampType())] + BOARD.fields)
    hour = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    quote = lambda at, start, event, line, book: (hour(at), hour(start), event, "spread", "game", "", "home", line, book, 110.0)
    parts = [[quote(0, 10, 1, 2.0, "a"), quote(0, 10, 1, 3.0, "b"), quote(0, 10, 1, 3.0, "c")], [quote(5, 12, 1, 4.0, "a"), quote(5, 12, 1, 5.0, "b")],
             [quote(11, 12, 1, 6.0, "a")], [quote(13, 12, 1, 9.0, "a")], [quote(40, 99, 2, 1.0, "a")], [quote(60, 99, 2, 2.5, "a")], [quote(90, 99, 3, 0.0, "a")], [quote(95, 99, 3, 0.0, "a")]]
    source = tmp()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/p{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source).withWatermark("captured_at", "1 hour")
    got = []
    V.start(V.move_stream(stream), tmp(), lambda b, i: got.extend(b.collect())).awaitTermination()
    assert sorted((r["event_id"], r["opened"], r["now"]) for r in got if r["event_id"] < 3) == [(1, 3.0, 4.5), (1, 3.0, 6.0), (2, 1.0, 2.5)]


def test_capture_stream_drops_repeats(spark):
    source = tmp()
    schema = T.StructType([T.StructField("captured_at", T.TimestampType())] + BOARD.fields)
    at = datetime(2024, 1, 1, 12)
    row = (at, 1, "spread", "game", "", "home", 2.5, "b", 110.0)
    spark.createDataFrame([row, row, (at, 2, *row[2:])], schema).coalesce(1).write.mode("append").parquet(source)
    got = []
    V.start(V.capture_stream(spark, source, schema), tmp(), lambda b, i: got.extend(b.collect())).awaitTermination()
    assert sorted(r["event_id"] for r in got) == [1, 2]


def test_closing_stream_says_each_event_once(spark):
    schema = "event_id long, captured_at timestamp, commence_time timestamp, moneyline double, spread double, total_points double"
    base = datetime(2024, 1, 1)
    hour = lambda h: base + timedelta(hours=h)
    source = tmp()
    rows = [[(1, hour(1), hour(10), 0.5, -1.0, 140.0), (2, hour(1), hour(30), 0.4, 2.0, None)], [(1, hour(9), hour(10), 0.6, -2.0, 141.0), (1, hour(11), hour(10), 0.9, -9.0, 150.0)],
            [(2, hour(20), hour(30), 0.45, 1.5, 139.0)], [(3, hour(60), hour(90), 0.5, 0.0, 1.0)], [(4, hour(70), hour(90), 0.5, 0.0, 1.0)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/p{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source).withWatermark("captured_at", "1 hour")
    got = []
    V.start(V.closing_stream(stream), tmp(), lambda b, i: got.extend(b.collect())).awaitTermination()
    found = {r["event_id"]: (r["close_moneyline"], r["close_spread"], r["close_total"]) for r in got}
    assert len(got) == len(found)
    assert found[1] == (0.6, -2.0, 141.0) and found[2] == (0.45, 1.5, 139.0)


def test_late_results_leave_as_unsettleable(spark):
    q, r = tmp(), tmp()
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    spark.createDataFrame([(1, day(0)), (2, day(0)), (9, day(60))], "event_id long, frozen_at timestamp").coalesce(1).write.mode("append").parquet(q)
    spark.createDataFrame([(1, day(3), 5.0), (2, day(20), 7.0), (9, day(61), 1.0)], "game_id long, final_at timestamp, margin double").coalesce(1).write.mode("append").parquet(r)
    quotes = spark.readStream.schema("event_id long, frozen_at timestamp").parquet(q).withWatermark("frozen_at", "1 day")
    results = spark.readStream.schema("game_id long, final_at timestamp, margin double").parquet(r).withWatermark("final_at", "1 day")
    got = []
    V.start(V.settle_stream(quotes, results), tmp(), lambda b, i: got.extend(b.collect())).awaitTermination()
    assert {x["event_id"]: (x["state"], x["margin"]) for x in got} == {1: ("result", 5.0), 2: ("unsettleable", None), 9: ("result", 1.0)}


def test_ledger_rows_settle_once(spark):
    path = tmp() + "/ledger"
    schema = T.StructType([T.StructField("snapshot_date", T.DateType())] + BOARD.fields + [T.StructField("outcome", T.StringType())])
    rows = spark.createDataFrame([(date(2024, 1, 1), 1, "spread", "game", "Ann", "home", 2.5, "b", 110.0, "won")], schema)
    sink = V.settle_once_sink(path, schema)
    sink(rows, 0)
    sink(rows.withColumn("player", F.lit("ANN ")), 1)
    assert spark.read.parquet(path).count() == 1
