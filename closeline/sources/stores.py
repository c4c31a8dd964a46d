"""Stores on shared storage: declared reads, idempotent appends, versions, feeds.

Stores are partitioned parquet. An append reads only the identity columns of the
partitions it touches, keeps what is new by an anti-join and adds files; nothing is
rewritten, so an interrupted job can run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from closeline.functions import text as X
from closeline.operators import quotes as Q, segments as G

LEDGER_IDENTITY = ("snapshot_date", "event_id", "market", "segment", "player", "selection", "line", "book")
FREEZE_IDENTITY = ("event_id", "market", "segment", "player", "selection", "line")
FIRST_SEASON = 2003
MOST_HEADERS = 100


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def declared(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns: missing ones are null, an undeclared one that holds
    data stops the job (empty ones are dropped)."""
    have = set(frame.columns)
    extra = [c for c in frame.columns if c not in schema.fieldNames()]
    out = frame.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields], *[F.col(c).alias(f"__x_{c}") for c in extra])
    for c in extra:
        out = out.filter(F.when(F.col(f"__x_{c}").isNull(), True).otherwise(F.raise_error(F.lit(f"undeclared column {c} holds data"))))
    return out.select(*schema.fieldNames())


def read_store(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    return declared(reader.format(fmt).load(path), schema)


def capture_lines(lines: DataFrame, schema: T.StructType, must: Sequence[str] = ("event_id", "market")) -> DataFrame:
    """Rows of capture files in CSV, from (file, value): a line each, in any order.

    A file's header is its line that names the ``must`` columns; columns are matched by name,
    file by file, a missing one is null and an unknown one is left out. Ids stay text.
    ``bad_record`` holds a line that doesn't fit: too few or too many fields, a value that
    isn't of its type, or a file without a header. Lines are records: quoted line breaks are
    not read. The headers told apart (formats of the file over time) come to the driver.
    """
    names = F.transform(F.split("value", ","), lambda c: F.lower(F.trim(F.translate(c, '"\ufeff\r', ""))))
    named = lines.filter(F.length(F.trim("value")) > 0).withColumn("__names", names)
    heads = named.filter(F.forall(F.array(*[F.lit(m) for m in must]), lambda m: F.array_contains("__names", m)))
    first = heads.groupBy("file").agg(F.min("__names").alias("__header"))
    kinds = first.select("__header").distinct().limit(MOST_HEADERS + 1).collect()
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    # One row per file goes to the lines: dealt by file, the largest file would be one task.
    rows = named.join(F.broadcast(first), "file", "left").filter(F.col("__header").isNull() | (F.col("__names") != F.col("__header")))
    typed = {f.name: "string" if f.name == "event_id" else f.dataType.simpleString() for f in schema.fields}
    out = [rows.filter("__header is null").select("file", *[F.lit(None).cast(k).alias(c) for c, k in typed.items()], F.col("value").alias("bad_record"))]
    for kind in kinds:
        header = list(kind["__header"])
        fields = ", ".join(f"`__{i}` {typed.get(c, 'string') if header.index(c) == i else 'string'}" for i, c in enumerate(header))
        parsed = rows.filter(F.col("__header") == F.array(*[F.lit(c) for c in header])).select("file", F.from_csv(F.regexp_replace("value", "\r$", ""), f"{fields}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
        values = [(F.col(f"r.__{header.index(c)}") if c in header else F.lit(None)).cast(k) for c, k in typed.items()]
        good = F.col("r.__bad").isNull()
        out.append(parsed.select("file", *[F.when(good, v).alias(c) for c, v in zip(typed, values)], F.col("r.__bad").alias("bad_record")))
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return table


def read_captures(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Capture files in CSV under a path, with the line of each bad row (see ``capture_lines``)."""
    return capture_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), schema)


def capture_counts(rows: DataFrame) -> DataFrame:
    """Rows read and rows that don't fit, per file."""
    return rows.groupBy("file").agg(F.count_if(F.col("bad_record").isNull()).alias("rows"), F.count("bad_record").alias("bad"))


def with_identity(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the canonical identity columns (prefix __id_)."""
    kinds = {f.name: f.dataType for f in frame.schema}
    canon = {f"__id_{k}": (F.lower(X.canonical_value(k)) if k == "player" else X.canonical_value(k, kinds[k])) for k in keys if k in kinds}
    return frame.withColumns(canon)


def identity_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith("__id_")]


def unseen(incoming: DataFrame, store: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Incoming rows whose identity the store does not hold, one per identity.

    The first row by ``order`` (all columns when empty) stays: a min over rows, combined
    map-side, so repeats of one identity never gather in one place.
    """
    ids = [f"__id_{k}" for k in keys]
    old = with_identity(store.select(*[k for k in keys if k in store.columns]), keys).select(*ids).distinct()
    fresh = with_identity(incoming, keys).join(old, ids, "left_anti")
    row = F.struct(*(list(order) + [c for c in incoming.columns if c not in order]))
    return fresh.groupBy(*ids).agg(F.min(row).alias("__r")).select("__r.*").select(*incoming.columns)


def append(incoming: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], partition: str | None = None, order: Sequence[str] = ()) -> int:
    """Append what is new; returns the rows added. Running it again adds none."""
    spark = incoming.sparkSession
    store = read_store(spark, path, schema)
    if partition is not None and exists(spark, path):
        # Only the partitions the batch touches are read.
        store = store.join(incoming.select(partition).distinct(), partition, "left_semi")
    fresh = unseen(declared(incoming, schema), store, keys, order).persist()
    try:
        added = fresh.count()
        if added:
            writer = fresh.write.mode("append")
            (writer.partitionBy(partition) if partition else writer).parquet(path)
        return added
    finally:
        fresh.unpersist()


def append_capture(incoming: DataFrame, path: str, schema: T.StructType) -> int:
    """One capture: identity is the stamp and the quote, price included."""
    return append(incoming, path, schema, ("captured_at", *Q.QUOTE_IDENTITY), "slate_date")


def freeze(prices: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows to add to a day's snapshot: wagers it does not hold, priced once.

    A frozen row is never priced again, whatever the new price.
    """
    keys = ("snapshot_date", *FREEZE_IDENTITY)
    return unseen(prices, frozen, keys, ("american_odds", "book"))


def append_ledger(rows: DataFrame, path: str, schema: T.StructType) -> int:
    return append(rows, path, schema, LEDGER_IDENTITY, "snapshot_date")


# Feeds -------------------------------------------------------------------------------


def load_season(spark: SparkSession, root: str, feed: str, season: int, columns: Sequence[str] | None = None, first: int = FIRST_SEASON) -> DataFrame:
    """One season of a feed stored by season; only the named columns are read."""
    if season < first:
        raise ValueError(f"{feed} has nothing before {first}")
    path = f"{root}/{feed}"
    if not exists(spark, f"{path}/season={season}"):
        raise FileNotFoundError(f"{path}/season={season}")
    return season_rows(spark.read.parquet(path), season, columns)


def season_rows(frame: DataFrame, season: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The season's partition and the named columns; both reach the scan."""
    rows = frame.filter(F.col("season") == season)
    return rows.select(*columns) if columns else rows


def fingerprint(frame: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """Rows and an order-free content hash per version, from one pass.

    The hash is a decimal sum of row hashes: it cannot overflow on long tables.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(frame.columns)])
    return frame.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("content"))


def judge_version(new: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("feed", "season")) -> DataFrame:
    """Accept, refuse or keep each new version against the manifest's."""
    old = manifest.select(*keys, F.col("rows").alias("previous_rows"), F.col("content").alias("previous_content"))
    joined = new.join(old, list(keys), "left")
    verdict = (F.when(F.col("previous_content") == F.col("content"), "unchanged")
               .when(F.col("rows") < F.floor(F.coalesce("previous_rows", F.lit(0)) / 2), "refused: shrank").otherwise("accepted"))
    restated = F.coalesce(F.col("previous_content") != F.col("content"), F.lit(False)) & (verdict == "accepted")
    return joined.withColumns({"verdict": verdict, "restated": restated})


def restatements(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys added, dropped or changed between two versions, by row hash."""
    rest = [c for c in before.columns if c not in keys]
    h = lambda d, n: d.groupBy(*keys).agg(F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).alias(n))
    both = h(before, "__a").join(h(after, "__b"), list(keys), "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "dropped").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def supplemented(first: DataFrame, *others: DataFrame, key: str = "game_id") -> DataFrame:
    """Rows of the first source, then of each next one only for keys not yet held."""
    out = first
    for other in others:
        out = out.unionByName(other.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def dated_consensus(tables: DataFrame, days: DataFrame, max_age: int) -> DataFrame:
    """For each asked day: the newest table per source strictly before it and not too
    old, averaged over sources.

    The days that a source can answer are those within ``max_age`` of one of its tables;
    an as-of scan over the distinct table days finds the newest one for each, and only the
    chosen tables are then joined to their rows.
    """
    stamps = tables.select("source", F.col("as_of").alias("day")).distinct()
    near = stamps.select("source", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", max_age))).alias("day")).distinct()
    asked = near.join(days.select("day").distinct(), "day", "left_semi")
    newest = G.as_of(asked, stamps, ["source"], "day", [], [F.trunc("day", "month")], strict=True, right_at="as_of")
    rows = tables.join(newest, ["source", "as_of"])
    return rows.groupBy("day", "team").agg(F.avg("adj_off").alias("adj_off"), F.avg("adj_def").alias("adj_def"), F.avg("tempo").alias("tempo"), F.count("*").alias("sources"))


def build_processed(frames: dict[str, DataFrame], root: str, allow_shrink: bool = False) -> dict[str, dict[int, str]]:
    """Write processed tables by season, season by season replaced; a season that would
    fall below half of its stored rows is kept as it is. Returns what happened."""
    spark = next(iter(frames.values())).sparkSession
    report: dict[str, dict[int, str]] = {}
    for name, frame in frames.items():
        path = f"{root}/{name}"
        new = {r["season"]: r["n"] for r in frame.groupBy("season").agg(F.count("*").alias("n")).collect()}  # one row per season
        old = {r["season"]: r["n"] for r in spark.read.parquet(path).groupBy("season").agg(F.count("*").alias("n")).collect()} if exists(spark, path) else {}
        kept = [s for s, n in new.items() if allow_shrink or n >= old.get(s, 0) // 2]
        report[name] = {s: ("written" if s in kept else "refused: shrank") for s in new} | {s: "absent" for s in old if s not in new}
        frame.filter(F.col("season").isin(*kept)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    return report


