"""Odds snapshots as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from boutwise.functions.market import movement_class
from boutwise.operators.history import History, PrefixLast
from boutwise.operators.keyed import latest_per_key
from boutwise.session import delete_folder, folder_names, materialize
from boutwise.sources.merge import mark_current, upsert

KEYS = ["match_id", "captured_at"]
BUCKETS = 64  # of the locator
COMPACT_EVERY = 20  # micro-batches


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing is there; any other fault is raised."""
    return spark.read.parquet(path) if folder_names(spark, path) else None


def _bucket(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, "match_date", F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _days_before(spark: SparkSession, table: str, stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The locator's buckets that the batch's keys fall in, and the days where those keys are kept so far."""
    where = _read(spark, f"{table}/where")
    where = _bucket(stored) if where is None else where.select(*KEYS, "match_date", "bucket")
    buckets = [r[0] for r in _bucket(batch).select("bucket").distinct().collect()]  # no more than BUCKETS
    near = where.filter(F.col("bucket").isin(buckets))
    return near, near.join(batch.select(*KEYS), KEYS, "left_semi").select("match_date")


def merge_batch(batch: DataFrame, table: str, order: list[str]) -> None:
    """Upsert one micro-batch into a table kept in day partitions, and note its keys as the current ones.

    A locator, kept in buckets of the key, knows the day of every key, so that a key whose day changes is found and taken out
    of its old day without a scan of the table. Only the days and buckets that the batch touches are read and rewritten; a day
    left without rows goes. Running a batch again after a failure gives the same table: the merge is by key, and the locator
    is written after the rows, so until then it still names the old days.
    """
    spark = batch.sparkSession
    batch = materialize(latest_per_key(batch, KEYS, order))
    if not batch.take(1):
        return
    stored = _read(spark, f"{table}/rows")
    if stored is None:
        merged, located = batch, _bucket(batch)
    else:
        near, moved_from = _days_before(spark, table, stored, batch)
        days = materialize(batch.select("match_date").union(moved_from).distinct())
        touched = stored.join(days, "match_date", "left_semi").select(*batch.columns)
        # Written apart first: the days and buckets being replaced are also being read.
        merged = materialize(upsert(touched, batch, KEYS))
        located = materialize(upsert(near, _bucket(batch), KEYS))
        emptied = [r[0] for r in days.join(merged, "match_date", "left_anti").collect()]  # of the days the batch touches
    rows = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_date")
    rows.parquet(f"{table}/rows")
    if stored is not None:
        for day in emptied:
            delete_folder(spark, f"{table}/rows/match_date={day}")
    located.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{table}/where")
    batch.select(*KEYS).write.mode("overwrite").parquet(f"{table}/current")


def read_odds_table(spark: SparkSession, table: str) -> DataFrame:
    """The stored snapshots, those of the latest batch flagged as current."""
    return mark_current(spark.read.parquet(f"{table}/rows"), spark.read.parquet(f"{table}/current"), KEYS)


def stream_odds_upsert(snapshots: DataFrame, table: str, checkpoint: str, order: list[str]) -> DataStreamWriter:
    """Merge each micro-batch. Merging is by key, so repeats cost nothing and no row is too late."""
    return snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: merge_batch(batch, table, order))


def _state_before(spark: SparkSession, table: str, batch_id: int) -> DataFrame | None:
    """The last snapshots written before this micro-batch: the newest base, and what came after it."""
    names = folder_names(spark, f"{table}/last")
    bases = [n for n in (int(x[5:]) for x in names if x.startswith("base-")) if n <= batch_id and "_SUCCESS" in folder_names(spark, f"{table}/last/base-{n}")]
    base = max(bases, default=None)
    parts = [f"base-{base}"] if base is not None else []
    parts += [x for x in names if x.startswith("batch-") and (base or 0) <= int(x[6:]) < batch_id]
    return spark.read.parquet(*[f"{table}/last/{p}" for p in parts]) if parts else None


def _newest(rows: DataFrame) -> DataFrame:
    """One row per key: its last snapshot."""
    return rows.groupBy("_key").agg(F.max_by("_snapshot", F.struct("_snapshot.captured_at", "_snapshot.snapshot_id")).alias("_snapshot"))


def movement_batch(batch: DataFrame, batch_id: int, table: str, key: Column, compact_every: int = COMPACT_EVERY, **history) -> None:
    """Change of every snapshot of a micro-batch against the latest one before it of the same key.

    The state is one row per key, its last snapshot. Inside the batch predecessors come from a segmented history, so that a key
    may hold any share of it; the first one of each key looks up the state. A snapshot no later than what the state has seen
    is late: it has no known predecessor and leaves the state alone. Of the same instant, the smaller snapshot_id comes first.
    Every batch writes its rows and the keys it has moved under its number, so that running it again replaces what it wrote;
    every `compact_every` batches the state is laid together.
    """
    spark, names = batch.sparkSession, batch.columns
    snapshot = F.struct("captured_at", "snapshot_id", "odds_p1", "odds_p2")
    rows = materialize(batch.withColumns({"_key": key, "_snapshot": snapshot}))
    before = _state_before(spark, table, batch_id)
    if before is not None and batch_id and batch_id % compact_every == 0 and f"base-{batch_id}" not in folder_names(spark, f"{table}/last"):
        _newest(before).write.mode("overwrite").parquet(f"{table}/last/base-{batch_id}")
        for name in folder_names(spark, f"{table}/last"):
            if int(name.rsplit("-", 1)[1]) < batch_id:
                delete_folder(spark, f"{table}/last/{name}")
        before = _state_before(spark, table, batch_id)
    if before is None:
        known = rows.withColumn("_known", F.lit(None).cast(rows.schema["_snapshot"].dataType))
    else:
        seen = _newest(before.join(rows.select("_key").distinct(), "_key", "left_semi")).withColumnRenamed("_snapshot", "_known")
        known = rows.join(seen, "_key", "left")
    late = F.coalesce(F.col("captured_at") <= F.col("_known.captured_at"), F.lit(False)) | F.col("captured_at").isNull()
    known = materialize(known.withColumn("_late", late))
    fresh = known.filter("NOT _late").withColumn("_day", F.to_date("captured_at"))
    fresh = History(fresh, ["_key"], "_day", ["captured_at", "snapshot_id"], **history).add(PrefixLast("_previous", F.col("_snapshot"))).result()
    fresh = fresh.withColumn("_previous", F.coalesce("_previous", "_known"))
    found = fresh.select(*names, "_previous").unionByName(known.filter("_late").select(
        *names, F.lit(None).cast(rows.schema["_snapshot"].dataType).alias("_previous")))
    found = found.select(*names, *[F.col(f"_previous.{c}").alias(f"prev_{c}") for c in ("captured_at", "odds_p1", "odds_p2")])
    d1, d2 = F.col("odds_p1") - F.col("prev_odds_p1"), F.col("odds_p2") - F.col("prev_odds_p2")
    found.withColumns({
        "hours_since_previous": (F.unix_micros("captured_at") - F.unix_micros("prev_captured_at")) / 3.6e9,
        "odds_p1_delta": d1, "odds_p2_delta": d2, "odds_p1_pct": d1 / F.nullif("prev_odds_p1", F.lit(0.0)),
        "odds_p2_pct": d2 / F.nullif("prev_odds_p2", F.lit(0.0)), "market_move": movement_class(d1, d2),
    }).write.mode("overwrite").parquet(f"{table}/rows/batch={batch_id}")
    _newest(known.filter("NOT _late")).write.mode("overwrite").parquet(f"{table}/last/batch-{batch_id}")


def read_movements(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table}/rows").drop("batch")


def stream_odds_movement(snapshots: DataFrame, table: str, checkpoint: str, key: Column | None = None, **options) -> DataStreamWriter:
    """The movement of every snapshot (match_id, snapshot_id, captured_at, odds_p1, odds_p2, ...) across micro-batches.

    `key` names the match, match_id unless given; `movement_key` falls back to date, tour and names where the id is blank.
    """
    key = F.col("match_id").cast("string") if key is None else key
    return snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: movement_batch(batch, batch_id, table, key, **options))
