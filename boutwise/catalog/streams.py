"""Streaming queries, run to the end of the available data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.registry import query
from boutwise.catalog.views import r6, twin
from boutwise.catalog.windows import rounded
from boutwise.operators import marketplace
from boutwise.session import materialize, shared_folder
from boutwise.streaming import odds as streams


SNAPSHOTS = "snapshot_id long, match_id long, captured_at timestamp, match_date date, odds_p1 double, odds_p2 double"
MOVED = 40  # days


def snapshots(spark, folder):
    """The events as odds snapshots."""
    p1 = 1.05 + F.col("value") / 100.0
    return views.table(spark, folder, "events").select(
        F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("captured_at"),
        F.col("ts").cast("date").alias("match_date"), p1.alias("odds_p1"), (1.0 / (1.05 - 1.0 / p1)).alias("odds_p2"), "event_type")


def file_stream(spark, path, schema, files):
    """The parquet files under a path as a stream, at most so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@query("i01_stream_odds_upsert", twin(["odds"], f"""SELECT CAST(CASE WHEN snapshot_id % 30 = 0 THEN match_date + {MOVED} ELSE match_date END AS DATE) AS match_date, count(*) AS n, CAST(count(DISTINCT match_id) AS BIGINT) AS matches,
 CAST(count_if(snapshot_id % 2 = 1 OR snapshot_id % 10 = 0) AS BIGINT) AS current_rows, round(sum(odds_p1 + CASE WHEN snapshot_id % 10 = 0 THEN 0.5 ELSE 0 END), 4) AS price_sum FROM odds GROUP BY 1"""))
def stream_odds_upsert(spark, folder):
    """Two batches: the even snapshots, then the odd ones with every tenth sent once more at another price, and every thirtieth on another day."""
    base = f"{shared_folder(spark)}/odds-{uuid.uuid4().hex}"
    rows = snapshots(spark, folder).drop("event_type")
    again = rows.filter("snapshot_id % 10 = 0").withColumns({
        "odds_p1": F.col("odds_p1") + 0.5, "match_date": F.when(F.col("snapshot_id") % 30 == 0, F.date_add("match_date", MOVED)).otherwise(F.col("match_date"))})
    for batch in (rows.filter("snapshot_id % 2 = 0"), rows.filter("snapshot_id % 2 = 1").unionByName(again)):
        batch.write.mode("append").parquet(f"{base}/source")
        streams.stream_odds_upsert(file_stream(spark, f"{base}/source", SNAPSHOTS, 1_000_000), f"{base}/table", f"{base}/checkpoint", ["snapshot_id"]).trigger(
            availableNow=True).start().awaitTermination()
    return streams.read_odds_table(spark, f"{base}/table").groupBy("match_date").agg(
        F.count("*").alias("n"), F.count_distinct("match_id").alias("matches"), F.count_if("is_current").alias("current_rows"),
        F.round(F.sum("odds_p1"), 4).alias("price_sum"))


# Ten batches by the day of the year; every 17th snapshot comes last of all. Every seventh has no id.
BATCH = "CASE WHEN snapshot_id % 17 = 0 THEN 9 ELSE least(9, CAST(floor(dayofyear(match_date) / 37.0) AS INT)) END"
ID = "CASE WHEN snapshot_id % 7 = 0 THEN ' ' ELSE CAST(match_id AS VARCHAR(20)) END"


@query("i02_stream_odds_movement", twin(["odds"], f""", b AS (SELECT *, {BATCH} AS batch, CASE WHEN snapshot_id % 7 = 0 THEN CAST(match_date AS VARCHAR) || '|' || lower(bookmaker) || '|p' || (match_id % 5) || '|q' || (match_id % 3) ELSE CAST(match_id AS VARCHAR) END AS key FROM odds),
k AS (SELECT *, max(captured_at) OVER (PARTITION BY key ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM b),
p AS (SELECT *, lag(captured_at) OVER w AS pc, lag(odds_p1) OVER w AS p1, lag(odds_p2) OVER w AS p2 FROM k WHERE known IS NULL OR captured_at > known WINDOW w AS (PARTITION BY key ORDER BY captured_at, snapshot_id)
 UNION ALL SELECT *, NULL, NULL, NULL FROM k WHERE captured_at <= known)
SELECT snapshot_id, {ID} AS match_id, captured_at, pc AS prev_captured_at, {r6('(epoch_us(captured_at) - epoch_us(pc)) / 3.6e9')} AS hours_since_previous,
 {r6('odds_p1 - p1')} AS odds_p1_delta, {r6('odds_p2 - p2')} AS odds_p2_delta, {r6('(odds_p1 - p1) / p1')} AS odds_p1_pct, {r6('(odds_p2 - p2) / p2')} AS odds_p2_pct,
 CASE WHEN pc IS NULL THEN 'no_prior_snapshot' WHEN abs(odds_p1 - p1) < 1e-9 AND abs(odds_p2 - p2) < 1e-9 THEN 'flat' WHEN odds_p1 < p1 AND odds_p2 > p2 THEN 'steam_p1'
  WHEN odds_p2 < p2 AND odds_p1 > p1 THEN 'steam_p2' ELSE 'mixed' END AS market_move FROM p"""))
def stream_odds_movement(spark, folder):
    """Ten micro-batches with late snapshots and blank ids, the state laid together on the way, a history cut into segments."""
    base = f"{shared_folder(spark)}/moves-{uuid.uuid4().hex}"
    rows = snapshots(spark, folder).withColumns({
        "batch": F.expr(BATCH), "name_1": F.concat(F.lit("P"), F.col("match_id") % 5), "name_2": F.concat(F.lit("Q"), F.col("match_id") % 3), "match_id": F.expr(ID)})
    rows = rows.withColumnRenamed("event_type", "tour")
    parts = materialize(rows, ["batch"])  # read once; a batch is one folder
    key = marketplace.movement_key(F.col("match_id"), F.col("match_date"), F.col("tour"), F.col("name_1"), F.col("name_2"))
    for k in range(10):
        # All files of a batch are one micro-batch, however many tasks have written them.
        parts.filter(F.col("batch") == k).write.mode("append").parquet(f"{base}/source")
        streams.stream_odds_movement(
            file_stream(spark, f"{base}/source", rows.schema, 1_000_000), f"{base}/table", f"{base}/checkpoint", key, compact_every=4).trigger(
            availableNow=True).start().awaitTermination()
    found = streams.read_movements(spark, f"{base}/table").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("captured_at", "prev_captured_at")})
    names = ["hours_since_previous", "odds_p1_delta", "odds_p2_delta", "odds_p1_pct", "odds_p2_pct"]
    return rounded(found, *names).select("snapshot_id", "match_id", "captured_at", "prev_captured_at", *names, "market_move")
