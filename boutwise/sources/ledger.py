"""Nested ledger documents to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "capital double, updated_at string, history array<struct<timestamp: string, prediction_id: string, "
    "note: string, pnl: double, capital_before: double, capital_after: double>>"
)


def ledger_state(docs: DataFrame, key: str, text: str) -> DataFrame:
    doc = F.from_json(text, LEDGER_SCHEMA)
    return docs.select(key, doc.alias("d")).select(
        key, F.coalesce("d.capital", F.lit(0.0)).alias("capital"), "d.updated_at",
        F.coalesce(F.size("d.history"), F.lit(0)).alias("history_count"))


def ledger_events(docs: DataFrame, key: str, text: str, keep: int | None = None) -> DataFrame:
    """One row per history entry with an id made of its fields; with `keep` only the newest so many of each ledger."""
    rows = docs.select(key, F.posexplode(F.from_json(text, LEDGER_SCHEMA)["history"]).alias("pos", "e"))
    if keep is not None:
        newest = Window.partitionBy(key).orderBy(F.col("pos").desc())
        rows = rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")
    parts = ["timestamp", "prediction_id", "note", "capital_after"]
    return (
        rows.select(key, "pos", "e.*")
        .withColumn("event_id", F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))
    )
