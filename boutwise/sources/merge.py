"""Keyed merges over parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutwise.operators.keyed import latest_per_key


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], coalesce: list[str] | None = None) -> DataFrame:
    """Rows of `batch` replace or extend `target`; `coalesce` columns keep the old value under a NULL.

    `batch` has one row per key (see `latest_per_key`), so no key multiplies rows. One full outer
    join on the key: both sides are hashed on it once.
    """
    keep_old = set(coalesce or [])
    old, new = target.alias("old"), batch.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, keys, "full_outer")
    fresh = F.col("new._new").isNotNull()

    def merged(name: str):
        if name in keys:
            return F.col(name)
        if name not in batch.columns:
            return F.col(f"old.{name}").alias(name)
        if name in keep_old:
            return F.coalesce(f"new.{name}", f"old.{name}").alias(name)
        return F.when(fresh, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return joined.select(*[merged(c) for c in target.columns])


def upsert_latest(
    target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], coalesce: list[str] | None = None,
) -> DataFrame:
    """`upsert` of a batch that may hold a key several times; the last in `order` counts."""
    return upsert(target, latest_per_key(batch, keys, order), keys, coalesce)


def mark_current(table: DataFrame, batch: DataFrame, keys: list[str], flag: str = "is_current") -> DataFrame:
    """Set the flag on the keys of the new batch and clear it everywhere else."""
    marked = batch.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return table.drop(flag).join(marked, keys, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def ingest_runs(batches: dict[str, DataFrame], now: str) -> DataFrame:
    """One row per source: rows synced, when, and a detail text."""
    counts = [
        df.agg(F.count("*").alias("rows_synced")).select(
            F.lit(name).alias("source_name"), F.lit(now).alias("last_synced_at"), "rows_synced",
            F.lit("{}").alias("detail"))
        for name, df in batches.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def rows_added(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Growth per source; never negative."""
    counts = before.select(by, F.lit(0).alias("_side")).unionByName(after.select(by, F.lit(1).alias("_side")))
    return counts.groupBy(by).agg(
        F.count_if(F.col("_side") == 0).alias("rows_before"), F.count_if(F.col("_side") == 1).alias("rows_after"),
    ).withColumn("rows_added", F.greatest(F.col("rows_after") - F.col("rows_before"), F.lit(0)))
