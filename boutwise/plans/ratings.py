"""Ratings of the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutwise.functions.contest import k_factor
from boutwise.operators.keyed import eligible_or_all
from boutwise.operators.ratings import period_ratings, rating_snapshot, stored_ratings, update_ratings


def rating_rows(master: DataFrame, period: Column) -> DataFrame:
    """The eligible matches with their rating period and K."""
    rows = eligible_or_all(master, "is_training_eligible").filter("winner_id <> loser_id")
    return rows.select(
        "tour", "match_key", period.alias("period"), "winner_id", "loser_id", "surface",
        k_factor(F.col("tourney_level"), F.col("round"), F.col("best_of")).alias("k"))


def build_ratings(master: DataFrame, period: Column) -> tuple[DataFrame, DataFrame]:
    """Rating events and the rating snapshot of the eligible matches, each tour on its own."""
    events, state = period_ratings(rating_rows(master, period))
    return events, rating_snapshot(state)


def update_stored_ratings(store: str, master: DataFrame, period: Column) -> tuple[DataFrame, DataFrame]:
    """`build_ratings` of all matches a store has been given so far, of which `master` holds the new, late or changed ones."""
    update_ratings(store, rating_rows(master, period))
    events, state = stored_ratings(master.sparkSession, store)
    return events, rating_snapshot(state)
