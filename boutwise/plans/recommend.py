"""Daily recommendations: predictions and odds to staked bets and new log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutwise.functions.market import MIN_EDGE
from boutwise.operators.keyed import new_only
from boutwise.operators.marketplace import join_predictions, recommend, recommendation_status, with_edges


def combined_summary(scored: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows looked at, bets picked and their total stake over all tours."""
    looked_at = scored.agg(F.count("*")).scalar()
    return picks.agg(F.count("*").alias("bets"), F.coalesce(F.sum("stake"), F.lit(0.0)).alias("total_stake")).select(
        looked_at.alias("analysed"), "bets", "total_stake")


def prediction_id(tour: Column, day: Column, p1: Column, p2: Column, side: Column) -> Column:
    return F.lower(F.concat_ws(":", tour, day.cast("string"), p1, p2, side))


def daily_recommendations(
    pred: DataFrame, odds: DataFrame, capital: float, by: list[str], least: float = MIN_EDGE, min_bookmakers: int = 1,
    aliases: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Staked bets per group of `by` (tour and day), and the status of every group."""
    scored = with_edges(join_predictions(pred, odds, min_bookmakers=min_bookmakers, aliases=aliases), "prob")
    return recommend(scored, by, ["match_key"], capital, least), recommendation_status(scored, by, "match_key", least)


def new_log_entries(bets: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """Open log entries of the bets that the log does not have yet."""
    entries = bets.select(
        prediction_id(F.col("tour"), F.col("match_date"), F.col("p1_name"), F.col("p2_name"), F.col("bet_side")).alias("prediction_id"),
        F.lit(now).alias("created_at"), "match_date", "tour", F.concat_ws(" vs ", "p1_name", "p2_name").alias("match"),
        "p1_name", "p2_name", "bet_side", F.col("selected_prob").alias("probability"), F.col("selected_odds").alias("odds"),
        F.col("selected_edge").alias("edge"), "stake", F.lit("open").alias("status"))
    return new_only(entries, log, ["prediction_id"])
