"""Strategies on past predictions and odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutwise.functions.market import MAX_DAILY_SHARE
from boutwise.operators.equity import equity_compound, equity_flat, flat_bets, strategy_summary
from boutwise.operators.keyed import date_window, refuse_in_sample
from boutwise.operators.marketplace import join_predictions, with_edges


def scored_window(pred: DataFrame, odds: DataFrame, start: str | None, end: str | None, cutoff: str | None = None,
                  aliases: DataFrame | None = None) -> DataFrame:
    """Predictions of a date window joined with their prices and edges."""
    pred = date_window(pred, "match_date", start, end)
    if cutoff:
        refuse_in_sample(pred, "match_date", cutoff)
    return with_edges(join_predictions(pred, date_window(odds, "match_date", start, end), aliases=aliases), "prob")


def strategy_curves(
    scored: DataFrame, label: str, coin: Column, start: float, cap: float = MAX_DAILY_SHARE, by: list[str] | None = None,
) -> DataFrame:
    """Daily equity of value bets, favourites and random sides in one table."""
    keys = by or []
    flat = equity_flat(flat_bets(scored, label, coin), [*keys, "strategy"], "match_date", start)
    value = equity_compound(scored, keys, "match_date", label, ["match_key"], start, cap=cap)
    # What was staked on a day is its share of the bankroll the day began with.
    value = value.withColumn("staked", F.col("share") * F.col("equity") / (1.0 + F.col("day_return")))
    columns = [*keys, "strategy", "match_date", "bets", "wins", "staked", "equity"]
    return flat.select(*columns).unionByName(value.withColumn("strategy", F.lit("value_dynamic")).select(*columns))


def summary(curves: DataFrame, start: float, by: list[str] | None = None) -> DataFrame:
    return strategy_summary(curves, [*(by or []), "strategy"], "match_date", F.col("staked"), start)
