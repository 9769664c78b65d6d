"""The performance report as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutwise.functions.market import bet_returns, bet_won
from boutwise.functions.text import first_present
from boutwise.operators.evaluation import bucket_rates, daily_pnl, drift, overall_metrics, tier_stats

# Fixed value: fewer settled bets than this give no report.
LEAST_BETS = 10


def normalize_log(log: DataFrame) -> DataFrame:
    """A bet log with the report's column names, whatever names it came with."""
    real, text = "double", "string"
    return log.select(
        first_present(log, ["match_date"], "date").alias("match_date"),
        *[F.coalesce(first_present(log, [c], text), F.lit("")).alias(c) for c in ("p1_name", "p2_name", "bet_side", "actual_winner", "result")],
        F.coalesce(first_present(log, ["recommended_stake", "stake"], real), F.lit(0.0)).alias("stake"),
        first_present(log, ["selected_odds", "odds"], real).alias("selected_odds"),
        first_present(log, ["selected_edge", "edge"], real).alias("selected_edge"),
        first_present(log, ["selected_prob", "probability"], real).alias("selected_prob"),
        F.coalesce(first_present(log, ["confidence_tier"], text), F.lit("UNKNOWN")).alias("confidence_tier"),
        first_present(log, ["pnl"], real).alias("pnl"))


def settled_bets(log: DataFrame, today: Column, lookback: int = 90) -> DataFrame:
    """Bets of the lookback window that have a winner, a result or a profit, with their returns."""
    rows = normalize_log(log).filter(F.col("match_date") >= F.date_sub(today, lookback))
    rows = rows.filter((F.trim("actual_winner") != "") | (F.trim("result") != "") | F.col("pnl").isNotNull())
    rows = rows.withColumn("won", bet_won(*[F.col(c) for c in ("actual_winner", "bet_side", "p1_name", "p2_name", "result", "pnl")]))
    return rows.withColumns(bet_returns(F.col("won"), F.col("stake"), F.col("selected_odds"), F.col("pnl")))


def report(bets: DataFrame) -> DataFrame:
    """All sections as (section, item, n, rate, value) rows; none at all below the least number of bets."""
    none = F.lit(None).cast("double")

    def section(name: str, df: DataFrame, item: Column, n: Column, rate: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"), item.cast("string").alias("item"), n.cast("long").alias("n"),
            rate.cast("double").alias("rate"), value.cast("double").alias("value"))

    drifted = drift(bets, "match_date")
    parts = [
        section("overall", overall_metrics(bets), F.lit("all"), F.col("bets"), F.col("win_rate"), F.col("roi")),
        section("tier", tier_stats(bets), F.col("confidence_tier"), F.col("n"), F.col("win_rate"), F.col("roi")),
        section("calibration", bucket_rates(bets, "selected_prob", "won"), F.col("bucket"), F.col("n"),
                F.col("actual_win_rate"), F.col("predicted_win_rate")),
        section("pnl", daily_pnl(bets, "match_date"), F.col("match_date"), F.lit(None), F.col("daily_pnl"), F.col("cumulative_pnl")),
        section("drift", drifted, F.when(F.col("drift_flag"), "drift").otherwise("steady"), F.col("recent_bets"),
                F.col("recent_roi"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    enough = bets.agg(F.count("*") >= LEAST_BETS).scalar()
    return out.filter(enough)
