"""Equity curves and ledgers in closed form.

Strategies run on one row per day, so a window over all days of a strategy is small. Differences to
a bet-by-bet simulation: stakes inside a compounding day are not rounded to cents and have no
minimum, and ruin takes effect at the end of the day it happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutwise.functions.market import MAX_DAILY_BETS, MAX_DAILY_SHARE, MIN_EDGE
from boutwise.operators.history import History, PrefixMax, PrefixSum
from boutwise.operators.marketplace import allocate_daily


def _upto(by: list[str], day: str):
    return Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)


def flat_bets(scored: DataFrame, label: str, coin: Column) -> DataFrame:
    """Every match bet twice with stake 1: on the favourite, and on a side picked by `coin`."""
    favourite = F.when(F.col("odds_p1") <= F.col("odds_p2"), "P1").otherwise("P2")
    picks = F.array(
        F.struct(F.lit("flat_favorite").alias("strategy"), favourite.alias("side")),
        F.struct(F.lit("flat_random").alias("strategy"), F.when(coin, "P1").otherwise("P2").alias("side")))
    rows = scored.withColumn("_p", F.explode(picks)).select(*scored.columns, "_p.strategy", "_p.side")
    odds = F.when(F.col("side") == "P1", F.col("odds_p1")).otherwise(F.col("odds_p2"))
    won = (F.col("side") == F.when(F.col(label) == 1, "P1").otherwise("P2"))
    return rows.withColumns({"won": won, "stake": F.lit(1.0), "pnl": F.when(won, odds - 1.0).otherwise(-1.0)})


def equity_flat(bets: DataFrame, by: list[str], day: str, start: float) -> DataFrame:
    """Bankroll at the end of each day; once it is used up it stays at 0."""
    daily = bets.groupBy(*by, day).agg(
        F.count("*").alias("bets"), F.count_if("won").alias("wins"), F.sum("stake").alias("staked"),
        F.sum("pnl").alias("pnl"))
    w = _upto(by, day)
    daily = daily.withColumn("raw_equity", start + F.sum("pnl").over(w))
    ruined = F.min("raw_equity").over(w) <= 0
    return daily.withColumn("equity", F.when(ruined, 0.0).otherwise(F.col("raw_equity"))).drop("raw_equity")


def equity_compound(
    scored: DataFrame, by: list[str], day: str, label: str, tie_break: list[str], start: float,
    least: float = MIN_EDGE, n: int = MAX_DAILY_BETS, cap: float = MAX_DAILY_SHARE,
) -> DataFrame:
    """Daily value bets staked as shares of the bankroll; growth factors multiply up.

    `log_equity` is exact for curves of any height; `equity` is 0 or infinite where a double ends. A lost day with the
    whole bankroll at stake is ruin: equity 0 and log_equity NULL from that day on.
    """
    bets = allocate_daily(scored.filter(F.col("selected_edge") >= least), [*by, day], tie_break, 1.0, n, cap)
    won = (F.col("bet_side") == "P1") == (F.col(label) == 1)
    gain = F.col("share") * F.when(won, F.col("selected_odds") - 1.0).otherwise(-1.0)
    daily = bets.groupBy(*by, day).agg(
        F.count("*").alias("bets"), F.count_if(won).alias("wins"), F.sum("share").alias("share"),
        F.sum(gain).alias("day_return"))
    ruined = F.min("day_return").over(_upto(by, day)) <= -1.0
    grown = F.sum(F.when(F.col("day_return") > -1.0, F.log1p("day_return"))).over(_upto(by, day))
    daily = daily.withColumn("log_equity", F.when(~ruined, F.log(F.lit(start)) + F.coalesce(grown, F.lit(0.0))))
    return daily.withColumn("equity", F.coalesce(F.exp("log_equity"), F.lit(0.0)))


def max_drawdown(curve: DataFrame, by: list[str], day: str, equity: str, start: float, log_equity: str | None = None) -> DataFrame:
    """Largest fall from the highest equity so far, the starting capital included.

    Where `log_equity` names a column and it is not NULL, falls are taken from it, for curves no double holds.
    """
    peak = F.greatest(F.max(equity).over(_upto(by, day)), F.lit(start))
    fall = F.when(peak > 0, (peak - F.col(equity)) / peak).otherwise(0.0)
    if log_equity is not None:
        top = F.greatest(F.max(log_equity).over(_upto(by, day)), F.log(F.lit(start)))
        fall = F.when(F.col(log_equity).isNotNull(), 1.0 - F.exp(F.col(log_equity) - top)).otherwise(fall)
    falls = curve.withColumn("_dd", fall)
    return falls.groupBy(*by).agg(F.max("_dd").alias("max_drawdown"))


def strategy_summary(curve: DataFrame, by: list[str], day: str, staked: Column, start: float) -> DataFrame:
    """Bets, win rate, stake, profit and returns per strategy from its daily curve."""
    total = curve.groupBy(*by).agg(
        F.sum("bets").alias("bets"), F.try_divide(F.sum("wins"), F.sum("bets")).alias("win_rate"),
        F.sum(staked).alias("staked"), F.max_by("equity", day).alias("end_capital"))
    profit = F.col("end_capital") - start
    total = total.withColumns({
        "profit": profit, "roi_on_staked": F.coalesce(F.try_divide(profit, F.col("staked")), F.lit(0.0)),
        "roi_on_capital": profit / start,
    })
    return total.join(max_drawdown(curve, by, day, "equity", start), by)


def bankroll_ledger(
    events: DataFrame, account: list[str], day: str, order: list[str], pnl: str, start: float, **history,
) -> DataFrame:
    """Capital before and after each event when it may not fall below 0.

    A sum floored at every step equals the plain running sum less its lowest value so far below 0.
    """
    h = History(events, account, day, order, **history).add(PrefixSum("_sum", F.col(pnl)))
    h.df = h.df.withColumn("_after", start + F.col("_sum") + F.col(pnl))
    h.add(PrefixMax("_debt", -F.col("_after")))
    before_debt = F.greatest(F.coalesce("_debt", F.lit(0.0)), F.lit(0.0))
    after_debt = F.greatest(before_debt, -F.col("_after"))
    return h.result().withColumns({
        "capital_before": start + F.col("_sum") + before_debt, "capital_after": F.col("_after") + after_debt,
    }).drop("_sum", "_after", "_debt")
