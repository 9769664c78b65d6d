"""Odds, edges, stakes and settled bets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the tiers and bands.
TIER_GAPS = {"HIGH": 0.05, "MEDIUM": 0.12}
EDGE_BANDS = {"strong": 0.08, "playable": 0.05}
MIN_EDGE = 0.05
MAX_DAILY_BETS = 3
MAX_DAILY_SHARE = 0.50
MIN_STAKE = 0.50
KELLY_SHARE = 0.25
START_CAPITAL = 100.0
STALE_ODDS_HOURS = 4.0
# Words a settled bet is read from.
WIN_WORDS = ["w", "win", "won", "true", "1"]
SIDE_WORDS = {"p1": ["p1", "1", "home"], "p2": ["p2", "2", "away"]}


def cents(c: Column) -> Column:
    """Two decimals, halves to even."""
    return F.rint(c * 100.0) / 100.0


def power_exponent(odds_1: Column, odds_2: Column, doublings: int = 8, halvings: int = 32) -> Column:
    """The k with q1^k + q2^k = 1: doubling finds an upper limit, halving narrows it.

    Limits are sums of powers of two and so exact: halving keeps the lower one alone and adds half the span to it, or not.
    """

    def over(side: Column, k: Column) -> Column:
        return F.coalesce(F.pow(side["q1"], k) + F.pow(side["q2"], k) > 1.0, F.lit(False))

    def limit(side: Column) -> Column:
        found = F.when(~over(side, F.lit(2.0)), 2.0)
        for i in range(2, doublings + 1):
            found = found.when(~over(side, F.lit(2.0 ** i)), 2.0 ** i)
        return F.struct(side["q1"].alias("q1"), side["q2"].alias("q2"), (found.otherwise(2.0 ** (doublings + 1)) - 1.0).alias("span"))

    def solve(side: Column) -> Column:
        def halve(low: Column, share: Column) -> Column:
            return F.when(over(side, low + side["span"] * share), low + side["span"] * share).otherwise(low)

        shares = F.array(*[F.lit(0.5 ** i) for i in range(1, halvings + 1)])
        return F.aggregate(shares, F.lit(1.0), halve) + side["span"] * 0.5 ** halvings

    # Inside a transform quotients and span are worked out once, not in every step.
    sides = F.array(F.struct((1.0 / odds_1).alias("q1"), (1.0 / odds_2).alias("q2")))
    return F.transform(F.transform(sides, limit), solve)[0]


def remove_overround(odds_1: Column, odds_2: Column, exponent: Column | None = None) -> dict[str, Column]:
    """Fair probabilities from two decimal odds.

    Above an overround of 1 the power method applies. Otherwise the implied probabilities are scaled
    to sum to 1. A stored exponent saves solving for it once per use.
    """
    k = power_exponent(odds_1, odds_2) if exponent is None else exponent
    q1, q2 = 1.0 / odds_1, 1.0 / odds_2
    overround = q1 + q2
    valid = (odds_1 > 1.0) & (odds_2 > 1.0) & (overround > 1.0)
    p1, p2 = F.pow(q1, k), F.pow(q2, k)
    return {
        "overround": overround,
        "exponent": F.when(valid, k),
        "fair_p1": F.when(valid, p1 / (p1 + p2)).otherwise(q1 / overround),
        "fair_p2": F.when(valid, p2 / (p1 + p2)).otherwise(q2 / overround),
    }


def score_edges(prob: Column, fair_p1: Column, fair_p2: Column, odds_1: Column, odds_2: Column) -> dict[str, Column]:
    """Edge of each side over the market, and the better side with its odds and expected value."""
    edge_1, edge_2 = prob - fair_p1, (1.0 - prob) - fair_p2
    first = edge_1 >= edge_2
    odds = F.when(first, odds_1).otherwise(odds_2)
    chance = F.when(first, prob).otherwise(1.0 - prob)
    return {
        "fair_odds_p1": 1.0 / fair_p1, "fair_odds_p2": 1.0 / fair_p2, "edge_p1": edge_1, "edge_p2": edge_2,
        "bet_side": F.when(first, "P1").otherwise("P2"),
        "selected_edge": F.when(first, edge_1).otherwise(edge_2),
        "selected_odds": odds, "selected_prob": chance, "expected_value": chance * odds - 1.0,
    }


def kelly(chance: Column, odds: Column, share: float = KELLY_SHARE) -> dict[str, Column]:
    gain = odds - 1.0
    full = F.greatest(F.when(gain > 0, (gain * chance - (1.0 - chance)) / gain).otherwise(0.0), F.lit(0.0))
    return {"kelly_full": full, "kelly_share": full * share}


def confidence_tier(gap: Column) -> Column:
    return F.when(gap < TIER_GAPS["HIGH"], "HIGH").when(gap < TIER_GAPS["MEDIUM"], "MEDIUM").otherwise("LOW")


def edge_band(edge: Column) -> Column:
    return (
        F.when(edge.isNull(), "unknown").when(edge >= EDGE_BANDS["strong"], "strong")
        .when(edge >= EDGE_BANDS["playable"], "playable").otherwise("below-threshold")
    )


def suggestion(edge: Column, tier: Column, least: float = MIN_EDGE) -> Column:
    return (
        F.when((edge >= least) & (tier == "HIGH"), "HIGH").when(edge >= least, "MEDIUM")
        .when(edge >= least * 0.5, "LOW").otherwise("SKIP")
    )


def odds_too_old(captured: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(captured.cast("timestamp"))) / 3.6e9 > STALE_ODDS_HOURS


def interval(prob: Column, radius: Column | float) -> dict[str, Column]:
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    lower, upper = F.greatest(prob - radius, F.lit(0.0)), F.least(prob + radius, F.lit(1.0))
    return {"lower": lower, "upper": upper, "width": upper - lower}


def blend(models: dict[str, Column], weights: dict[str, float]) -> dict[str, Column]:
    """Weighted mean over the models that have a value, and how well those agree."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, c in models.items():
        w = F.lit(float(weights.get(name, 0.0)))
        total = total + F.coalesce(c * w, F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), w).otherwise(0.0)
    values = list(models.values())
    gap = F.greatest(*values) - F.least(*values) if len(values) > 1 else F.lit(0.0)
    return {
        "ensemble_prob": F.when(weight > 0, total / weight),
        "model_agreement": 1.0 - gap, "confidence_tier": confidence_tier(gap),
    }


def movement_class(delta_1: Column, delta_2: Column) -> Column:
    tiny = 1e-9
    return (
        F.when(delta_1.isNull() | delta_2.isNull(), "no_prior_snapshot")
        .when((F.abs(delta_1) < tiny) & (F.abs(delta_2) < tiny), "flat")
        .when((delta_1 < 0) & (delta_2 > 0), "steam_p1").when((delta_2 < 0) & (delta_1 > 0), "steam_p2")
        .otherwise("mixed")
    )


def settle(outcome: Column, stake: Column, odds: Column, now: Column) -> dict[str, Column]:
    pnl = (
        F.when(outcome == "win", cents(stake * (odds - 1.0))).when(outcome == "void", F.lit(0.0))
        .otherwise(cents(-stake))
    )
    return {"result": outcome, "pnl": pnl, "status": F.lit("closed"), "resolved_at": now}


def _text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def bet_won(winner: Column, side: Column, name_1: Column, name_2: Column, result: Column, pnl: Column) -> Column:
    """The named winner decides, else the result text, else the sign of the profit."""
    winner, side, result = _text(winner), _text(side), _text(result)
    by_side = F.lit(None).cast("boolean")
    for key, name in (("p1", name_1), ("p2", name_2)):
        by_side = F.when(
            side.isin(SIDE_WORDS[key]), winner.isin(SIDE_WORDS[key]) | (winner == _text(name))
        ).otherwise(by_side)
    by_winner = F.when(winner != "", by_side)
    by_result = F.when(result != "", result.isin(WIN_WORDS))
    return F.coalesce(by_winner, by_result, pnl > 0, F.lit(False))


def bet_returns(won: Column, stake: Column, odds: Column, pnl: Column) -> dict[str, Column]:
    derived = F.when(won, stake * F.coalesce(odds, F.lit(0.0))).otherwise(stake)
    total = F.coalesce(F.when(pnl.isNotNull(), stake + pnl).otherwise(derived), F.lit(0.0))
    return {"total_return": total, "bet_pnl": total - stake}
