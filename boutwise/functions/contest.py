"""Expressions about one contest and its two sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutwise.functions.text import WIDE_PUNCTUATION, map_code, normalize_name

# Labels of level codes, as the master table and as the feature table name them.
MASTER_LEVELS = {
    "G": "grand_slam", "M": "masters", "A": "tour", "C": "challenger",
    "D": "davis_or_equivalent", "F": "finals", "I": "team_event",
}
FEATURE_LEVELS = {
    "G": "Grand Slam", "M": "Masters", "A": "Tour", "C": "Challenger",
    "D": "Other", "F": "Finals", "I": "Team Event",
}
# Rating constants.
RATING_START = 1500.0
K_BASE = 32.0
LEVEL_WEIGHTS = {"G": 1.10, "M": 1.00, "A": 0.90, "C": 0.85, "D": 0.70, "F": 1.00, "I": 1.00}
ROUND_WEIGHTS = {"R128": 0.95, "R64": 0.95, "R32": 1.00, "R16": 1.02, "QF": 1.05, "SF": 1.08, "F": 1.10}
OVERALL_SHARE, SURFACE_SHARE = 0.7, 0.3
# What a ratio defaults to before any value is known.
RATIO_DEFAULTS = {
    "ace_pct": 0.06,
    "first_serve_pct": 0.62,
    "first_serve_win_pct": 0.68,
    "second_serve_win_pct": 0.50,
    "service_points_won_pct": 0.62,
    "return_points_won_pct": 0.38,
    "bp_save_pct": 0.60,
}


def order_pair(a_id: Column, a_name: Column, b_id: Column, b_name: Column) -> Column:
    """True when side a is p1: numeric ids first in number order, then normalised name, then id.

    The order looks at the two sides only, never at the result, so it cannot leak the label.
    """

    def rank(i: Column, name: Column) -> Column:
        text = i.cast("string")
        number = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
        named = number.isNull()
        return F.struct(
            named.cast("int").alias("g"), F.coalesce(number, F.lit(0)).alias("n"),
            F.when(named, F.coalesce(normalize_name(name, WIDE_PUNCTUATION), F.lit(""))).alias("s"),
            F.when(named, text).alias("i"))

    return rank(a_id, a_name) <= rank(b_id, b_name)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def serve_ratios(
    ace: Column, points: Column, first_in: Column, first_won: Column, second_won: Column,
    saved: Column, faced: Column, other_points: Column, other_first_won: Column, other_second_won: Column,
) -> dict[str, Column]:
    """Seven ratios, each NULL where its denominator is not positive."""
    served = F.when(points > 0, points)
    return {
        "ace_pct": _ratio(ace, served),
        "first_serve_pct": _ratio(first_in, served),
        "first_serve_win_pct": F.when(served.isNotNull(), _ratio(first_won, first_in)),
        "second_serve_win_pct": _ratio(second_won, served - first_in),
        "service_points_won_pct": _ratio(first_won + second_won, served),
        "return_points_won_pct": 1.0 - _ratio(other_first_won + other_second_won, other_points),
        "bp_save_pct": _ratio(saved, faced),
    }


def home_flags(p1_country: Column, p2_country: Column, host: Column) -> dict[str, Column]:
    p1 = F.coalesce((p1_country == host).cast("int"), F.lit(0))
    p2 = F.coalesce((p2_country == host).cast("int"), F.lit(0))
    return {"p1_is_home": p1, "p2_is_home": p2, "home_advantage_flag": p1 - p2}


def _weight(code: Column, weights: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in weights.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(1.0))


def k_factor(level: Column, round_code: Column, best_of: Column) -> Column:
    long_match = F.when(best_of.try_cast("double") >= 5, 1.05).otherwise(1.0)
    return F.lit(K_BASE) * _weight(level, LEVEL_WEIGHTS) * _weight(round_code, ROUND_WEIGHTS) * long_match


def expected_score(own: Column, own_surface: Column, other: Column, other_surface: Column) -> Column:
    """Win chance from the blend of overall and surface rating."""
    mine = OVERALL_SHARE * own + SURFACE_SHARE * own_surface
    theirs = OVERALL_SHARE * other + SURFACE_SHARE * other_surface
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (theirs - mine) / 400.0))


def age_at(day: Column, born: Column) -> Column:
    """Age in years to one decimal; NULL at ten or less, which is a data error."""
    age = F.round(F.datediff(day, born) / 365.25, 1)
    return F.when(age > 10, age)


def eligible(is_retirement: Column, walkover: Column) -> Column:
    return ~(F.coalesce(is_retirement, F.lit(False)) | F.coalesce(walkover, F.lit(False)))


def feature_level(code: Column, fallback: Column) -> Column:
    return map_code(code, FEATURE_LEVELS, F.coalesce(fallback, F.lit("Other")))


def pair_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def staleness(latest: Column, today: Column) -> dict[str, Column]:
    """How far behind the data is, as a status and a sentence."""
    # Day limits of the statuses.
    fresh, warning, stale = 3, 7, 14
    behind = F.datediff(today, latest)
    status = (
        F.when(behind.isNull(), "unknown").when(behind <= fresh, "fresh").when(behind <= warning, "warning")
        .when(behind <= stale, "stale").otherwise("critical")
    )
    n = behind.cast("string")
    message = (
        F.when(behind.isNull(), F.lit("No data found yet."))
        .when(behind <= fresh, F.lit("Data is fresh."))
        .when(behind <= warning, F.concat(F.lit("Data is "), n, F.lit(" days behind; still usable.")))
        .when(behind <= stale, F.concat(F.lit("Data is "), n, F.lit(" days stale; add recent results.")))
        .otherwise(F.concat(F.lit("Data is critically stale ("), n, F.lit(" days).")))
    )
    return {"days_behind": behind, "status": status, "message": message}
