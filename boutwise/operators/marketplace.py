"""Predictions meet odds: consensus prices, as-of snapshots, daily allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutwise.functions.market import (
    MAX_DAILY_BETS, MAX_DAILY_SHARE, MIN_EDGE, MIN_STAKE, cents, kelly, movement_class, power_exponent,
    remove_overround, score_edges,
)
from boutwise.functions.text import canonical_id, normalize_name
from boutwise.operators.history import History, PrefixLast
from boutwise.operators.keyed import canonical_name
from boutwise.session import materialize

# Names that stand for a page and not for a bookmaker.
PLACEHOLDER_BOOKMAKERS = ["flashscore_market_median", "flashscore_event_page"]
# What an uploaded row gets where it says nothing.
UPLOAD_DEFAULTS = {
    "match_time": "", "tournament": "Manual upload", "surface": "Unknown", "player_1_match_score": 100,
    "player_2_match_score": 100, "source_url": "manual_upload",
}


def latest_capture(odds: DataFrame, keys: list[str], captured: str) -> DataFrame:
    """All rows of each key's latest capture time; rows without a time count only if none has one.

    A rank of 1 lets Spark trim each key before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(captured).desc_nulls_last())
    return odds.withColumn("_n", F.rank().over(newest)).filter(F.col("_n") == 1).drop("_n")


def market_consensus(
    odds: DataFrame, keys: list[str], captured: str, low: str, high: str, keep_unpriced: bool = False, event: list[str] | None = None,
) -> DataFrame:
    """Median price of both sides over the latest rows of each key, and how many makers quote.

    Rows with a price of 1 or less do not count; a key with no other row is dropped unless
    `keep_unpriced`. `event` columns come together from the least priced row. The median is that of the one or two middle rows of
    each key, numbered on the shuffle by key that the latest rows need anyway; nothing is collected per key.
    """
    rows = latest_capture(odds, keys, captured)
    valid = (F.col(low) > 1) & (F.col(high) > 1)
    maker = F.trim("bookmaker")
    nested = F.coalesce(F.col("bookmaker_count").cast("long"), F.lit(0)) if "bookmaker_count" in odds.columns else F.lit(0)
    method = F.when(F.trim("aggregation_method") != "", F.trim("aggregation_method")) \
        if "aggregation_method" in odds.columns else F.lit(None).cast("string")
    of_key = Window.partitionBy(*keys)
    rows = rows.withColumns({
        "_valid": F.coalesce(valid, F.lit(False)), "_maker": F.when(valid & (maker != "") & ~maker.isin(PLACEHOLDER_BOOKMAKERS), maker)})
    rows = rows.withColumn("_pairs", F.count_if("_valid").over(of_key))
    for i, price in enumerate((low, high)):
        place = F.row_number().over(of_key.orderBy(F.when(F.col("_valid"), F.col(price)).asc_nulls_last()))
        rows = rows.withColumn(f"_at{i}", place)
    # Last, so that the rows of a key and maker follow each other and the sums below find them sorted by key.
    rows = rows.withColumn("_new", F.col("_maker").isNotNull() & ~F.col("_maker").eqNullSafe(F.lag("_maker").over(of_key.orderBy("_maker"))))

    def middle(price: str, at: str) -> Column:
        mine = F.col("_valid") & F.col(at).isin(F.floor((F.col("_pairs") + 1) / 2), F.floor(F.col("_pairs") / 2) + 1)
        return 0.5 * F.min(F.when(mine, F.col(price))) + 0.5 * F.max(F.when(mine, F.col(price)))

    found = rows.groupBy(*keys).agg(
        middle(low, "_at0").alias(low), middle(high, "_at1").alias(high),
        F.count_if("_new").alias("_named"), F.max(F.when(F.col("_valid"), nested)).alias("_nested"),
        F.count_if("_valid").alias("pairs"), F.min(F.when(F.col("_valid"), method)).alias("_method"),
        *([F.min(F.when(F.col("_valid"), F.struct(*event))).alias("_event")] if event else []),
    ).select(
        *keys, low, high, *[F.col(f"_event.{c}").alias(c) for c in event or []],
        F.when(F.col("_named") > 0, F.col("_named")).otherwise(F.greatest("_nested", "pairs")).alias("bookmaker_count"),
        F.when(F.col("pairs") > 1, "median").otherwise(F.coalesce("_method", F.lit("single_source")))
        .alias("aggregation_method"),
    )
    return found if keep_unpriced else found.filter(F.col(low).isNotNull())


def _canonical_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """_k1, _k2: ids of both sides in canonical form, NULL where blank."""
    return df.withColumns({f"_k{i}": canonical_id(F.col(known)) for i, known in enumerate(ids, 1)})


def _canonical_names(df: DataFrame, names: list[str], aliases: DataFrame | None) -> DataFrame:
    """_k1, _k2: names of both sides in canonical form, NULL where blank."""
    for i, name in enumerate(names, 1):
        df = df.withColumn(f"_k{i}", normalize_name(F.col(name))) if aliases is None else canonical_name(df, name, aliases, f"_k{i}")
        df = df.withColumn(f"_k{i}", F.nullif(f"_k{i}", F.lit("")))
    return df


def _pair(df: DataFrame) -> DataFrame:
    """_lo, _hi: the unordered pair of `_k1` and `_k2`, NULL where one is missing; _first: whether the first side is the lower one."""
    both = F.col("_k1").isNotNull() & F.col("_k2").isNotNull()
    return df.withColumns({
        "_lo": F.when(both, F.least("_k1", "_k2")), "_hi": F.when(both, F.greatest("_k1", "_k2")), "_first": F.col("_k1") <= F.col("_k2")}).drop("_k1", "_k2")


def join_predictions(
    pred: DataFrame, odds: DataFrame, captured: str = "captured_at", min_bookmakers: int = 1, aliases: DataFrame | None = None,
) -> DataFrame:
    """Each prediction with the consensus price of its date and pair, sides aligned to p1 and p2.

    The pair is unordered. Ids decide where both sides have them, names where the ids find nothing; both are compared in
    canonical form, names after `aliases(alias, canonical)` where given. tournament and surface, where the odds have them,
    are those of the least priced row. Predictions meet the prices by id first. Only those that are left meet prices by name, and
    only odds of their dates and names are collapsed for them.
    """
    event = [c for c in ("tournament", "surface") if c in odds.columns]
    used = [c for c in (captured, "bookmaker", "bookmaker_count", "aggregation_method", *event) if c in odds.columns]
    day = F.col("match_date").alias("_day")

    def priced(mine: DataFrame, quoted: DataFrame) -> DataFrame:
        rows = quoted.filter("_lo IS NOT NULL").select(
            day, *used, "_lo", "_hi", F.when(F.col("_first"), F.col("odds_p1")).otherwise(F.col("odds_p2")).alias("odds_lo"),
            F.when(F.col("_first"), F.col("odds_p2")).otherwise(F.col("odds_p1")).alias("odds_hi"))
        prices = market_consensus(rows, ["_day", "_lo", "_hi"], captured, "odds_lo", "odds_hi", True, event).select(
            "_day", "_lo", "_hi", F.struct("odds_lo", "odds_hi", "bookmaker_count", "aggregation_method", *event).alias("_price"))
        return mine.withColumn("_day", day).join(prices, ["_day", "_lo", "_hi"], "left").drop("_day", "_lo", "_hi")

    out = materialize(priced(_pair(_canonical_ids(pred, ["p1_id", "p2_id"])), _pair(_canonical_ids(odds, ["o1_id", "o2_id"]))))
    still = out.filter("_price IS NULL")
    if not still.isEmpty():
        still = _pair(_canonical_names(still.select(*pred.columns), ["p1_name", "p2_name"], aliases))
        asked = still.filter("_lo IS NOT NULL").select("match_date", "_lo", "_hi").distinct()
        quoted = _pair(_canonical_names(odds, ["o1_name", "o2_name"], aliases)).join(asked, ["match_date", "_lo", "_hi"], "left_semi")
        out = out.filter("_price IS NOT NULL").unionByName(priced(still, quoted))
    return out.filter(F.col("_price.odds_lo").isNotNull() & (F.col("_price.bookmaker_count") >= min_bookmakers)).select(
        *[c for c in pred.columns if c not in event], *[F.col(f"_price.{c}").alias(c) for c in event],
        F.when(F.col("_first"), F.col("_price.odds_lo")).otherwise(F.col("_price.odds_hi")).alias("odds_p1"),
        F.when(F.col("_first"), F.col("_price.odds_hi")).otherwise(F.col("_price.odds_lo")).alias("odds_p2"),
        F.col("_price.bookmaker_count").alias("bookmaker_count"), F.col("_price.aggregation_method").alias("aggregation_method"))


def movement_key(match_id: Column, day: Column, tour: Column, name_1: Column, name_2: Column) -> Column:
    """The match a snapshot is of: its id, or date, tour and names where it has none."""
    given = F.nullif(F.trim(match_id.cast("string")), F.lit(""))
    parts = [day.cast("string"), F.lower(tour), F.lower(name_1), F.lower(name_2)]
    return F.coalesce(given, F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def _keyed(keys: list[str]) -> Column:
    """Rows that belong to some history: one without a key shares none."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def asof_previous(
    current: DataFrame, past: DataFrame, keys: list[str], time: str, values: list[str], day: Column | None = None,
    **history,
) -> DataFrame:
    """For each current row the latest row of `past` with the same key and a strictly earlier time.

    Both tables go through one ordered pass; past rows of the same instant sort after current ones. A row with a NULL in
    its key has no predecessor and is none.
    """
    alone, current, past = current.filter(~_keyed(keys)), current.filter(_keyed(keys)), past.filter(_keyed(keys))
    packed = F.struct(F.col(time).alias("time"), *values)
    mine = current.withColumns({"_mine": F.lit(True), "_past": F.lit(None), "_rank": F.lit(0)})
    theirs = past.select(*keys, time, packed.alias("_past")).withColumns({"_mine": F.lit(False), "_rank": F.lit(1)})
    rows = mine.withColumn("_past", F.lit(None).cast(theirs.schema["_past"].dataType)).unionByName(
        theirs, allowMissingColumns=True)
    rows = rows.withColumn("_day", day if day is not None else F.col(time).cast("date"))
    done = History(rows, keys, "_day", [time, "_rank"], **history).add(PrefixLast("_prev", F.col("_past"))).result()
    found = done.filter("_mine").select(
        *current.columns, F.col("_prev.time").alias(f"prev_{time}"),
        *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values])
    return found.unionByName(alone, allowMissingColumns=True)


def odds_movement(odds: DataFrame, keys: list[str], time: str, history_odds: DataFrame | None = None, **history) -> DataFrame:
    """Change of each snapshot against the one before it of the same key, and the direction of the market.

    Snapshots without a match id need a key of other columns (`movement_key`); with a NULL key they have no predecessor.
    """
    prev = f"prev_{time}"
    if history_odds is None:
        rows = odds.filter(_keyed(keys)).withColumn("_day", F.col(time).cast("date"))
        rows = History(rows, keys, "_day", [time], **history).add(
            PrefixLast("_prev", F.struct(F.col(time).alias("t"), "odds_p1", "odds_p2"))).result()
        rows = rows.select(
            *odds.columns, F.col("_prev.t").alias(prev),
            F.col("_prev.odds_p1").alias("prev_odds_p1"), F.col("_prev.odds_p2").alias("prev_odds_p2"))
        rows = rows.unionByName(odds.filter(~_keyed(keys)), allowMissingColumns=True)
    else:
        rows = asof_previous(odds, history_odds, keys, time, ["odds_p1", "odds_p2"], **history)
    d1, d2 = F.col("odds_p1") - F.col("prev_odds_p1"), F.col("odds_p2") - F.col("prev_odds_p2")
    micros = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(prev).cast("timestamp"))
    return rows.withColumns({
        "hours_since_previous": micros / 3.6e9,
        "odds_p1_delta": d1, "odds_p2_delta": d2,
        "odds_p1_pct": d1 / F.nullif("prev_odds_p1", F.lit(0.0)), "odds_p2_pct": d2 / F.nullif("prev_odds_p2", F.lit(0.0)),
        "market_move": movement_class(d1, d2),
    })


def with_fair_prices(df: DataFrame, odds_1: str = "odds_p1", odds_2: str = "odds_p2") -> DataFrame:
    """Margin-free probabilities of both sides.

    The exponent is a generated column, so that it is solved once per row and not again in every
    filter and column that uses it.
    """
    o1, o2 = F.col(odds_1), F.col(odds_2)
    solved = df.withColumn("_k", F.explode(F.array(power_exponent(o1, o2))))
    return solved.withColumns(remove_overround(o1, o2, F.col("_k"))).drop("_k")


def with_edges(df: DataFrame, prob: str = "prob", odds_1: str = "odds_p1", odds_2: str = "odds_p2") -> DataFrame:
    return with_fair_prices(df, odds_1, odds_2).withColumns(score_edges(
        F.col(prob), F.col("fair_p1"), F.col("fair_p2"), F.col(odds_1), F.col(odds_2)))


def allocate_daily(
    bets: DataFrame, day: list[str], tie_break: list[str], capital: Column | float,
    n: int = MAX_DAILY_BETS, cap: float = MAX_DAILY_SHARE,
) -> DataFrame:
    """The best n bets of each day with stakes: quarter Kelly, scaled to the daily cap.

    Ranking trims each day to n rows before the shuffle; the sums then run over at most n rows.
    """
    capital = capital if isinstance(capital, Column) else F.lit(float(capital))
    bets = bets.withColumns(kelly(F.col("selected_prob"), F.col("selected_odds")))
    best = Window.partitionBy(*day).orderBy(
        F.col("kelly_share").desc(), F.col("selected_edge").desc(), *[F.col(c) for c in tie_break])
    whole = Window.partitionBy(*day)
    top = bets.withColumn("pick", F.row_number().over(best)).filter(F.col("pick") <= n)
    top = top.withColumn("raw_share", F.least(F.greatest("kelly_share", F.lit(0.0)), F.lit(cap)))
    total = F.sum("raw_share").over(whole)
    top = top.withColumn("share", F.when(total > cap, F.col("raw_share") * (F.lit(cap) / total)).otherwise(F.col("raw_share")))
    stake = F.when((capital > 0) & (F.col("share") > 0), F.greatest(cents(capital * F.col("share")), F.lit(MIN_STAKE)))
    top = top.withColumn("stake", F.coalesce(stake, F.lit(0.0)))
    staked, limit = F.sum("stake").over(whole), capital * cap
    shrunk = cents(F.col("stake") * (limit / staked))
    shrunk = F.when(shrunk > 0, F.greatest(shrunk, F.lit(MIN_STAKE))).otherwise(shrunk)
    return top.withColumn("_staked", staked).withColumn(
        "stake", F.when((staked > limit) & (staked > 0), shrunk).otherwise(F.col("stake"))).drop("_staked")


def recommend(
    scored: DataFrame, day: list[str], tie_break: list[str], capital: float, least: float = MIN_EDGE, **limits,
) -> DataFrame:
    """Bets whose edge reaches the threshold, with daily stakes."""
    return allocate_daily(scored.filter(F.col("selected_edge") >= least), day, tie_break, capital, **limits)


def recommendation_status(scored: DataFrame, by: list[str], tie_break: str, least: float = MIN_EDGE) -> DataFrame:
    """Per group: rows looked at, value bets, the status, and the closest miss when there is none."""
    best = F.max_by(F.struct(tie_break, "selected_edge"), F.struct("selected_edge", tie_break))
    return scored.groupBy(*by).agg(
        F.count("*").alias("analysed"), F.count_if(F.col("selected_edge") >= least).alias("value_bets"),
        best.alias("_best"),
    ).select(
        *by, "analysed", "value_bets",
        F.when(F.col("value_bets") > 0, "value").otherwise("skip").alias("status"),
        F.when(F.col("value_bets") == 0, F.col(f"_best.{tie_break}")).alias("closest_key"),
        F.when(F.col("value_bets") == 0, F.col("_best.selected_edge")).alias("closest_edge"))


def closest_miss(scored: DataFrame, tie_break: str, least: float = MIN_EDGE) -> DataFrame:
    """The row with the largest edge when no row reaches the threshold, else no row."""
    top = scored.agg(F.max("selected_edge")).scalar()
    return scored.filter(top < least).orderBy(F.col("selected_edge").desc(), tie_break).limit(1)


def validate_odds(
    df: DataFrame, prices: list[str], id_prefix: str, row_id: str, now: str, tours: tuple[str, ...] = ("atp", "wta"),
    default_tour: str | None = None,
) -> DataFrame:
    """Uploaded odds with clean types, defaults, match ids, and why a row is refused (NULL if it is not).

    Names that were not resolved stand for themselves; a match id is made where there is none, and a missing tour is
    `default_tour`. A row without both players' names is refused.
    """

    def given(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    out = df.withColumns({
        "tour": F.coalesce(F.nullif(F.lower(F.trim("tour")), F.lit("")), F.lit(default_tour)), **{c: F.trim(c).try_cast("double") for c in prices},
        "match_date": F.trim("match_date").try_cast("date"),
        "match_id": F.coalesce(given("match_id").cast("string"), F.concat(F.lit(f"{id_prefix}-"), F.col(row_id).cast("string"))),
        **{name: F.coalesce(given(name), F.lit(value)) for name, value in UPLOAD_DEFAULTS.items()},
        **{f"player_{i}_resolved": F.coalesce(given(f"player_{i}_resolved"), given(f"player_{i}")) for i in (1, 2)},
        "captured_at": F.lit(now),
    })
    bad_price = F.lit(False)
    for c in prices:
        bad_price = bad_price | F.coalesce(F.col(c) <= 1.0, F.lit(True))
    nameless = F.lit(False)
    for i in (1, 2):
        nameless = nameless | F.coalesce(F.trim(given(f"player_{i}")) == "", F.lit(True))
    return out.withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.col("tour").isin(*tours), F.lit(False)), "tour").when(bad_price, "odds")
        .when(F.col("match_date").isNull(), "match_date").when(nameless, "players"))
