"""Quality of probabilities and bets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutwise.operators.quantiles import higher_quantile

# Tier order of reports, and the edges of the probability buckets.
TIER_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
BUCKET_EDGES = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00]
# Fixed value: the drop of recent against overall return that raises the drift flag.
DRIFT_DROP = 0.10
CLIP = 1e-15


def calibration_bins(df: DataFrame, prob: str, label: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins: rows, mean prediction, mean outcome and their gap."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return (
        df.groupBy(*(by or []), b.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(prob).alias("avg_pred"), F.avg(label).alias("avg_true"))
        .withColumn("abs_gap", F.abs(F.col("avg_true") - F.col("avg_pred")))
    )


def expected_calibration_error(df: DataFrame, prob: str, label: str, by: list[str]) -> DataFrame:
    return calibration_bins(df, prob, label, by).groupBy(*by).agg(
        (F.sum(F.col("abs_gap") * F.col("n")) / F.sum("n")).alias("ece"))


def _log_loss(prob: Column, label: Column) -> Column:
    p = F.greatest(F.least(prob, F.lit(1 - CLIP)), F.lit(CLIP))
    return -F.when(label == 1, F.log(p)).otherwise(F.log(1.0 - p))


def metric_pack(df: DataFrame, prob: str, label: str, by: list[str]) -> DataFrame:
    """Accuracy, log-loss, Brier score and calibration error per group."""
    p, y = F.col(prob), F.col(label)
    base = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg(_log_loss(p, y)).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"))
    return base.join(expected_calibration_error(df, prob, label, by), by)


def melt(df: DataFrame, columns: list[str], keep: list[str], name: str = "model", value: str = "prob") -> DataFrame:
    """One row per named column."""
    return df.unpivot(keep, columns, name, value)


def conformal_radius(df: DataFrame, prob: str, label: str, alpha: float = 0.10, by: list[str] | None = None) -> DataFrame:
    """Split-conformal radius, its coverage and mean width; the radius is an exact order statistic."""
    keys = by or []
    p = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.select(*keys, F.col(label).cast("double").alias("y"), p.alias("p")).withColumn(
        "radius", F.abs(F.col("y") - F.col("p")))
    # The level is a share of n; the order statistic it points at counts from the first of n values.
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))
    rank = F.least(F.ceil((F.col("n") - 1) * level).cast("long") + 1, F.col("n"))
    keyed = rows if keys else rows.withColumn("_all", F.lit(0))
    keys = keys or ["_all"]
    radius = higher_quantile(keyed, keys, "radius", rank)
    lower, upper = F.greatest(F.col("p") - F.col("r"), F.lit(0.0)), F.least(F.col("p") + F.col("r"), F.lit(1.0))
    return (
        keyed.drop("radius").join(radius.withColumnRenamed("radius", "r"), keys).groupBy(*keys)
        .agg(F.count("*").alias("n"), F.max("r").alias("radius"),
             F.avg(F.when((F.col("y") >= lower) & (F.col("y") <= upper), 1.0).otherwise(0.0)).alias("coverage"),
             F.avg(upper - lower).alias("mean_width"))
        .drop("_all")
    )


def overall_metrics(bets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bets, win rate, stake, return and return on investment, which is 0 when nothing was staked."""
    staked, back = F.sum("stake"), F.sum("total_return")
    return bets.groupBy(*(by or [])).agg(
        F.count("*").alias("bets"), F.coalesce(F.avg(F.col("won").cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(staked, F.lit(0.0)).alias("staked"), F.coalesce(back, F.lit(0.0)).alias("returned"),
        F.coalesce(F.try_divide(back - staked, F.nullif(staked, F.lit(0.0))), F.lit(0.0)).alias("roi"))


def tier_stats(bets: DataFrame) -> DataFrame:
    """Per confidence tier, in report order."""
    pairs = [F.lit(x) for item in TIER_ORDER.items() for x in item]
    staked, back = F.sum("stake"), F.sum("total_return")
    return bets.groupBy("confidence_tier").agg(
        F.count("*").alias("n"), F.avg(F.col("won").cast("double")).alias("win_rate"),
        F.avg("selected_edge").alias("avg_edge"),
        F.when(staked > 0, (back - staked) / staked).otherwise(0.0).alias("roi"),
    ).withColumn("tier_order", F.coalesce(F.create_map(*pairs)[F.col("confidence_tier")], F.lit(999))).orderBy(
        "tier_order", "confidence_tier")


def bucket_rates(bets: DataFrame, prob: str, won: str) -> DataFrame:
    """Right-closed probability buckets from 0.50 to 1.00; the lowest includes its lower edge."""
    label = F.lit(None).cast("string")
    for low, high in reversed(list(zip(BUCKET_EDGES, BUCKET_EDGES[1:]))):
        label = F.when(F.col(prob) <= high, f"{low:.2f}-{high:.2f}").otherwise(label)
    inside = F.col(prob).between(BUCKET_EDGES[0], BUCKET_EDGES[-1])
    return bets.filter(inside).groupBy(label.alias("bucket")).agg(
        F.avg(prob).alias("predicted_win_rate"), F.avg(F.col(won).cast("double")).alias("actual_win_rate"),
        F.count("*").alias("n"))


def daily_pnl(bets: DataFrame, day: str, by: list[str] | None = None) -> DataFrame:
    """Profit per day and its running total. The running window sees one row per day."""
    keys = by or []
    daily = bets.groupBy(*keys, day).agg(F.sum("bet_pnl").alias("daily_pnl"))
    upto = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative_pnl", F.sum("daily_pnl").over(upto))


def drift(bets: DataFrame, day: str, days: int = 30) -> DataFrame:
    """Return of the last days, counted back from the latest bet, against the overall return."""
    cutoff = bets.agg(F.date_sub(F.max(day), days - 1)).scalar()
    recent = F.col(day) >= cutoff

    def roi(condition: Column) -> Column:
        staked = F.sum(F.when(condition, F.col("stake")))
        back = F.sum(F.when(condition, F.col("total_return")))
        return F.coalesce(F.try_divide(back - staked, F.nullif(staked, F.lit(0.0))), F.lit(0.0))

    return bets.agg(
        F.count_if(recent).alias("recent_bets"), roi(recent).alias("recent_roi"), roi(F.lit(True)).alias("overall_roi"),
    ).withColumn("drift_flag", F.col("recent_roi") <= F.col("overall_roi") - DRIFT_DROP)


def target_summary(df: DataFrame, split: str, label: str, day: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("target_mean"),
        F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones"),
        F.min(day).alias("date_min"), F.max(day).alias("date_max"))


def forecast_stats(
    bets: DataFrame, day: str, now: Column, capital: float, share: float = 0.25, lookback: int = 90, least: int = 30,
) -> DataFrame:
    """Hit rate, edge with its 95 % range, and 30-day growth at the low, expected and high edge."""
    edge = F.col("edge")
    recent = bets.filter((F.col(day) >= F.date_sub(now, lookback)) & F.col("edge").isNotNull())
    stats = recent.agg(
        F.count("*").alias("n"), F.count_distinct(day).alias("days"), F.avg(edge).alias("avg_edge"),
        F.coalesce(F.stddev_samp(edge), F.lit(0.0)).alias("edge_std"),
        F.coalesce(F.avg(F.when(F.col("result").isin("win", "loss"), (F.col("result") == "win").cast("double"))),
                   F.lit(0.0)).alias("hit_rate"))
    stats = stats.filter(F.col("n") >= least).withColumns({
        "bets_per_day": F.col("n") / F.greatest("days", F.lit(1)),
        "edge_ci": 1.96 * F.col("edge_std") / F.sqrt(F.col("n").cast("double")),
    })

    def daily(e: Column) -> Column:
        return F.greatest(F.col("bets_per_day") * share * e, F.lit(-0.99))

    levels = {"low": F.col("avg_edge") - F.col("edge_ci"), "expected": F.col("avg_edge"),
              "high": F.col("avg_edge") + F.col("edge_ci")}
    return stats.select(
        "n", "hit_rate", "avg_edge", "edge_std", "edge_ci", "bets_per_day",
        *[daily(e).alias(f"{k}_daily_return") for k, e in levels.items()],
        *[(F.lit(capital) * F.pow(1.0 + daily(e), F.lit(30.0))).alias(f"{k}_capital") for k, e in levels.items()])


def cv_compare(fold_metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation over folds, ranked by mean log-loss; rank 1 wins."""
    out = fold_metrics.groupBy(*by).agg(
        F.count("*").alias("folds"),
        *[f(m).alias(f"{m}_{n}") for m in ("log_loss", "brier", "accuracy")
          for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    # One row per model: the ranking window sees as many rows as there are models.
    return out.withColumn("rank", F.rank().over(Window.orderBy("log_loss_mean"))).withColumn("winner", F.col("rank") == 1)


def quality_report(df: DataFrame, key: list[str], expected: list[str], id_column: str, day8: str, score: str) -> DataFrame:
    """Missing columns, duplicate keys, malformed ids, dates and scores, tournaments and date span."""
    missing = sorted(set(expected) - set(df.columns))
    text = [F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in key]
    # A tournament's rows may be a large share of all rows: keys are counted before they meet.
    keys = df.groupBy(F.concat_ws("|", *text).alias("k")).agg(F.count("*").alias("c"))
    dupes = keys.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).scalar()
    valid_day = F.try_to_timestamp(F.col(day8).cast("string"), F.lit("yyyyMMdd")).isNotNull() \
        & (F.length(F.col(day8).cast("string")) == 8)
    tournaments = df.select(F.col("tourney_id")).distinct().agg(F.count("tourney_id")).scalar()
    return df.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(id_column).cast("string").rlike("[^0-9.]")).alias("malformed_ids"),
        F.count_if(F.col(day8).isNotNull() & ~valid_day).alias("malformed_dates"),
        F.count_if(~F.col(score).rlike(r"^[0-9\-() ]+$")).alias("unusual_scores"),
        F.min(day8).alias("first_date"), F.max(day8).alias("last_date"),
    ).select(
        F.lit(",".join(missing)).alias("missing_columns"), dupes.alias("duplicate_rows"),
        tournaments.alias("tournaments"), "*")


def table_fingerprint(df: DataFrame, day: str) -> DataFrame:
    """Rows, latest date and SHA-256 of the column list."""
    columns = "[" + ",".join(f'"{c}"' for c in df.columns) + "]"
    return df.agg(F.count("*").alias("row_count"), F.max(day).alias("date_max")).withColumn(
        "schema_signature", F.sha2(F.lit(columns), 256))


def latest_and_count(df: DataFrame, by: list[str], day: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(day).alias("latest_date"), F.count("*").alias("row_count"))


def snapshot_age(df: DataFrame, captured: str, now: Column) -> DataFrame:
    """Latest capture, its age in hours and the number of rows."""
    return df.agg(F.max(captured).alias("latest"), F.count("*").alias("row_count")).withColumn(
        "age_hours",
        (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 3.6e9)


def leakage_audit(features: DataFrame, rates: list[str], days: list[str]) -> DataFrame:
    """Whether day counts are not negative, rates lie in [0, 1] and meetings add up."""

    def every(c: Column) -> Column:
        return F.coalesce(F.bool_and(c), F.lit(True))

    within, positive = F.lit(True), F.lit(True)
    for c in rates:
        within = within & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    for c in days:
        positive = positive & (F.col(c) >= 0)
    return features.agg(
        F.count("*").alias("row_count"), every(positive).alias("days_non_negative"), every(within).alias("rates_in_bounds"),
        every(F.col("h2h_total") >= F.col("h2h_p1_wins") + F.col("h2h_p2_wins")).alias("h2h_consistent"))


def audit_sample(features: DataFrame, key: str, columns: list[str], n: int = 10) -> DataFrame:
    """A repeatable sample: the n rows with the smallest key digest."""
    return features.orderBy(F.md5(F.col(key)), key).select(*columns).limit(n)
