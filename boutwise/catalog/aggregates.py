"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.expressions import EDGE_SQL, TIER_SQL, edges
from boutwise.catalog.joins import MAKERS, quotes
from boutwise.catalog.registry import query
from boutwise.catalog.sorting import ALLOCATE_SQL
from boutwise.catalog.sources import NEW, OLD, versions
from boutwise.catalog.views import r6, real, twin
from boutwise.catalog.windows import FLAT_SQL, _pairs, flat_curve
from boutwise.functions import market
from boutwise.operators import equity, evaluation, features, keyed, marketplace, ratings
from boutwise.operators.history import History, PrefixLast
from boutwise.sources import merge, tables

KEY = ["match_key"]


def reals(df, *names):
    return df.withColumns({n: real(n) for n in names})


# Settled bets: the better side of each scored match at stake 10, tier by model agreement.
BETS_SQL = EDGE_SQL + f""", bets AS (SELECT match_key, match_date, {TIER_SQL} AS confidence_tier, selected_edge, selected_prob, 10.0 AS stake,
  (bet_side = 'P1') = (p1_wins = 1) AS won, CASE WHEN (bet_side = 'P1') = (p1_wins = 1) THEN 10.0 * selected_odds ELSE 0.0 END AS total_return,
  CASE WHEN (bet_side = 'P1') = (p1_wins = 1) THEN 10.0 * selected_odds ELSE 0.0 END - 10.0 AS bet_pnl FROM edges)"""


def bets(spark, folder):
    rows = edges(spark, folder)
    won = (F.col("bet_side") == "P1") == (F.col("p1_wins") == 1)
    back = F.when(won, 10.0 * F.col("selected_odds")).otherwise(0.0)
    return rows.select(
        "match_key", "match_date", market.confidence_tier(F.abs(F.col("prob_a") - F.col("prob_b"))).alias("confidence_tier"),
        "selected_edge", "selected_prob", F.lit(10.0).alias("stake"), won.alias("won"), back.alias("total_return"),
        (back - 10.0).alias("bet_pnl"))


@query("d01_dedup_last", twin(["master"], "SELECT tour, match_key, match_num FROM master"))
def dedup_last(spark, folder):
    from boutwise.plans.master import derive_columns

    return keyed.latest_per_key(derive_columns(views.raw(spark, folder)), ["tour", "match_key"], ["match_num"]).select("tour", "match_key", "match_num")


@query("d01_dedup_empty_exempt", """SELECT page_id, url FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS url,
 row_number() OVER (PARTITION BY CASE WHEN page_id % 5 = 0 THEN CAST(page_id AS VARCHAR) ELSE url END ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1""")
def dedup_empty_exempt(spark, folder):
    p = views.table(spark, folder, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("url"))
    return keyed.latest_per_key(p, ["url"], ["page_id"], exempt_empty=True)


@query("d02_market_consensus", twin(["scored"], MAKERS + f""", al AS (SELECT match_date, least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi, CASE WHEN a_id <= b_id THEN oa ELSE ob END AS o1,
  CASE WHEN a_id <= b_id THEN ob ELSE oa END AS o2, bookmaker, hour, max(hour) OVER (PARTITION BY match_date, least(a_id, b_id), greatest(a_id, b_id)) AS mh FROM od)
SELECT match_date, lo, hi, {r6('median(o1)')} AS o1, {r6('median(o2)')} AS o2,
 CAST(CASE WHEN count(DISTINCT CASE WHEN bookmaker <> 'flashscore_event_page' THEN bookmaker END) > 0 THEN count(DISTINCT CASE WHEN bookmaker <> 'flashscore_event_page' THEN bookmaker END) ELSE count(*) END AS BIGINT) AS bookmaker_count,
 CASE WHEN count(*) > 1 THEN 'median' ELSE 'single_source' END AS aggregation_method FROM al WHERE hour = mh AND o1 > 1 AND o2 > 1 GROUP BY 1, 2, 3"""))
def market_consensus(spark, folder):
    q = quotes(spark, folder).withColumns({
        "lo": F.least("a_id", "b_id"), "hi": F.greatest("a_id", "b_id"),
        "o1": F.when(F.col("a_id") <= F.col("b_id"), F.col("oa")).otherwise(F.col("ob")),
        "o2": F.when(F.col("a_id") <= F.col("b_id"), F.col("ob")).otherwise(F.col("oa"))})
    return reals(marketplace.market_consensus(q, ["match_date", "lo", "hi"], "hour", "o1", "o2"), "o1", "o2")


@query("d03_tier_stats", twin(["scored"], BETS_SQL + f""" SELECT confidence_tier, count(*) AS n, {r6('avg(CAST(won AS INT))')} AS win_rate, {r6('avg(selected_edge)')} AS avg_edge,
 {r6('(sum(total_return) - sum(stake)) / sum(stake)')} AS roi, CASE confidence_tier WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS tier_order FROM bets GROUP BY confidence_tier ORDER BY tier_order"""))
def tier_stats(spark, folder):
    return reals(evaluation.tier_stats(bets(spark, folder)), "win_rate", "avg_edge", "roi")


@query("d04_calibration_bins", twin(["scored"], f""", b AS (SELECT CAST(least(floor(prob * 10), 9) AS INT) AS bin, count(*) AS n, avg(prob) AS p, avg(p1_wins) AS y FROM scored GROUP BY 1)
SELECT bin, n, {r6('p')} AS avg_pred, {r6('y')} AS avg_true, {r6('abs(y - p)')} AS abs_gap, {r6('(SELECT sum(abs(y - p) * n) / sum(n) FROM b)')} AS ece FROM b"""))
def calibration_bins(spark, folder):
    s = views.scored(spark, folder).withColumn("m", F.lit("m"))
    bins = evaluation.calibration_bins(s, "prob", "p1_wins", ["m"])
    ece = bins.groupBy("m").agg((F.sum(F.col("abs_gap") * F.col("n")) / F.sum("n")).alias("ece"))
    return reals(bins.join(ece, "m").drop("m"), "avg_pred", "avg_true", "abs_gap", "ece")


@query("d05_bucket_rates", twin(["scored"], EDGE_SQL + f""", b AS (SELECT selected_prob AS p, CASE WHEN (bet_side = 'P1') = (p1_wins = 1) THEN 1.0 ELSE 0.0 END AS won, greatest(ceil(selected_prob * 20 - 1e-9) - 1, 10) AS i FROM edges WHERE selected_prob BETWEEN 0.5 AND 1.0)
SELECT CASE CAST(i AS INT) WHEN 10 THEN '0.50-0.55' WHEN 11 THEN '0.55-0.60' WHEN 12 THEN '0.60-0.65' WHEN 13 THEN '0.65-0.70' WHEN 14 THEN '0.70-0.75' WHEN 15 THEN '0.75-0.80'
 WHEN 16 THEN '0.80-0.85' WHEN 17 THEN '0.85-0.90' WHEN 18 THEN '0.90-0.95' ELSE '0.95-1.00' END AS bucket, {r6('avg(p)')} AS predicted_win_rate, {r6('avg(won)')} AS actual_win_rate, count(*) AS n FROM b GROUP BY 1"""))
def bucket_rates(spark, folder):
    return reals(evaluation.bucket_rates(bets(spark, folder), "selected_prob", "won"), "predicted_win_rate", "actual_win_rate")


OVERALL = f"""count(*) AS bets, {r6('avg(CAST(won AS INT))')} AS win_rate, {r6('sum(stake)')} AS staked, {r6('sum(total_return)')} AS returned, {r6('(sum(total_return) - sum(stake)) / sum(stake)')} AS roi"""


@query("d06_overall_metrics", twin(["scored"], BETS_SQL + f" SELECT {OVERALL} FROM bets"))
def overall_metrics(spark, folder):
    return reals(evaluation.overall_metrics(bets(spark, folder)), "win_rate", "staked", "returned", "roi")


@query("d07_daily_pnl", twin(["scored"], BETS_SQL + f""", d AS (SELECT match_date, sum(bet_pnl) AS p FROM bets GROUP BY 1)
SELECT match_date, {r6('p')} AS daily_pnl, {r6('sum(p) OVER (ORDER BY match_date)')} AS cumulative_pnl FROM d"""))
def daily_pnl(spark, folder):
    return reals(evaluation.daily_pnl(bets(spark, folder), "match_date"), "daily_pnl", "cumulative_pnl")


@query("d08_drift", twin(["scored"], BETS_SQL + f""", m AS (SELECT max(match_date) - 29 AS c FROM bets), r AS (SELECT count_if(match_date >= c) AS n, sum(CASE WHEN match_date >= c THEN total_return END) AS rb,
  sum(CASE WHEN match_date >= c THEN stake END) AS rs, sum(total_return) AS b, sum(stake) AS s FROM bets, m)
SELECT CAST(n AS BIGINT) AS recent_bets, {r6('(rb - rs) / rs')} AS recent_roi, {r6('(b - s) / s')} AS overall_roi, (rb - rs) / rs <= (b - s) / s - 0.10 AS drift_flag FROM r"""))
def drift(spark, folder):
    return reals(evaluation.drift(bets(spark, folder), "match_date"), "recent_roi", "overall_roi")


LONG_SQL = """, mm AS (SELECT 'a' AS model, match_key, match_date, p1_wins AS y, prob_a AS p FROM scored UNION ALL SELECT 'b', match_key, match_date, p1_wins, prob_b FROM scored UNION ALL SELECT 'blend', match_key, match_date, p1_wins, prob FROM scored)"""


def model_rows(spark, folder):
    s = views.scored(spark, folder).select(
        "match_key", "match_date", F.col("p1_wins").alias("y"), F.col("prob_a").alias("a"), F.col("prob_b").alias("b"), F.col("prob").alias("blend"))
    return evaluation.melt(s, ["a", "b", "blend"], ["match_key", "match_date", "y"], "model", "p")


METRICS = ("avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)", "avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1.0 - p) END)", "avg((p - y) * (p - y))")


@query("d09_metric_pack", twin(["scored"], LONG_SQL + f""", e AS (SELECT model, sum(g * n) / sum(n) AS ece FROM (SELECT model, least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(y) - avg(p)) AS g FROM mm GROUP BY 1, 2) GROUP BY 1)
SELECT mm.model, count(*) AS n, {r6(METRICS[0])} AS accuracy, {r6(METRICS[1])} AS log_loss, {r6(METRICS[2])} AS brier, {r6('max(ece)')} AS ece FROM mm JOIN e ON e.model = mm.model GROUP BY mm.model"""))
def metric_pack(spark, folder):
    return reals(evaluation.metric_pack(model_rows(spark, folder), "p", "y", ["model"]), "accuracy", "log_loss", "brier", "ece")


@query("d10_conformal_radius", twin(["scored"], LONG_SQL + f""", c AS (SELECT model, CAST(y AS DOUBLE) AS y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM mm),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(y - p)) AS rn, count(*) OVER (PARTITION BY model) AS n FROM c),
q AS (SELECT model, abs(y - p) AS rad FROM r WHERE rn = least(n, CAST(ceil((n - 1) * least(1.0, ceil((n + 1) * 0.9) / n)) AS BIGINT) + 1))
SELECT c.model, count(*) AS n, {r6('max(rad)')} AS radius, {r6('avg(CASE WHEN y >= greatest(p - rad, 0) AND y <= least(p + rad, 1) THEN 1.0 ELSE 0.0 END)')} AS coverage,
 {r6('avg(least(p + rad, 1) - greatest(p - rad, 0))')} AS mean_width FROM c JOIN q ON q.model = c.model GROUP BY c.model"""))
def conformal_radius(spark, folder):
    return reals(evaluation.conformal_radius(model_rows(spark, folder), "p", "y", by=["model"]), "radius", "coverage", "mean_width")


@query("d11_target_summary", twin(["scored"], f"""SELECT CASE WHEN match_date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n, {r6('avg(p1_wins)')} AS target_mean,
 CAST(count_if(p1_wins = 0) AS BIGINT) AS zeros, CAST(count_if(p1_wins = 1) AS BIGINT) AS ones, min(match_date) AS date_min, max(match_date) AS date_max FROM scored GROUP BY 1"""))
def target_summary(spark, folder):
    s = views.scored(spark, folder).withColumn("split", F.when(F.col("match_date") < "1999-01-01", "train").otherwise("test"))
    return reals(evaluation.target_summary(s, "split", "p1_wins", "match_date"), "target_mean")


@query("d12_forecast_stats", twin(["scored"], EDGE_SQL + f""", f AS (SELECT match_date, selected_edge AS edge, CASE WHEN tourney_id % 9 = 0 THEN 'push' WHEN (bet_side = 'P1') = (p1_wins = 1) THEN 'win' ELSE 'loss' END AS result FROM edges
  WHERE match_date >= DATE '1999-03-01' - 90),
g AS (SELECT count(*) AS n, count(DISTINCT match_date) AS d, avg(edge) AS e, stddev_samp(edge) AS s, avg(CASE WHEN result IN ('win', 'loss') THEN CASE WHEN result = 'win' THEN 1.0 ELSE 0.0 END END) AS h FROM f),
i AS (SELECT *, n / d AS bpd, 1.96 * s / sqrt(n) AS ci FROM g WHERE n >= 30),
j AS (SELECT *, greatest(bpd * 0.001 * (e - ci), -0.99) AS lo, greatest(bpd * 0.001 * e, -0.99) AS ex, greatest(bpd * 0.001 * (e + ci), -0.99) AS hi FROM i)
SELECT n, {r6('h')} AS hit_rate, {r6('e')} AS avg_edge, {r6('s')} AS edge_std, {r6('ci')} AS edge_ci, {r6('bpd')} AS bets_per_day, {r6('lo')} AS low_daily_return, {r6('ex')} AS expected_daily_return,
 {r6('hi')} AS high_daily_return, {r6('100 * pow(1 + lo, 30.0)')} AS low_capital, {r6('100 * pow(1 + ex, 30.0)')} AS expected_capital, {r6('100 * pow(1 + hi, 30.0)')} AS high_capital FROM j"""))
def forecast_stats(spark, folder):
    rows = edges(spark, folder)
    won = (F.col("bet_side") == "P1") == (F.col("p1_wins") == 1)
    rows = rows.select("match_date", F.col("selected_edge").alias("edge"), F.when(
        F.col("tourney_id") % 9 == 0, "push").when(won, "win").otherwise("loss").alias("result"))
    out = evaluation.forecast_stats(rows, "match_date", F.lit("1999-03-01").cast("date"), 100.0, share=0.001)
    return reals(out, *[c for c in out.columns if c != "n"])


@query("d13_table_fingerprint", """SELECT count(*) AS row_count, max(o_orderdate) AS date_max,
 sha256('["o_orderkey","o_custkey","o_orderstatus","o_totalprice","o_orderdate","o_orderpriority"]') AS schema_signature FROM orders""")
def table_fingerprint(spark, folder):
    return evaluation.table_fingerprint(views.table(spark, folder, "orders"), "o_orderdate")


@query("d14_quality_report", twin(["raw"], """, m AS (SELECT *, CASE WHEN tourney_id % 17 = 0 THEN 'X' || winner_id ELSE CAST(winner_id AS VARCHAR) END AS wid FROM raw),
k AS (SELECT count(*) AS c FROM m GROUP BY tourney_id, wid, loser_id, coalesce(score, 'nan'))
SELECT 'minutes,winner_entry' AS missing_columns, CAST((SELECT sum(c - 1) FROM k) AS BIGINT) AS duplicate_rows, (SELECT count(DISTINCT tourney_id) FROM m) AS tournaments, count(*) AS row_count,
 CAST(count_if(wid LIKE 'X%') AS BIGINT) AS malformed_ids, CAST(count_if(try_strptime(tourney_date, '%Y%m%d') IS NULL) AS BIGINT) AS malformed_dates,
 CAST(count_if(score IS NOT NULL AND NOT regexp_full_match(score, '[0-9\\-() ]+')) AS BIGINT) AS unusual_scores, min(tourney_date) AS first_date, max(tourney_date) AS last_date FROM m"""))
def quality_report(spark, folder):
    rows = views.raw(spark, folder)
    rows = rows.withColumn("winner_id", F.when(F.col("tourney_id") % 17 == 0, F.concat(F.lit("X"), "winner_id")).otherwise(F.col("winner_id").cast("string")))
    return evaluation.quality_report(
        rows, ["tourney_id", "winner_id", "loser_id", "score"], [*rows.columns, "winner_entry", "minutes"], "winner_id", "tourney_date", "score")


AUDIT_SQL = twin(["bouts"], """, w AS (SELECT match_key, least(winner_id, loser_id) AS p1_id, greatest(winner_id, loser_id) AS p2_id, CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END AS y, match_date, tourney_id, match_num FROM bouts),
h AS (SELECT coalesce(sum(y) OVER w1, 0) AS a, coalesce(sum(1 - y) OVER w1, 0) AS b, count(*) OVER w1 AS t, match_date - max(match_date) OVER w1 AS days FROM w
 WINDOW w1 AS (PARTITION BY p1_id, p2_id ORDER BY match_date, tourney_id, match_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT count(*) AS row_count, bool_and(coalesce(days >= 0, true)) AS days_non_negative, bool_and(t = 0 OR a / t BETWEEN 0 AND 1) AS rates_in_bounds, bool_and(t >= a + b) AS h2h_consistent FROM h""")


def audited(spark, folder):
    """Pairs with their earlier meetings and the days since the last of them."""
    rows = features.head_to_head(_pairs(spark, folder), surface=False)
    rows = History(rows, ["p1_id", "p2_id"], "match_date", ["tourney_id", "match_num"]).add(PrefixLast("_last", F.col("match_date"))).result()
    return rows.withColumn("days_since_meeting", F.datediff("match_date", "_last"))


@query("d15_leakage_audit", AUDIT_SQL)
def leakage_audit(spark, folder):
    return evaluation.leakage_audit(audited(spark, folder), ["h2h_p1_win_pct"], ["days_since_meeting"])


@query("d15_audit_sample", twin(["bouts"], "SELECT match_key, match_date FROM bouts ORDER BY md5(match_key), match_key LIMIT 10"))
def audit_sample(spark, folder):
    return evaluation.audit_sample(views.bouts(spark, folder), "match_key", ["match_key", "match_date"])


@query("d16_coverage", twin(["raw"], f"SELECT {r6('(count(winner_ioc) + count(loser_ioc)) / (2 * count(*))')} AS coverage, 2 * count(*) AS slots FROM raw"))
def coverage(spark, folder):
    rows = views.raw(spark, folder).select(F.col("winner_ioc").alias("p1_ioc"), F.col("loser_ioc").alias("p2_ioc"))
    return reals(features.country_coverage(rows), "coverage")


@query("d17_latest_and_count", twin(["master"], "SELECT tour, max(match_date) AS latest_date, count(*) AS row_count FROM master GROUP BY tour"))
def latest_and_count(spark, folder):
    from boutwise.plans.master import build_master

    return evaluation.latest_and_count(build_master(views.raw(spark, folder)), ["tour"], "match_date")


FOLDS_SQL = """, fm AS (SELECT model, year(match_date) AS fold, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1.0 - p) END) AS log_loss, avg((p - y) * (p - y)) AS brier,
  avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM mm GROUP BY 1, 2)"""


@query("d19_cv_compare", twin(["scored"], LONG_SQL + FOLDS_SQL + f""", c AS (SELECT model, count(*) AS folds, {", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in ("log_loss", "brier", "accuracy"))} FROM fm GROUP BY 1)
SELECT model, folds, {", ".join(f"{r6(f'{m}_{n}')} AS {m}_{n}" for m in ("log_loss", "brier", "accuracy") for n in ("mean", "std"))}, CAST(rank() OVER (ORDER BY c.log_loss_mean) AS INT) AS rank, rank() OVER (ORDER BY c.log_loss_mean) = 1 AS winner FROM c"""))
def cv_compare(spark, folder):
    rows = model_rows(spark, folder).withColumn("fold", F.year("match_date"))
    out = evaluation.cv_compare(evaluation.metric_pack(rows, "p", "y", ["model", "fold"]), ["model"])
    return reals(out, *[f"{m}_{n}" for m in ("log_loss", "brier", "accuracy") for n in ("mean", "std")])


@query("d20_topk_per_group", """SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 8""")
def topk_per_group(spark, folder):
    rows = keyed.top_per_group(views.table(spark, folder, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 8)
    return rows.select("p_brand", "p_partkey", "p_retailprice")


@query("d21_rating_snapshot", twin(["pm"], f""", e AS (SELECT player_id, CASE surface WHEN 'A' THEN 'Hard' WHEN 'N' THEN 'Clay' ELSE 'Sand' END AS surface, match_date, tourney_id, match_num, 1500 + svpt AS o, 1500 + stat2 AS s FROM pm),
r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, tourney_id DESC, match_num DESC) AS ro,
  row_number() OVER (PARTITION BY player_id, surface ORDER BY match_date DESC, tourney_id DESC, match_num DESC) AS rs FROM e)
SELECT player_id, 'ALL' AS surface, {r6('o')} AS elo FROM r WHERE ro = 1 UNION ALL SELECT player_id, surface, {r6('s')} FROM r WHERE rs = 1 AND surface <> 'Sand'"""))
def rating_snapshot(spark, folder):
    e = views.pm(spark, folder).withColumns({
        "surface": F.when(F.col("surface") == "A", "Hard").when(F.col("surface") == "N", "Clay").otherwise("Sand"),
        "elo_post": 1500 + F.col("svpt"), "surface_elo_post": 1500 + F.col("stat2")})
    return reals(ratings.snapshot_from_events(e, ["match_date", "tourney_id", "match_num"]), "elo")


@query("d22_latest_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_group(spark, folder):
    return keyed.latest_per_key(views.table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("d23_combine_recommendations", twin(["scored"], EDGE_SQL + f""", t AS (SELECT *, CASE WHEN tourney_id % 2 = 0 THEN 'atp' ELSE 'wta' END AS tour, least(greatest(0.25 * greatest(0.0, CASE WHEN selected_odds > 1 THEN ((selected_odds - 1.0) * selected_prob - (1.0 - selected_prob)) / (selected_odds - 1.0) ELSE 0.0 END), 0.0), 0.5) AS sh FROM edges),
v AS (SELECT tour, match_key, row_number() OVER (PARTITION BY tour ORDER BY sh DESC, selected_edge DESC, match_key) AS pick, sh FROM t WHERE selected_edge >= 0.05),
w AS (SELECT tour, sh, sum(sh) OVER (PARTITION BY tour) AS tot FROM v WHERE pick <= 3),
x AS (SELECT tour, greatest(round_even(100.0 * CASE WHEN tot > 0.5 THEN sh * (0.5 / tot) ELSE sh END * 100.0, 0) / 100.0, 0.5) AS st FROM w WHERE sh > 0)
SELECT CAST((SELECT count(*) FROM edges) AS BIGINT) AS analysed, count(*) AS bets, {r6('sum(st)')} AS total_stake FROM x"""))
def combine_recommendations(spark, folder):
    from boutwise.plans.recommend import combined_summary

    rows = edges(spark, folder).withColumn("tour", F.when(F.col("tourney_id") % 2 == 0, "atp").otherwise("wta"))
    picks = marketplace.recommend(rows, ["tour"], ["match_key"], 100.0)
    return reals(combined_summary(rows, picks), "total_stake")


@query("d24_snapshot_age", twin(["odds"], f"SELECT max(captured_at) AS latest, count(*) AS row_count, {r6('''(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(captured_at))) / 3.6e9''')} AS age_hours FROM odds"))
def snapshot_age(spark, folder):
    return reals(evaluation.snapshot_age(views.odds(spark, folder), "captured_at", F.lit("2024-02-01 00:00:00")), "age_hours")


@query("d25_rows_added", f"""WITH o AS ({OLD}), n AS (SELECT o_orderkey, o_orderpriority FROM o UNION SELECT o_orderkey, o_orderpriority FROM ({NEW}))
SELECT o_orderpriority, count(o.o_orderkey) AS rows_before, count(*) AS rows_after, greatest(count(*) - count(o.o_orderkey), 0) AS rows_added
FROM n LEFT JOIN (SELECT o_orderkey FROM o) o ON o.o_orderkey = n.o_orderkey GROUP BY 1""")
def rows_added(spark, folder):
    old, new = versions(spark, folder)
    return merge.rows_added(old, merge.upsert(old, new, ["o_orderkey"]), "o_orderpriority")


@query("d27_status_counts", """SELECT o_orderpriority AS tour, count(*) AS row_count, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS open_rows FROM orders GROUP BY 1""")
def status_counts(spark, folder):
    o = views.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("tour"), F.col("o_orderstatus").alias("status"))
    return o.groupBy("tour").agg(F.count("*").alias("row_count"), F.count_if(F.col("status") == "O").alias("open_rows"))


INVENTORY = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "event_id", "customer": None, "equity": "day"}


@query("d27_table_inventory", """SELECT 'orders' AS artifact, true AS present, count(*) AS row_count, CAST(max(o_orderdate) AS VARCHAR) AS latest, true AS sized FROM orders
UNION ALL SELECT 'lineitem', true, count(*), CAST(max(l_shipdate) AS VARCHAR), true FROM lineitem UNION ALL SELECT 'events', true, count(*), CAST(max(event_id) AS VARCHAR), true FROM events
UNION ALL SELECT 'customer', true, count(*), NULL, true FROM customer UNION ALL SELECT 'equity', false, NULL, NULL, false""")
def table_inventory(spark, folder):
    """The tables a run should have left, one of them missing."""
    found = tables.table_inventory(spark, {name: (f"{folder}/{name}.parquet", day) for name, day in INVENTORY.items()})
    sized = F.coalesce((F.col("files") > 0) & (F.col("bytes") > 0) & F.col("last_modified").isNotNull(), F.lit(False))
    return found.select("artifact", "present", "row_count", "latest", sized.alias("sized"))


@query("d18_strategy_summary", twin(["scored"], FLAT_SQL + f""", pk AS (SELECT strategy, equity, greatest(max(equity) OVER (PARTITION BY strategy ORDER BY match_date), 500.0) AS peak FROM flat),
dd AS (SELECT strategy, max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0.0 END) AS dd FROM pk GROUP BY 1),
g AS (SELECT flat.strategy, CAST(sum(bets) AS BIGINT) AS bets, sum(wins) / sum(bets) AS wr, CAST(sum(bets) AS DOUBLE) AS staked, arg_max(equity, match_date) AS ec FROM flat GROUP BY 1)
SELECT g.strategy, bets, {r6('wr')} AS win_rate, {r6('staked')} AS staked, {r6('ec')} AS end_capital, {r6('ec - 500.0')} AS profit, {r6('(ec - 500.0) / staked')} AS roi_on_staked,
 {r6('(ec - 500.0) / 500.0')} AS roi_on_capital, {r6('dd')} AS max_drawdown FROM g JOIN dd ON dd.strategy = g.strategy"""))
def strategy_summary(spark, folder):
    out = equity.strategy_summary(flat_curve(spark, folder), ["strategy"], "match_date", F.col("staked"), 500.0)
    return reals(out, *[c for c in out.columns if c not in ("strategy", "bets")])
