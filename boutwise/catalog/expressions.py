"""Scalar expressions, each run over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.registry import query
from boutwise.catalog.views import r6, real, twin
from boutwise.functions import contest, market, scores, text
from boutwise.operators import keyed, marketplace
from boutwise.sources import tables


def _case(c: str, labels: dict, default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {default} END"


@query("b01_require_columns", twin(["raw"], """SELECT tour, tourney_id, match_num, winner_id, loser_id, winner_name, score FROM raw
WHERE winner_id IS NOT NULL AND loser_id IS NOT NULL AND score IS NOT NULL AND winner_name IS NOT NULL AND loser_name IS NOT NULL"""))
def require_columns(spark, folder):
    return views.raw(spark, folder).dropna(subset=["winner_id", "loser_id", "score", "winner_name", "loser_name"]).select(
        "tour", "tourney_id", "match_num", "winner_id", "loser_id", "winner_name", "score")


@query("b02_parse_date8", twin(["raw"], """SELECT tourney_id, match_num,
CAST(try_strptime(tourney_date, '%Y%m%d') AS DATE) AS match_date FROM raw WHERE try_strptime(tourney_date, '%Y%m%d') IS NOT NULL"""))
def parse_date8(spark, folder):
    rows = views.raw(spark, folder).select(
        "tourney_id", "match_num", text.parse_date8(F.col("tourney_date")).alias("match_date"))
    return rows.filter(F.col("match_date").isNotNull())


@query("b03_map_code", twin(["raw"], f"""SELECT tourney_id, match_num, {_case('tourney_level', contest.MASTER_LEVELS, "'other'")} AS level,
{_case('tourney_level', contest.FEATURE_LEVELS, "surface")} AS feature_level FROM raw"""))
def map_code(spark, folder):
    level = F.col("tourney_level")
    return views.raw(spark, folder).select(
        "tourney_id", "match_num", text.map_code(level, contest.MASTER_LEVELS, F.lit("other")).alias("level"),
        contest.feature_level(level, F.col("surface")).alias("feature_level"))


@query("b04_parse_score", twin(["master"], """SELECT surface, CAST(year AS INT) AS year, count(*) AS n, CAST(sum(CAST(is_retirement AS INT)) AS BIGINT) AS retirements,
CAST(sum(winner_sets_won) AS BIGINT) AS sets_won, CAST(sum(loser_sets_won) AS BIGINT) AS sets_lost,
CAST(sum(total_games) AS BIGINT) AS games, count(total_games) AS with_games FROM master_all GROUP BY surface, year"""))
def parse_score(spark, folder):
    """Parsed match table, summed up per surface and year."""
    from boutwise.plans.master import derive_columns

    return derive_columns(views.raw(spark, folder)).groupBy("surface", "year").agg(
        F.count("*").alias("n"), F.count_if("is_retirement").alias("retirements"),
        F.sum("winner_sets_won").alias("sets_won"), F.sum("loser_sets_won").alias("sets_lost"),
        F.sum("total_games").alias("games"), F.count("total_games").alias("with_games"))


@query("b05_match_key", twin(["raw"], """SELECT tour, match_num, CAST(tourney_id AS VARCHAR) || '|' || tourney_date || '|' || CAST(winner_id AS VARCHAR)
 || '|' || CAST(loser_id AS VARCHAR) || '|' || coalesce(score, 'NA') AS match_key FROM raw"""))
def match_key(spark, folder):
    parts = [F.col(c) for c in ("tourney_id", "tourney_date", "winner_id", "loser_id", "score")]
    return views.raw(spark, folder).select("tour", "match_num", text.joined_key(*parts).alias("match_key"))


@query("b06_eligibility", twin(["raw"], """, f AS (SELECT tour, tourney_id, match_num, score,
 coalesce(regexp_matches(lower(score), 'ret|w/o|def|abn|unfinished|walkover'), false) AS is_retirement,
 coalesce(contains(lower(score), 'w/o'), false) AS is_walkover FROM raw)
SELECT *, NOT (is_retirement OR is_walkover) AS is_eligible FROM f
WHERE NOT (is_retirement OR is_walkover) OR NOT (SELECT bool_or(NOT (is_retirement OR is_walkover)) FROM f)"""))
def eligibility(spark, folder):
    score = F.col("score")
    rows = views.raw(spark, folder).select(
        "tour", "tourney_id", "match_num", "score", scores.parse_score(score)["is_retirement"].alias("is_retirement"),
        scores.is_walkover(score).alias("is_walkover"))
    rows = rows.withColumn("is_eligible", contest.eligible(F.col("is_retirement"), F.col("is_walkover")))
    return keyed.eligible_or_all(rows, "is_eligible")


@query("b07_date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year,
CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days_since_epoch FROM orders""")
def date_parts(spark, folder):
    return views.table(spark, folder, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.unix_date(F.col("o_orderdate").cast("date")).alias("days_since_epoch"))


# Ids as people type them: decimals, blanks, "nan", letters.
MESSY_ID = ("CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR(20)) || '.0' WHEN 1 THEN ' nan ' WHEN 2 THEN '' "
            "WHEN 3 THEN 'AB' || CAST(c_custkey AS VARCHAR(20)) WHEN 4 THEN ' ' || CAST(c_custkey AS VARCHAR(20)) ELSE NULL END")


@query("b08_canonical_id", f"""WITH m AS (SELECT c_custkey, trim({MESSY_ID}) AS t FROM customer)
SELECT c_custkey, CASE WHEN t IS NULL OR t = '' OR lower(t) = 'nan' THEN NULL
 ELSE coalesce(CAST(try_cast(try_cast(t AS DOUBLE) AS BIGINT) AS VARCHAR), t) END AS id FROM m""")
def canonical_id(spark, folder):
    return views.table(spark, folder, "customer").withColumn("t", F.expr(MESSY_ID)).select(
        "c_custkey", text.canonical_id(F.col("t")).alias("id"))


MESSY_NAME = "' ' || replace(p_name, ' ', '.-') || '  O''' || upper(p_brand) || '_x/Y '"


@query("b09_normalize_name", f"""WITH m AS (SELECT p_partkey, lower({MESSY_NAME}) AS t FROM part)
SELECT p_partkey, trim(regexp_replace(translate(t, '.-', '  '), '\\s+', ' ', 'g')) AS name_1,
 trim(regexp_replace(translate(t, '.-_/''', '     '), '\\s+', ' ', 'g')) AS name_2 FROM m""")
def normalize_name(spark, folder):
    name = F.expr(MESSY_NAME)
    return views.table(spark, folder, "part").select(
        "p_partkey", text.normalize_name(name).alias("name_1"),
        text.normalize_name(name, text.WIDE_PUNCTUATION).alias("name_2"))


@query("b10_canonical_name", """WITH a AS (SELECT lower(p_name) AS alias, max(lower(p_type)) AS canonical FROM part WHERE p_size > 25 GROUP BY 1)
SELECT p_partkey, coalesce(a.canonical, lower(p_name)) AS canonical FROM part LEFT JOIN a ON lower(p_name) = a.alias""")
def canonical_name(spark, folder):
    part = views.table(spark, folder, "part")
    aliases = part.filter("p_size > 25").select(F.upper("p_name").alias("alias"), F.col("p_type").alias("canonical"))
    return keyed.canonical_name(part, "p_name", aliases, "canonical").select("p_partkey", "canonical")


@query("b11_order_pair", twin(["bouts"], """SELECT match_key, least(winner_id, loser_id) AS p1_id, greatest(winner_id, loser_id) AS p2_id,
CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END AS p1_wins FROM bouts"""))
def order_pair(spark, folder):
    w, l = F.col("winner_id"), F.col("loser_id")
    first = contest.order_pair(w, w.cast("string"), l, l.cast("string"))
    return views.bouts(spark, folder).select(
        "match_key", F.when(first, w).otherwise(l).alias("p1_id"), F.when(first, l).otherwise(w).alias("p2_id"),
        first.cast("int").alias("p1_wins"))


@query("b12_serve_ratios", twin(["raw"], f"""SELECT tourney_id, match_num, {r6("CASE WHEN w_svpt > 0 THEN w_ace / w_svpt END")} AS ace_pct,
 {r6("CASE WHEN w_svpt > 0 THEN w_1stIn / w_svpt END")} AS first_serve_pct,
 {r6("CASE WHEN w_svpt > 0 AND w_1stIn > 0 THEN w_1stWon / w_1stIn END")} AS first_serve_win_pct,
 {r6("CASE WHEN w_svpt > 0 AND w_svpt - w_1stIn > 0 THEN w_2ndWon / (w_svpt - w_1stIn) END")} AS second_serve_win_pct,
 {r6("CASE WHEN w_svpt > 0 THEN (w_1stWon + w_2ndWon) / w_svpt END")} AS service_points_won_pct,
 {r6("CASE WHEN l_svpt > 0 THEN 1.0 - (l_1stWon + l_2ndWon) / l_svpt END")} AS return_points_won_pct,
 {r6("CASE WHEN w_bpFaced > 0 THEN w_bpSaved / w_bpFaced END")} AS bp_save_pct FROM raw"""))
def serve_ratios(spark, folder):
    c = [F.col(f"w_{s}") for s in ("ace", "svpt", "1stIn", "1stWon", "2ndWon", "bpSaved", "bpFaced")]
    o = [F.col(f"l_{s}") for s in ("svpt", "1stWon", "2ndWon")]
    return views.raw(spark, folder).select(
        "tourney_id", "match_num", *[real(v).alias(k) for k, v in contest.serve_ratios(*c, *o).items()])


@query("b13_home_flags", twin(["raw"], """SELECT tourney_id, match_num, CAST(coalesce(winner_ioc = 'n05', false) AS INT) AS p1_is_home,
 CAST(coalesce(loser_ioc = 'n05', false) AS INT) AS p2_is_home,
 CAST(coalesce(winner_ioc = 'n05', false) AS INT) - CAST(coalesce(loser_ioc = 'n05', false) AS INT) AS home_advantage_flag FROM raw"""))
def home_flags(spark, folder):
    flags = contest.home_flags(F.col("winner_ioc"), F.col("loser_ioc"), F.lit("n05"))
    return views.raw(spark, folder).select("tourney_id", "match_num", *[v.alias(k) for k, v in flags.items()])


def _weights(c, table):
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END"


K_SQL = (f"(32.0 * CAST({_weights('tourney_level', contest.LEVEL_WEIGHTS)} AS DOUBLE) "
         f"* CAST({_weights('round', contest.ROUND_WEIGHTS)} AS DOUBLE) * CASE WHEN best_of >= 5 THEN 1.05 ELSE 1.0 END)")


@query("b14_k_factor", twin(["raw"], f"SELECT tourney_id, match_num, {r6(f'CAST({K_SQL} AS DOUBLE)')} AS k_factor FROM raw"))
def k_factor(spark, folder):
    return views.raw(spark, folder).select(
        "tourney_id", "match_num", real(contest.k_factor(F.col("tourney_level"), F.col("round"), F.col("best_of"))).alias("k_factor"))


@query("b15_expected_score", twin(["bouts"], f"""SELECT match_key, {r6('''1.0 / (1.0 + pow(10.0, ((0.7 * (1500 + b.s_acctbal / 50) + 0.3 * (1400 + b.s_acctbal / 20))
 - (0.7 * (1500 + a.s_acctbal / 50) + 0.3 * (1400 + a.s_acctbal / 20))) / 400.0))''')} AS expected
FROM bouts JOIN supplier a ON a.s_suppkey = winner_id JOIN supplier b ON b.s_suppkey = loser_id"""))
def expected_score(spark, folder):
    s = views.table(spark, folder, "supplier")
    rows = keyed.enrich_sides(views.bouts(spark, folder), s, "s_suppkey", ["s_acctbal"], {"w": "winner_id", "l": "loser_id"})
    own, other = F.col("w_s_acctbal"), F.col("l_s_acctbal")
    return rows.select("match_key", real(contest.expected_score(
        1500 + own / 50, 1400 + own / 20, 1500 + other / 50, 1400 + other / 20)).alias("expected"))


# Prices from long odds on to no margin at all, out of the snapshot table.
PRICES = """, px AS (SELECT snapshot_id, bookmaker, match_date, odds_p1, CASE WHEN snapshot_id % 7 = 0 THEN odds_p1 ELSE odds_p2 END AS odds_p2 FROM odds),
q AS (SELECT *, 1.0 / odds_p1 AS q1, 1.0 / odds_p2 AS q2, odds_p1 > 1 AND odds_p2 > 1 AND 1.0 / odds_p1 + 1.0 / odds_p2 > 1.0 AS valid FROM px),
up(snapshot_id, q1, q2, hi, i) AS (SELECT snapshot_id, q1, q2, CAST(2.0 AS DOUBLE), 0 FROM q UNION ALL
  SELECT snapshot_id, q1, q2, CASE WHEN pow(q1, hi) + pow(q2, hi) > 1.0 THEN hi * 2 ELSE hi END, i + 1 FROM up WHERE i < 8),
bi(snapshot_id, q1, q2, lo, hi, i) AS (SELECT snapshot_id, q1, q2, CAST(1.0 AS DOUBLE), hi, 0 FROM up WHERE i = 8 UNION ALL
  SELECT snapshot_id, q1, q2, CASE WHEN pow(q1, (lo + hi) / 2) + pow(q2, (lo + hi) / 2) > 1.0 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(q1, (lo + hi) / 2) + pow(q2, (lo + hi) / 2) > 1.0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM bi WHERE i < 32),
fair AS (SELECT q.*, q.q1 + q.q2 AS overround, bi.hi AS k,
   CASE WHEN valid THEN pow(q.q1, bi.hi) / (pow(q.q1, bi.hi) + pow(q.q2, bi.hi)) ELSE q.q1 / (q.q1 + q.q2) END AS fair_p1
 FROM q JOIN bi ON bi.snapshot_id = q.snapshot_id AND bi.i = 32)"""


def _prices(spark, folder):
    px = views.odds(spark, folder).withColumn(
        "odds_p2", F.when(F.col("snapshot_id") % 7 == 0, F.col("odds_p1")).otherwise(F.col("odds_p2")))
    return marketplace.with_fair_prices(px)


@query("b16_remove_overround", twin(["odds"], PRICES + f"""
SELECT bookmaker, match_date, count(*) AS n, {r6('avg(overround - 1)')} AS mean_margin, {r6('avg(fair_p1)')} AS mean_fair_p1,
 {r6('min(fair_p1)')} AS min_fair_p1, {r6('max(CASE WHEN valid THEN k END)')} AS max_exponent
FROM fair GROUP BY bookmaker, match_date""", recursive=True))
def remove_overround(spark, folder):
    """Fair prices of all snapshots, summed up per bookmaker and day."""
    return _prices(spark, folder).groupBy("bookmaker", "match_date").agg(
        F.count("*").alias("n"), real(F.avg(F.col("overround") - 1)).alias("mean_margin"),
        real(F.avg("fair_p1")).alias("mean_fair_p1"), real(F.min("fair_p1")).alias("min_fair_p1"),
        real(F.max("exponent")).alias("max_exponent"))


# Edges of the scored matches against margin-free prices by plain scaling.
EDGE_SQL = """, f0 AS (SELECT *, (1.0 / odds_p1) / (1.0 / odds_p1 + 1.0 / odds_p2) AS fp1, (1.0 / odds_p2) / (1.0 / odds_p1 + 1.0 / odds_p2) AS fp2 FROM scored),
f1 AS (SELECT *, prob - fp1 AS edge_p1, (1.0 - prob) - fp2 AS edge_p2 FROM f0),
f2 AS (SELECT *, CASE WHEN edge_p1 >= edge_p2 THEN 'P1' ELSE 'P2' END AS bet_side,
  CASE WHEN edge_p1 >= edge_p2 THEN edge_p1 ELSE edge_p2 END AS selected_edge,
  CASE WHEN edge_p1 >= edge_p2 THEN odds_p1 ELSE odds_p2 END AS selected_odds,
  CASE WHEN edge_p1 >= edge_p2 THEN prob ELSE 1.0 - prob END AS selected_prob FROM f1),
edges AS (SELECT *, selected_prob * selected_odds - 1.0 AS expected_value FROM f2)"""


def edges(spark, folder):
    """The scored matches with edges over proportionally scaled prices."""
    q1, q2 = 1.0 / F.col("odds_p1"), 1.0 / F.col("odds_p2")
    rows = views.scored(spark, folder).withColumns({"fp1": q1 / (q1 + q2), "fp2": q2 / (q1 + q2)})
    return rows.withColumns(market.score_edges(
        F.col("prob"), F.col("fp1"), F.col("fp2"), F.col("odds_p1"), F.col("odds_p2")))


@query("b17_score_edges", twin(["scored"], EDGE_SQL + f""" SELECT match_key, bet_side, {r6('1.0 / fp1')} AS fair_odds_p1, {r6('1.0 / fp2')} AS fair_odds_p2,
 {", ".join(f"{r6(c)} AS {c}" for c in ("edge_p1", "edge_p2", "selected_edge", "selected_odds", "selected_prob", "expected_value"))} FROM edges"""))
def score_edges(spark, folder):
    names = ["fair_odds_p1", "fair_odds_p2", "edge_p1", "edge_p2", "selected_edge", "selected_odds", "selected_prob", "expected_value"]
    return edges(spark, folder).select("match_key", "bet_side", *[real(c).alias(c) for c in names])


KELLY_SQL = """greatest(0.0, CASE WHEN selected_odds - 1.0 > 0 THEN ((selected_odds - 1.0) * selected_prob - (1.0 - selected_prob)) / (selected_odds - 1.0) ELSE 0.0 END)"""


@query("b18_kelly", twin(["scored"], EDGE_SQL + f" SELECT match_key, {r6(KELLY_SQL)} AS kelly_full, {r6(f'0.25 * {KELLY_SQL}')} AS kelly_share FROM edges"))
def kelly(spark, folder):
    k = market.kelly(F.col("selected_prob"), F.col("selected_odds"))
    return edges(spark, folder).select("match_key", *[real(v).alias(n) for n, v in k.items()])


TIER_SQL = "CASE WHEN abs(prob_a - prob_b) < 0.05 THEN 'HIGH' WHEN abs(prob_a - prob_b) < 0.12 THEN 'MEDIUM' ELSE 'LOW' END"


@query("b19_bands", twin(["scored"], EDGE_SQL + f""", t AS (SELECT *, {TIER_SQL} AS confidence_tier FROM edges)
SELECT match_key, confidence_tier, CASE WHEN selected_edge >= 0.08 THEN 'strong' WHEN selected_edge >= 0.05 THEN 'playable' ELSE 'below-threshold' END AS edge_band,
 CASE WHEN selected_edge >= 0.05 AND confidence_tier = 'HIGH' THEN 'HIGH' WHEN selected_edge >= 0.05 THEN 'MEDIUM' WHEN selected_edge >= 0.025 THEN 'LOW' ELSE 'SKIP' END AS suggestion,
 date_diff('hour', CAST(match_date AS TIMESTAMP), TIMESTAMP '1998-01-01 06:00:00') > 4 AS is_old FROM t"""))
def bands(spark, folder):
    rows = edges(spark, folder).withColumn("confidence_tier", market.confidence_tier(F.abs(F.col("prob_a") - F.col("prob_b"))))
    edge = F.col("selected_edge")
    return rows.select(
        "match_key", "confidence_tier", market.edge_band(edge).alias("edge_band"),
        market.suggestion(edge, F.col("confidence_tier")).alias("suggestion"),
        market.odds_too_old(F.col("match_date"), F.lit("1998-01-01 06:00:00")).alias("is_old"))


MESSY_TYPE = ("CASE o_orderkey % 7 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN 'Yes' WHEN 2 THEN '1' WHEN 3 THEN 'TRUE ' WHEN 4 THEN '' "
              "WHEN 5 THEN 'x' || CAST(o_orderkey AS VARCHAR(20)) ELSE CAST(o_orderkey AS VARCHAR(20)) END")


@query("b20_coerce_types", f"""WITH m AS (SELECT o_orderkey, trim({MESSY_TYPE}) AS t FROM orders)
SELECT o_orderkey, nullif(t, '') AS as_text, try_cast(t AS DOUBLE) AS as_real, CAST(trunc(try_cast(t AS DOUBLE)) AS BIGINT) AS as_whole,
 CASE WHEN lower(t) IN ('1', 'true', 'yes', 'y') THEN 1 ELSE 0 END AS as_flag FROM m""")
def coerce_types(spark, folder):
    c = F.expr(MESSY_TYPE)
    return views.table(spark, folder, "orders").select(
        "o_orderkey", text.blank_to_null(c).alias("as_text"), text.as_double(c).alias("as_real"),
        text.as_long(c).alias("as_whole"), text.as_flag(c).alias("as_flag"))


ROUND_TEXT = ("CASE o_orderkey % 11 WHEN 0 THEN ' Final' WHEN 1 THEN 'semi-finals' WHEN 2 THEN '1R' WHEN 3 THEN '2R' WHEN 4 THEN '3rd round' "
              "WHEN 5 THEN 'Round of 16' WHEN 6 THEN 'group' WHEN 7 THEN 'qf' WHEN 8 THEN 'who knows' WHEN 9 THEN NULL ELSE '1. round' END")
DRAW = "CAST(8 + o_custkey % 120 AS INT)"


@query("b21_normalize_round", f"""WITH m AS (SELECT o_orderkey, lower(trim({ROUND_TEXT})) AS t, {DRAW} AS d FROM orders),
n AS (SELECT *, CASE WHEN t IN ('1r', '1. round') THEN 1 WHEN t = '2r' THEN 2 WHEN t = '3rd round' THEN 3 WHEN t = 'round of 16' THEN 4 END AS num,
 CASE WHEN d > 64 THEN 128 WHEN d > 32 THEN 64 WHEN d > 16 THEN 32 WHEN d > 8 THEN 16 ELSE 8 END AS full_draw FROM m),
o AS (SELECT *, full_draw / pow(2, num - 1) AS lft FROM n)
SELECT o_orderkey, CASE WHEN num IS NOT NULL THEN CASE WHEN lft >= 128 THEN 'R128' WHEN lft >= 64 THEN 'R64' WHEN lft >= 32 THEN 'R32'
  WHEN lft >= 16 THEN 'R16' WHEN lft >= 8 THEN 'QF' WHEN lft >= 4 THEN 'SF' ELSE 'F' END
 ELSE CASE t WHEN 'final' THEN 'F' WHEN 'semi-finals' THEN 'SF' WHEN 'group' THEN 'RR' WHEN 'qf' THEN 'QF' ELSE 'R32' END END AS round FROM o""")
def normalize_round(spark, folder):
    return views.table(spark, folder, "orders").select(
        "o_orderkey", scores.normalize_round(F.expr(ROUND_TEXT), F.expr(DRAW)).alias("round"))


@query("b22_round_order", twin(["raw"], """, p AS (SELECT *, CASE round WHEN 'F' THEN 300 WHEN 'SF' THEN 200 WHEN 'QF' THEN 150 ELSE 100 END AS pos FROM raw)
SELECT tour, tourney_id, match_num, CAST(pos + row_number() OVER (PARTITION BY tour, tourney_id ORDER BY match_num) AS INT) AS new_num FROM p"""))
def round_order(spark, folder):
    rows = tables.number_rows(views.raw(spark, folder), ["tour", "tourney_id"], ["match_num"], "n")
    return rows.select("tour", "tourney_id", "match_num", (scores.round_position(F.col("round")) + F.col("n")).alias("new_num"))


BORN = "CAST('19' || lpad(CAST(50 + c_custkey % 49 AS VARCHAR(2)), 2, '0') || '-03-15' AS DATE)"


@query("b23_age_at", f"""WITH m AS (SELECT o_orderkey, date_diff('day', {BORN}, CAST(o_orderdate AS DATE)) AS d FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, CASE WHEN round(d / 365.25, 1) > 10 THEN round(d / 365.25, 1) END AS age FROM m""")
def age_at(spark, folder):
    c = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr(BORN).alias("born"))
    return views.table(spark, folder, "orders").join(c, "o_custkey").select(
        "o_orderkey", contest.age_at(F.col("o_orderdate").cast("date"), F.col("born")).alias("age"))


@query("b24_first_present", "SELECT o_orderkey, o_totalprice AS stake, CAST(NULL AS DOUBLE) AS odds, o_orderstatus AS status FROM orders")
def first_present(spark, folder):
    o = views.table(spark, folder, "orders")
    return o.select(
        "o_orderkey", text.first_present(o, ["recommended_stake", "o_totalprice"], "double").alias("stake"),
        text.first_present(o, ["selected_odds", "odds"], "double").alias("odds"),
        text.first_present(o, ["o_orderstatus", "status"], "string").alias("status"))


@query("b25_staleness", """WITH m AS (SELECT c_custkey, max(CAST(o_orderdate AS DATE)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
d AS (SELECT c_custkey, CAST(date_diff('day', latest, DATE '2001-12-31') AS INT) AS days_behind FROM m)
SELECT *, CASE WHEN days_behind IS NULL THEN 'unknown' WHEN days_behind <= 3 THEN 'fresh' WHEN days_behind <= 7 THEN 'warning' WHEN days_behind <= 14 THEN 'stale' ELSE 'critical' END AS status,
 CASE WHEN days_behind IS NULL THEN 'No data found yet.' WHEN days_behind <= 3 THEN 'Data is fresh.' WHEN days_behind <= 7 THEN 'Data is ' || days_behind || ' days behind; still usable.'
  WHEN days_behind <= 14 THEN 'Data is ' || days_behind || ' days stale; add recent results.' ELSE 'Data is critically stale (' || days_behind || ' days).' END AS message FROM d""")
def staleness(spark, folder):
    latest = views.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("latest"))
    rows = views.table(spark, folder, "customer").select("c_custkey").join(latest, "c_custkey", "left")
    return rows.select("c_custkey", *[v.alias(k) for k, v in contest.staleness(F.col("latest"), F.lit("2001-12-31").cast("date")).items()])


@query("b26_interval", twin(["scored"], f"""SELECT match_key, {r6('greatest(prob - 0.3, 0.0)')} AS lower, {r6('least(prob + 0.3, 1.0)')} AS upper,
 {r6('least(prob + 0.3, 1.0) - greatest(prob - 0.3, 0.0)')} AS width FROM scored"""))
def interval(spark, folder):
    return views.scored(spark, folder).select("match_key", *[real(v).alias(k) for k, v in market.interval(F.col("prob"), 0.3).items()])


@query("b27_blend", twin(["scored"], f""", m AS (SELECT match_key, prob_a, CASE WHEN tourney_id % 4 = 0 THEN NULL ELSE prob_b END AS prob_b, prob AS prob_c FROM scored),
b AS (SELECT *, (0.5 * prob_a + coalesce(0.3 * prob_b, 0) + 0.2 * prob_c) / (0.7 + CASE WHEN prob_b IS NULL THEN 0 ELSE 0.3 END) AS p,
 greatest(prob_a, prob_b, prob_c) - least(prob_a, prob_b, prob_c) AS gap FROM m)
SELECT match_key, {r6('p')} AS ensemble_prob, {r6('1 - gap')} AS model_agreement,
 CASE WHEN gap < 0.05 THEN 'HIGH' WHEN gap < 0.12 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier FROM b"""))
def blend(spark, folder):
    models = {"a": F.col("prob_a"), "b": F.when(F.col("tourney_id") % 4 != 0, F.col("prob_b")), "c": F.col("prob")}
    out = market.blend(models, {"a": 0.5, "b": 0.3, "c": 0.2})
    return views.scored(spark, folder).select(
        "match_key", real(out["ensemble_prob"]).alias("ensemble_prob"), real(out["model_agreement"]).alias("model_agreement"),
        out["confidence_tier"].alias("confidence_tier"))


@query("b28_validate_odds", twin(["odds"], f""", m AS (SELECT snapshot_id, match_id, CASE WHEN snapshot_id % 9 = 0 THEN ' ATP ' WHEN snapshot_id % 9 = 1 THEN 'itf' WHEN snapshot_id % 9 <> 2 THEN 'wta' END AS tour,
  CASE WHEN snapshot_id % 13 <> 5 THEN 'n' || match_id END AS name_1, CASE WHEN snapshot_id % 17 = 3 THEN ' ' ELSE 'm' || snapshot_id END AS name_2,
  CASE WHEN snapshot_id % 10 = 3 THEN 'n/a' WHEN snapshot_id % 10 = 4 THEN '0.9' ELSE CAST(floor(odds_p1 * 100) / 100 AS VARCHAR) END AS odds_1,
  CASE WHEN snapshot_id % 11 = 2 THEN 'soon' ELSE CAST(match_date AS VARCHAR) END AS day FROM odds)
SELECT snapshot_id, coalesce(lower(trim(tour)), 'wta') AS tour, {r6('try_cast(odds_1 AS DOUBLE)')} AS odds_p1, try_cast(day AS DATE) AS match_date,
 CASE WHEN lower(trim(tour)) NOT IN ('atp', 'wta') THEN 'tour' WHEN try_cast(odds_1 AS DOUBLE) IS NULL OR try_cast(odds_1 AS DOUBLE) <= 1 THEN 'odds'
  WHEN try_cast(day AS DATE) IS NULL THEN 'match_date' WHEN name_1 IS NULL OR trim(name_2) = '' THEN 'players' END AS reject_reason, 'manual-20240101-' || snapshot_id AS match_id,
 CASE WHEN snapshot_id % 2 = 0 THEN 'Cup' ELSE 'Manual upload' END AS tournament, 'Unknown' AS surface, name_1 AS player_1_resolved FROM m"""))
def validate_odds(spark, folder):
    i = F.col("snapshot_id")
    rows = views.odds(spark, folder).select(
        "snapshot_id", F.when(i % 9 == 0, " ATP ").when(i % 9 == 1, "itf").when(i % 9 != 2, "wta").alias("tour"),
        F.when(i % 10 == 3, "n/a").when(i % 10 == 4, "0.9").otherwise((F.floor(F.col("odds_p1") * 100) / 100).cast("string")).alias("odds_p1"),
        F.when(i % 11 == 2, "soon").otherwise(F.col("match_date").cast("string")).alias("match_date"),
        F.when(i % 2 == 0, "Cup").alias("tournament"), F.when(i % 13 != 5, F.concat(F.lit("n"), "match_id")).alias("player_1"),
        F.when(i % 17 == 3, " ").otherwise(F.concat(F.lit("m"), "snapshot_id")).alias("player_2"))
    checked = marketplace.validate_odds(rows, ["odds_p1"], "manual-20240101", "snapshot_id", "2024-01-01T00:00:00Z", default_tour="wta")
    return checked.select("snapshot_id", "tour", real("odds_p1").alias("odds_p1"), "match_date", "reject_reason", "match_id",
                          "tournament", "surface", "player_1_resolved")


SETTLE_SQL = """, s AS (SELECT match_key, CASE WHEN tourney_id % 10 = 0 THEN 'void' WHEN p1_wins = 1 THEN 'win' ELSE 'loss' END AS result,
  CAST(dq AS DOUBLE) + 50.5 AS stake, odds_p1 FROM scored)"""


@query("b29_settle", twin(["scored"], SETTLE_SQL + """ SELECT match_key, result, CASE result WHEN 'win' THEN round_even(stake * (odds_p1 - 1.0) * 100.0, 0) / 100.0
 WHEN 'void' THEN 0.0 ELSE round_even(-stake * 100.0, 0) / 100.0 END AS pnl, 'closed' AS status, '2024-01-01T00:00:00Z' AS resolved_at FROM s"""))
def settle(spark, folder):
    outcome = F.when(F.col("tourney_id") % 10 == 0, "void").when(F.col("p1_wins") == 1, "win").otherwise("loss")
    done = market.settle(outcome, F.col("dq") + 50.5, F.col("odds_p1"), F.lit("2024-01-01T00:00:00Z"))
    return views.scored(spark, folder).select("match_key", *[v.alias(k) for k, v in done.items()])


# A log in which each way to tell a win turns up.
LOG_SQL = """, lg AS (SELECT match_key, CASE tourney_id % 3 WHEN 0 THEN CASE WHEN p1_wins = 1 THEN ' Home' ELSE 'away ' END
   WHEN 1 THEN CASE WHEN p1_wins = 1 THEN 'n' || p1_id ELSE 'n' || p2_id END ELSE '' END AS actual_winner,
  CASE WHEN match_num % 2 = 1 THEN 'P1' ELSE '2' END AS bet_side, 'N' || p1_id AS p1_name, 'N' || p2_id AS p2_name,
  CASE WHEN tourney_id % 3 = 2 AND tourney_id % 2 = 0 THEN CASE WHEN p1_wins = 1 THEN 'Won' ELSE 'lost' END END AS result,
  CASE WHEN tourney_id % 4 <> 1 THEN CAST(dq AS DOUBLE) END AS pnl, 10.0 + match_num AS stake,
  CASE WHEN tourney_id % 5 <> 0 THEN odds_p1 END AS odds FROM scored),
wn AS (SELECT *, CASE WHEN trim(actual_winner) <> '' THEN CASE WHEN bet_side = 'P1' THEN lower(trim(actual_winner)) IN ('p1', '1', 'home', lower(p1_name))
   ELSE lower(trim(actual_winner)) IN ('p2', '2', 'away', lower(p2_name)) END
  WHEN coalesce(result, '') <> '' THEN lower(result) IN ('w', 'win', 'won', 'true', '1') ELSE coalesce(pnl > 0, false) END AS won FROM lg)"""


def bet_log(spark, folder):
    t, p1, n = F.col("tourney_id"), F.col("p1_wins") == 1, F.lit("n")
    winner = (
        F.when(t % 3 == 0, F.when(p1, " Home").otherwise("away "))
        .when(t % 3 == 1, F.concat(n, F.when(p1, F.col("p1_id")).otherwise(F.col("p2_id")))).otherwise("")
    )
    return views.scored(spark, folder).select(
        "match_key", winner.alias("actual_winner"), F.when(F.col("match_num") % 2 == 1, "P1").otherwise("2").alias("bet_side"),
        F.concat(F.lit("N"), "p1_id").alias("p1_name"), F.concat(F.lit("N"), "p2_id").alias("p2_name"),
        F.when((t % 3 == 2) & (t % 2 == 0), F.when(p1, "Won").otherwise("lost")).alias("result"),
        F.when(t % 4 != 1, F.col("dq")).alias("pnl"), (10.0 + F.col("match_num")).alias("stake"),
        F.when(t % 5 != 0, F.col("odds_p1")).alias("odds"))


WON = ("actual_winner", "bet_side", "p1_name", "p2_name", "result", "pnl")


@query("b30_bet_won", twin(["scored"], LOG_SQL + " SELECT match_key, won FROM wn"))
def bet_won(spark, folder):
    return bet_log(spark, folder).select("match_key", market.bet_won(*[F.col(c) for c in WON]).alias("won"))


@query("b31_bet_returns", twin(["scored"], LOG_SQL + f""", rt AS (SELECT *, coalesce(CASE WHEN pnl IS NOT NULL THEN stake + pnl WHEN won THEN stake * coalesce(odds, 0.0) ELSE stake END, 0.0) AS total FROM wn)
SELECT match_key, {r6('total')} AS total_return, {r6('total - stake')} AS bet_pnl FROM rt"""))
def bet_returns(spark, folder):
    rows = bet_log(spark, folder).withColumn("won", market.bet_won(*[F.col(c) for c in WON]))
    out = market.bet_returns(F.col("won"), F.col("stake"), F.col("odds"), F.col("pnl"))
    return rows.select("match_key", *[real(v).alias(k) for k, v in out.items()])


@query("b32_date_window", twin(["scored"], f"""SELECT match_key, match_date, {r6('prob')} AS prob FROM scored
WHERE match_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' ORDER BY match_date, match_key"""))
def date_window(spark, folder):
    rows = keyed.date_window(views.scored(spark, folder), "match_date", "1996-01-01", "1998-06-30")
    keyed.refuse_in_sample(rows, "match_date", "1996-01-01")
    return rows.select("match_key", "match_date", real("prob").alias("prob")).orderBy("match_date", "match_key")


HEADER = ("c_name || ' (N' || c_nationkey || '), ' || CASE c_custkey % 4 WHEN 0 THEN 'hard' WHEN 1 THEN 'red clay' WHEN 2 THEN 'grass' ELSE 'sand' END "
          "|| CASE c_custkey % 3 WHEN 0 THEN chr(10) ELSE ' | ' END || CASE c_custkey % 5 WHEN 0 THEN 'ATP - singles: ' WHEN 1 THEN 'wta - SINGLES' "
          "WHEN 2 THEN 'Challenger Men - Singles' WHEN 3 THEN 'ITF Women - singles' ELSE 'Doubles' END")


@query("b33_parse_header", f"""WITH m AS (SELECT c_custkey, {HEADER} AS t FROM customer),
p AS (SELECT c_custkey, list_filter(list_transform(string_split_regex(t, '[|\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM m),
q AS (SELECT c_custkey, parts[1] AS lft, upper(parts[2]) AS cat FROM p),
r AS (SELECT *, CASE WHEN contains(cat, 'ATP - SINGLES') THEN 'atp' WHEN contains(cat, 'WTA - SINGLES') THEN 'wta' WHEN contains(cat, 'CHALLENGER MEN - SINGLES') THEN 'atp'
  WHEN contains(cat, 'ITF WOMEN - SINGLES') THEN 'wta' END AS tour, trim(string_split(lft, ',')[2]) AS tail FROM q)
SELECT c_custkey, tour, CASE WHEN tour IS NOT NULL THEN lft END AS tournament,
 CASE WHEN tour IS NOT NULL THEN CASE WHEN contains(tail, 'hard') THEN 'Hard' WHEN contains(tail, 'clay') THEN 'Clay' WHEN contains(tail, 'grass') THEN 'Grass' ELSE 'Sand' END END AS surface,
 CASE WHEN tour IS NOT NULL THEN CASE WHEN contains(cat, 'CHALLENGER') OR contains(cat, 'ITF') THEN 'C' ELSE 'A' END END AS level FROM r""")
def parse_header(spark, folder):
    return views.table(spark, folder, "customer").select(
        "c_custkey", *[v.alias(k) for k, v in text.parse_header(F.expr(HEADER)).items()])


@query("b34_drop_invalid_pairs", """WITH m AS (SELECT l_orderkey, l_linenumber, nullif(l_suppkey % 8, 0) AS a_id, nullif(l_partkey % 8, 0) AS b_id,
 CASE WHEN l_quantity = 7 THEN l_returnflag || '/' || l_linestatus ELSE l_returnflag END AS a_name FROM lineitem)
SELECT * FROM m WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND a_id <> b_id AND a_name NOT LIKE '%/%'""")
def drop_invalid_pairs(spark, folder):
    rows = views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_suppkey") % 8, F.lit(0)).alias("a_id"),
        F.nullif(F.col("l_partkey") % 8, F.lit(0)).alias("b_id"),
        F.when(F.col("l_quantity") == 7, F.concat_ws("/", "l_returnflag", "l_linestatus")).otherwise(F.col("l_returnflag")).alias("a_name"))
    return keyed.drop_invalid_pairs(rows, "a_id", "b_id", ["a_name"])


PAGE_URL = "CASE WHEN page_id % 3 = 0 THEN url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'mid=m' || CAST(page_id AS VARCHAR(20)) || '&x=1' ELSE url END"
WHEN = "CASE WHEN page_id % 7 = 0 THEN 'today' ELSE CAST(1 + page_id % 30 AS VARCHAR(9)) || '.' || CAST(1 + page_id % 12 AS VARCHAR(9)) || '. 1' || CAST(page_id % 10 AS VARCHAR(9)) || ':30' END"


@query("b35_event_id_from_url", f"""WITH m AS (SELECT page_id, {PAGE_URL} AS u, 'g_2_r' || page_id AS row_id, {WHEN} AS t FROM pages)
SELECT page_id, coalesce(nullif(trim(regexp_extract(u, '[?&]mid=([^&#]*)', 1)), ''), string_split(row_id, '_')[3]) AS match_id,
 CAST(try_strptime(string_split(t, ' ')[1] || '2023', '%d.%m.%Y') AS DATE) AS match_date,
 CASE WHEN contains(string_split(t, ' ')[2], ':') THEN string_split(t, ' ')[2] END AS match_time FROM m""")
def event_id_from_url(spark, folder):
    rows = views.table(spark, folder, "pages").select(
        "page_id", F.expr(PAGE_URL).alias("u"), F.concat(F.lit("g_2_r"), "page_id").alias("r"), F.expr(WHEN).alias("t"))
    return rows.select(
        "page_id", text.event_id(F.col("u"), F.col("r")).alias("match_id"),
        *[v.alias(k) for k, v in text.event_time(F.col("t"), F.lit(2023)).items()])


@query("b36_infer_winner", twin(["master"], """SELECT tour, match_key, coalesce(winner_sets_won, 0) > coalesce(loser_sets_won, 0) AS first_won,
 CASE WHEN len(list_filter(string_split_regex(trim(score), '\\s+'), lambda t: regexp_full_match(string_split(t, '(')[1], '\\d+-\\d+'))) >= 4 THEN 5 ELSE 3 END AS best_of_sets FROM master"""))
def infer_winner(spark, folder):
    from boutwise.plans.master import build_master

    out = scores.infer_winner(F.col("score"))
    return build_master(views.raw(spark, folder)).select(
        "tour", "match_key", out["first_won"].alias("first_won"), out["best_of"].alias("best_of_sets"))
