"""Ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.expressions import EDGE_SQL, K_SQL, edges
from boutwise.catalog.registry import query
from boutwise.catalog.sorting import ALLOCATE_SQL
from boutwise.catalog.views import r6, real, twin
from boutwise.functions import contest
from boutwise.operators import equity, features, keyed, marketplace, ratings, splits
from boutwise.session import materialize
from boutwise.operators.history import History, PrefixLast, PrefixMax, PrefixSum, Rolling, SinceDays

KEY = ["match_key", "player_id"]
DAY, ORDER = "match_date", ["tourney_id", "match_num"]
PLAYER = "PARTITION BY player_id ORDER BY match_date, tourney_id, match_num"
HALF = 0.5


def player_bouts(spark, folder):
    return History(views.pm(spark, folder), ["player_id"], DAY, ORDER)


def surface_bouts(spark, folder):
    return History(views.pm(spark, folder), ["player_id", "surface"], DAY, ORDER)


def rounded(df, *names):
    return df.withColumns({n: views.real(n) for n in names})


@query("e01_rolling_win_rate", twin(["pm"], f"""
SELECT match_key, player_id, {", ".join(
    f"round(coalesce(avg(result) OVER ({PLAYER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0.5) + 1e-9, 6) AS win_pct_{n}"
    for n in (5, 10, 20))} FROM pm"""))
def rolling_win_rate(spark, folder):
    h = player_bouts(spark, folder).add(*[Rolling(f"win_pct_{n}", F.col("result"), n, HALF) for n in (5, 10, 20)])
    return rounded(h.result(), "win_pct_5", "win_pct_10", "win_pct_20").select(*KEY, "win_pct_5", "win_pct_10", "win_pct_20")


@query("e02_rolling_win_rate_surface", twin(["pm"], """
SELECT match_key, player_id, round(coalesce(avg(result) OVER (PARTITION BY player_id, surface
  ORDER BY match_date, tourney_id, match_num ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.5) + 1e-9, 6) AS win_pct_surface_10
FROM pm"""))
def rolling_win_rate_surface(spark, folder):
    h = surface_bouts(spark, folder).add(Rolling("win_pct_surface_10", F.col("result"), 10, HALF))
    return rounded(h.result(), "win_pct_surface_10").select(*KEY, "win_pct_surface_10")


@query("e03_signed_streak5", twin(["pm"], f"""
SELECT match_key, player_id, CAST(coalesce(sum(CASE WHEN result = 1 THEN 1 ELSE -1 END)
  OVER ({PLAYER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS INT) AS streak_5 FROM pm"""))
def signed_streak5(spark, folder):
    h = player_bouts(spark, folder).add(Rolling("streak_5", F.col("result") * 2 - 1, 5, F.lit(0), kind="sum"))
    return h.result().select(*KEY, F.col("streak_5").cast("int").alias("streak_5"))


@query("e04_streaks", twin(["pm"], f"""
, g AS (SELECT *, sum(1 - result) OVER ({PLAYER} ROWS UNBOUNDED PRECEDING) AS lg,
                  sum(result) OVER ({PLAYER} ROWS UNBOUNDED PRECEDING) AS wg FROM pm),
r AS (SELECT *, sum(result) OVER (PARTITION BY player_id, lg ORDER BY match_date, tourney_id, match_num
                                  ROWS UNBOUNDED PRECEDING) AS win_run,
                sum(1 - result) OVER (PARTITION BY player_id, wg ORDER BY match_date, tourney_id, match_num
                                      ROWS UNBOUNDED PRECEDING) AS lose_run FROM g)
SELECT match_key, player_id, CAST(coalesce(lag(win_run) OVER ({PLAYER}), 0) AS BIGINT) AS current_win_streak,
       CAST(coalesce(lag(lose_run) OVER ({PLAYER}), 0) AS BIGINT) AS current_lose_streak FROM r"""))
def streaks(spark, folder):
    h = player_bouts(spark, folder).add(PrefixSum("n", F.lit(1)))
    place = F.col("n") + 1
    h.add(PrefixMax("loss_at", F.when(F.col("result") == 0, place), F.lit(0)),
          PrefixMax("win_at", F.when(F.col("result") == 1, place), F.lit(0)))
    return h.result().select(
        *KEY, (F.col("n") - F.col("loss_at")).alias("current_win_streak"),
        (F.col("n") - F.col("win_at")).alias("current_lose_streak"))


@query("e05_days_since_last", twin(["pm"], f"""
SELECT match_key, player_id, CAST(coalesce(date_diff('day', lag(match_date) OVER ({PLAYER}), match_date), 14) AS INT)
  AS days_since_last FROM pm"""))
def days_since_last(spark, folder):
    h = player_bouts(spark, folder).add(PrefixLast("last_day", F.col(DAY)))
    return h.result().select(*KEY, F.coalesce(F.datediff(DAY, "last_day"), F.lit(14)).alias("days_since_last"))


def _since_sql(value: str, days: int, name: str) -> str:
    """Earlier rows minus those too old; same-day rows that come first in order count."""
    return f"""CAST(coalesce(sum({value}) OVER ({PLAYER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      - coalesce(sum({value}) OVER (PARTITION BY player_id ORDER BY match_date
          RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days + 1} DAYS PRECEDING), 0) AS BIGINT) AS {name}"""


@query("e06_matches_last_14d", twin(["pm"], f"SELECT match_key, player_id, {_since_sql('1', 14, 'matches_last_14d')} FROM pm"))
def matches_last_14d(spark, folder):
    return player_bouts(spark, folder).add(SinceDays("matches_last_14d", F.lit(1), 14)).result().select(*KEY, "matches_last_14d")


SETS = "(2 + tourney_id % 2)"


@query("e07_sets_last_7d", twin(["pm"], f"SELECT match_key, player_id, {_since_sql(SETS, 7, 'sets_last_7d')} FROM pm"))
def sets_last_7d(spark, folder):
    sets = 2 + F.col("tourney_id") % 2
    return player_bouts(spark, folder).add(SinceDays("sets_last_7d", sets, 7)).result().select(*KEY, "sets_last_7d")


@query("e08_titles_12m", twin(["pm"], f"""SELECT match_key, player_id, {_since_sql(
    'CASE WHEN match_num = 1 AND result = 1 THEN 1 ELSE 0 END', 365, 'titles_12m')} FROM pm"""))
def titles_12m(spark, folder):
    title = ((F.col("match_num") == 1) & (F.col("result") == 1)).cast("int")
    return player_bouts(spark, folder).add(SinceDays("titles_12m", title, 365)).result().select(*KEY, "titles_12m")


# Seven ratios of a player row. Two are NULL now and then, so gaps are exercised.
RATIOS = {
    "ace_pct": "stat", "first_serve_pct": "stat2", "bp_save_pct": "stat + stat2", "first_serve_win_pct": "stat * 2",
    "second_serve_win_pct": "stat2 * 3", "service_points_won_pct": "svpt / 50.0", "return_points_won_pct": "1 - stat",
}


def _metric_sql(by: str, suffix: str) -> str:
    defaults = contest.RATIO_DEFAULTS
    values = ", ".join(f"{sql} AS {m}" for m, sql in RATIOS.items())
    steps = ", ".join(
        f"CASE WHEN {m} IS NOT NULL THEN avg({m}) OVER (PARTITION BY {by}, ({m} IS NULL) "
        f"ORDER BY match_date, tourney_id, match_num ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS a_{m}" for m in RATIOS)
    outs = ", ".join(
        f"round(coalesce(last_value(a_{m} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY match_date, tourney_id, match_num "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {defaults[m]}) + 1e-9, 6) AS {m}{suffix}" for m in RATIOS)
    return twin(["pm"], f""", v AS (SELECT match_key, player_id, surface, match_date, tourney_id, match_num, {values} FROM pm),
s AS (SELECT *, {steps} FROM v) SELECT match_key, player_id, {outs} FROM s""")


def _metrics(h, suffix):
    names = [f"{m}{suffix}" for m in RATIOS]
    h.add(*[Rolling(f"{m}{suffix}", F.expr(sql), 20, F.lit(contest.RATIO_DEFAULTS[m]), nullable=True)
            for m, sql in RATIOS.items()])
    return rounded(h.result(), *names).select(*KEY, *names)


@query("e09_rolling_metric20", _metric_sql("player_id", ""))
def rolling_metric20(spark, folder):
    return _metrics(player_bouts(spark, folder), "")


@query("e10_rolling_metric20_surface", _metric_sql("player_id, surface", "_surface"))
def rolling_metric20_surface(spark, folder):
    return _metrics(surface_bouts(spark, folder), "_surface")


PAIRS = """, w AS (SELECT match_key, match_date, tourney_id, match_num, surface, least(winner_id, loser_id) AS p1_id,
  greatest(winner_id, loser_id) AS p2_id, CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END AS p1_wins FROM bouts)"""


def _pairs(spark, folder):
    return views.bouts(spark, folder).select(
        "match_key", DAY, *ORDER, "surface", F.lit("all").alias("tour"),
        F.least("winner_id", "loser_id").alias("p1_id"), F.greatest("winner_id", "loser_id").alias("p2_id"),
        (F.col("winner_id") < F.col("loser_id")).cast("int").alias("p1_wins"))


def _before(value, by):
    return (f"CAST(coalesce(sum({value}) OVER (PARTITION BY {by} ORDER BY match_date, tourney_id, match_num "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)")


@query("e11_h2h", twin(["bouts"], PAIRS + f""", h AS (SELECT match_key,
  {_before('p1_wins', 'p1_id, p2_id')} AS h2h_p1_wins, {_before('1 - p1_wins', 'p1_id, p2_id')} AS h2h_p2_wins,
  {_before('1', 'p1_id, p2_id')} AS h2h_total FROM w)
SELECT *, round(CASE WHEN h2h_total > 0 THEN h2h_p1_wins / h2h_total ELSE 0.5 END + 1e-9, 6) AS h2h_p1_win_pct FROM h"""))
def h2h(spark, folder):
    wide = features.head_to_head(_pairs(spark, folder), surface=False)
    return rounded(wide, "h2h_p1_win_pct").select("match_key", "h2h_p1_wins", "h2h_p2_wins", "h2h_total", "h2h_p1_win_pct")


@query("e12_h2h_surface", twin(["bouts"], PAIRS + f""" SELECT match_key,
  {_before('p1_wins', 'p1_id, p2_id, surface')} AS h2h_surface_p1_wins,
  {_before('1 - p1_wins', 'p1_id, p2_id, surface')} AS h2h_surface_p2_wins FROM w"""))
def h2h_surface(spark, folder):
    p1 = F.col("p1_wins")
    return History(_pairs(spark, folder), ["p1_id", "p2_id", "surface"], DAY, ORDER).add(
        PrefixSum("h2h_surface_p1_wins", p1), PrefixSum("h2h_surface_p2_wins", 1 - p1),
    ).result().select("match_key", "h2h_surface_p1_wins", "h2h_surface_p2_wins")


@query("e13_tournament_wins", twin(["pm"], """SELECT match_key, player_id, CAST(coalesce(sum(result) OVER (
  PARTITION BY tourney_id, player_id ORDER BY match_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS tournament_wins FROM pm"""))
def tournament_wins(spark, folder):
    return History(views.pm(spark, folder), ["tourney_id", "player_id"], DAY, ["match_num"]).add(
        PrefixSum("tournament_wins", F.col("result"))).result().select(*KEY, "tournament_wins")


@query("e14_home_win_rate", twin(["pm"], f""", p AS (SELECT pm.*, CASE WHEN s.s_nationkey = c.c_nationkey THEN 1 ELSE 0 END AS home
  FROM pm JOIN supplier s ON s.s_suppkey = player_id JOIN customer c ON c.c_custkey = host_key),
n AS (SELECT match_key, player_id, {_before('home', 'player_id')} AS hm, {_before('home * result', 'player_id')} AS hw FROM p)
SELECT match_key, player_id, round(CASE WHEN hm >= 5 THEN hw / hm ELSE 0.5 END + 1e-9, 6) AS home_win_pct FROM n"""))
def home_win_rate(spark, folder):
    s = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("player_id"), "s_nationkey")
    c = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("host_key"), "c_nationkey")
    rows = views.pm(spark, folder).join(s, "player_id").join(c, "host_key").withColumn(
        "home", (F.col("s_nationkey") == F.col("c_nationkey")).cast("int"))
    rows = History(rows, ["player_id"], DAY, ORDER).add(
        PrefixSum("hm", F.col("home")), PrefixSum("hw", F.col("home") * F.col("result"))).result()
    return rows.select(*KEY, views.real(F.when(F.col("hm") >= 5, F.col("hw") / F.col("hm")).otherwise(0.5)).alias("home_win_pct"))


@query("e15_matches_before", twin(["pm"], f"""SELECT match_key, player_id, row_number() OVER ({PLAYER}) - 1 AS matches_before FROM pm"""))
def matches_before(spark, folder):
    return player_bouts(spark, folder).add(PrefixSum("matches_before", F.lit(1))).result().select(*KEY, "matches_before")


@query("e16_last_known", twin(["pm"], f"""SELECT match_key, player_id, coalesce(last_value(CASE WHEN tourney_id % 3 = 0
  THEN level_code END IGNORE NULLS) OVER ({PLAYER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), s_name) AS last_level
  FROM pm JOIN supplier ON s_suppkey = player_id"""))
def last_known(spark, folder):
    known = F.when(F.col("tourney_id") % 3 == 0, F.col("level_code"))
    rows = player_bouts(spark, folder).add(PrefixLast("last_level", known, with_current=True)).result()
    dim = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("player_id"), "s_name")
    return rows.join(dim, "player_id").select(*KEY, F.coalesce("last_level", "s_name").alias("last_level"))


# -- the composite feature table ----------------------------------------------------------------


def rated_master(spark, folder):
    """Eligible master rows with the host country, a player dimension and known ratings."""
    from boutwise.plans.master import build_master

    s = views.table(spark, folder, "supplier")
    code = F.concat(F.lit("N"), F.lpad(F.col("nation").cast("string"), 2, "0"))
    hosts = views.table(spark, folder, "customer").withColumn("nation", F.col("c_nationkey")).select(
        F.col("c_name").alias("key"), code.alias("value"))
    # The master table is a stored stage: eligibility, ratings and features all read it.
    master = keyed.eligible_or_all(materialize(build_master(views.raw(spark, folder))), "is_training_eligible")
    master = keyed.lookup_two_level(master, "tourney_name", hosts, "host_country")
    players = s.withColumn("nation", F.col("s_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("player_id"), F.when(F.col("s_suppkey") % 2 == 0, code).alias("ioc"))
    base = master.select("tour", "match_key", "tourney_id", F.explode(F.array("winner_id", "loser_id")).alias("s_suppkey"))
    rated = base.filter(F.col("tourney_id") % 4 != 0).join(s, "s_suppkey").select(
        "tour", "match_key", F.col("s_suppkey").cast("string").alias("player_id"),
        (1500 + F.col("s_acctbal") / 100).alias("elo_pre"), (1500 + F.col("s_acctbal") / 200).alias("surface_elo_pre"))
    return master, players, rated


FEATURE_REALS = [
    "elo_overall", "elo_surface", "win_pct_5", "win_pct_10", "win_pct_20", "win_pct_surface_10", "home_win_pct",
    *features.RATIO_NAMES.values(), *[f"{n}_surface" for n in features.RATIO_NAMES.values()],
]
FEATURE_COUNTS = [c for c in features.SIDE_FEATURES if c not in FEATURE_REALS and c != "rank"]
FEATURE_KEYS = ["tour", "match_key", "match_date", "surface", "tournament_level", "round", "best_of"]
H2H_COUNTS = ["h2h_p1_wins", "h2h_p2_wins", "h2h_total", "h2h_surface_p1_wins", "h2h_surface_p2_wins"]


def feature_output(wide):
    """Fixed column order and types, reals at six decimals."""
    reals = [f"p{i}_{c}" for i in (1, 2) for c in FEATURE_REALS]
    counts = [f"p{i}_{c}" for i in (1, 2) for c in FEATURE_COUNTS]
    return wide.select(
        *FEATURE_KEYS, "p1_id", "p2_id", "p1_name", "p2_name", "p1_ioc", "p2_ioc", "p1_rank", "p2_rank", "p1_wins",
        "home_advantage_flag", *[views.real(c).alias(c) for c in (*reals, "elo_diff_overall", "elo_diff_surface", "h2h_p1_win_pct")],
        *[F.col(c).cast("bigint").alias(c) for c in (*counts, *H2H_COUNTS)])


def _feature_sql() -> str:
    ratio = {
        "ace_pct": "{m}_ace / {m}_svpt", "first_serve_pct": "{m}_1stIn / {m}_svpt",
        "first_serve_win_pct": "CASE WHEN {m}_1stIn > 0 THEN {m}_1stWon / {m}_1stIn END",
        "second_serve_win_pct": "CASE WHEN {m}_svpt - {m}_1stIn > 0 THEN {m}_2ndWon / ({m}_svpt - {m}_1stIn) END",
        "service_points_won_pct": "({m}_1stWon + {m}_2ndWon) / {m}_svpt",
        "return_points_won_pct": "1.0 - (({o}_1stWon + {o}_2ndWon) / {o}_svpt)",
        "bp_save_pct": "CASE WHEN {m}_bpFaced > 0 THEN {m}_bpSaved / {m}_bpFaced END",
    }

    def side(me, other, result):
        m, o = me[0], other[0]
        return f"""SELECT tour, match_key, match_date, tourney_id, match_num, surface, round, best_of, tourney_level,
          tournament_level, host_country, CAST({me}_id AS VARCHAR) AS player_id, {me}_name AS player_name, {me}_id AS nid,
          upper({me}_ioc) AS row_ioc, CAST({me}_rank AS DOUBLE) AS rank, {result} AS result,
          CASE WHEN {me}_id < {other}_id THEN 1 ELSE 2 END AS side,
          CASE WHEN winner_sets_won + loser_sets_won > 0 THEN winner_sets_won + loser_sets_won
               WHEN best_of = 3 THEN 2 ELSE 3 END AS sets,
          {", ".join(f"{sql.format(m=m, o=o)} AS n_{k}" for k, sql in ratio.items())} FROM mm"""

    player = "PARTITION BY tour, player_id ORDER BY match_date, tourney_id, match_num"
    surf = "PARTITION BY tour, player_id, surface ORDER BY match_date, tourney_id, match_num"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def last(n, w, value):
        return f"avg({value}) OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    def since(value, days):
        return (f"coalesce(sum({value}) OVER ({player} {before}), 0) - coalesce(sum({value}) OVER (PARTITION BY tour, "
                f"player_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days + 1} DAYS PRECEDING), 0)")

    means = ", ".join(
        f"CASE WHEN n_{k} IS NOT NULL THEN avg(n_{k}) OVER (PARTITION BY {by}, (n_{k} IS NULL) ORDER BY match_date, "
        f"tourney_id, match_num ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS {pre}_{k}"
        for k in ratio for by, pre in (("tour, player_id", "a"), ("tour, player_id, surface", "s")))
    asof = ", ".join(
        f"coalesce(last_value({pre}_{k} IGNORE NULLS) OVER ({w} {before}), {contest.RATIO_DEFAULTS[k]}) AS \"{features.RATIO_NAMES[k]}{suffix}\""
        for k in ratio for w, pre, suffix in ((player, "a", ""), (surf, "s", "_surface")))
    reals = ", ".join(f'round(x{i}."{c}" + 1e-9, 6) AS "p{i}_{c}"' for i in (1, 2) for c in FEATURE_REALS)
    counts = ", ".join(f'CAST(x{i}."{c}" AS BIGINT) AS "p{i}_{c}"' for i in (1, 2) for c in FEATURE_COUNTS)
    pair = "PARTITION BY tour, p1_id, p2_id"
    levels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in contest.FEATURE_LEVELS.items())
    return twin(["master"], f""", mm AS (SELECT m.*, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS host_country
  FROM master m LEFT JOIN customer ON c_name = tourney_name WHERE is_training_eligible AND winner_id <> loser_id),
x0 AS ({side('winner', 'loser', 1)} UNION ALL {side('loser', 'winner', 0)}),
x1 AS (SELECT x0.*, coalesce(last_value(row_ioc IGNORE NULLS) OVER ({player} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         CASE WHEN nid % 2 = 0 THEN 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END) AS ioc, s_acctbal
       FROM x0 JOIN supplier ON s_suppkey = nid),
x2 AS (SELECT *, coalesce(CAST(ioc = host_country AS INT), 0) AS is_home, {means} FROM x1),
x3 AS (SELECT *, row_number() OVER ({player}) - 1 AS matches_played_before,
  coalesce(sum(is_home) OVER ({player} {before}), 0) AS hm, coalesce(sum(is_home * result) OVER ({player} {before}), 0) AS hw,
  coalesce({last(5, player, 'result')}, 0.5) AS win_pct_5, coalesce({last(10, player, 'result')}, 0.5) AS win_pct_10,
  coalesce({last(20, player, 'result')}, 0.5) AS win_pct_20, coalesce({last(10, surf, 'result')}, 0.5) AS win_pct_surface_10,
  coalesce(sum(2 * result - 1) OVER ({player} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS streak_5,
  coalesce(date_diff('day', lag(match_date) OVER ({player}), match_date), 14) AS days_since_last_match,
  {since('1', 14)} AS matches_last_14d, {since('sets', 7)} AS sets_played_last_7d,
  {since("CASE WHEN round = 'F' AND result = 1 THEN 1 ELSE 0 END", 365)} AS title_count_12m,
  coalesce(sum(result) OVER (PARTITION BY tour, tourney_id, player_id ORDER BY match_num {before}), 0) AS tournament_wins_current,
  CASE WHEN tourney_id % 4 <> 0 THEN 1500 + s_acctbal / 100 ELSE 1500.0 END AS elo_overall,
  CASE WHEN tourney_id % 4 <> 0 THEN 1500 + s_acctbal / 200 ELSE 1500.0 END AS elo_surface, {asof} FROM x2),
x4 AS (SELECT *, CASE WHEN hm >= 5 THEN hw / hm ELSE 0.5 END AS home_win_pct,
  matches_played_before - coalesce(max(CASE WHEN result = 0 THEN matches_played_before + 1 END) OVER ({player} {before}), 0) AS current_win_streak,
  matches_played_before - coalesce(max(CASE WHEN result = 1 THEN matches_played_before + 1 END) OVER ({player} {before}), 0) AS current_lose_streak
  FROM x3),
x5 AS (SELECT match_key, tour, match_date, surface, tourney_id, match_num, CASE WHEN winner_id < loser_id THEN winner_id ELSE loser_id END AS p1_id,
  CASE WHEN winner_id < loser_id THEN loser_id ELSE winner_id END AS p2_id, CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END AS w1 FROM mm),
h AS (SELECT match_key, tour, sum(w1) OVER ({pair} ORDER BY match_date, tourney_id, match_num {before}) AS h1,
  sum(1 - w1) OVER ({pair} ORDER BY match_date, tourney_id, match_num {before}) AS h2,
  row_number() OVER ({pair} ORDER BY match_date, tourney_id, match_num) - 1 AS h2h_total,
  sum(w1) OVER ({pair}, surface ORDER BY match_date, tourney_id, match_num {before}) AS s1,
  sum(1 - w1) OVER ({pair}, surface ORDER BY match_date, tourney_id, match_num {before}) AS s2 FROM x5)
SELECT x1.tour, x1.match_key, x1.match_date, x1.surface, CASE x1.tourney_level {levels} ELSE x1.tournament_level END AS tournament_level,
  x1.round, CAST(x1.best_of AS VARCHAR) AS best_of, x1.player_id AS p1_id, x2.player_id AS p2_id, x1.player_name AS p1_name,
  x2.player_name AS p2_name, x1.ioc AS p1_ioc, x2.ioc AS p2_ioc, x1.rank AS p1_rank, x2.rank AS p2_rank, x1.result AS p1_wins,
  x1.is_home - x2.is_home AS home_advantage_flag, {reals}, round(x1.elo_overall - x2.elo_overall + 1e-9, 6) AS elo_diff_overall,
  round(x1.elo_surface - x2.elo_surface + 1e-9, 6) AS elo_diff_surface,
  round(CASE WHEN h2h_total > 0 THEN coalesce(h1, 0) / h2h_total ELSE 0.5 END + 1e-9, 6) AS h2h_p1_win_pct, {counts},
  CAST(coalesce(h1, 0) AS BIGINT) AS h2h_p1_wins, CAST(coalesce(h2, 0) AS BIGINT) AS h2h_p2_wins,
  CAST(h2h_total AS BIGINT) AS h2h_total, CAST(coalesce(s1, 0) AS BIGINT) AS h2h_surface_p1_wins,
  CAST(coalesce(s2, 0) AS BIGINT) AS h2h_surface_p2_wins
FROM x4 x1 JOIN x4 x2 ON x1.tour = x2.tour AND x1.match_key = x2.match_key AND x1.side = 1 AND x2.side = 2
  JOIN h ON h.tour = x1.tour AND h.match_key = x1.match_key""")


@query("e17_feature_table", _feature_sql())
def feature_table(spark, folder):
    master, players, rated = rated_master(spark, folder)
    return feature_output(features.feature_table(master, players, rated))


# -- equity, splits, ratings --------------------------------------------------------------------

# The pseudo-random side comes from the key, so that every run and both engines agree.
FLAT_SQL = """, fb AS (SELECT match_key, match_date, 'flat_favorite' AS strategy, CASE WHEN odds_p1 <= odds_p2 THEN 'P1' ELSE 'P2' END AS side, p1_wins, odds_p1, odds_p2 FROM scored
  UNION ALL SELECT match_key, match_date, 'flat_random', CASE WHEN (tourney_id * 7 + match_num * 3) % 2 = 0 THEN 'P1' ELSE 'P2' END, p1_wins, odds_p1, odds_p2 FROM scored),
fw AS (SELECT *, (side = 'P1') = (p1_wins = 1) AS won, CASE WHEN side = 'P1' THEN odds_p1 ELSE odds_p2 END AS o FROM fb),
fd AS (SELECT strategy, match_date, count(*) AS bets, count_if(won) AS wins, sum(CASE WHEN won THEN o - 1.0 ELSE -1.0 END) AS pnl FROM fw GROUP BY 1, 2),
fe AS (SELECT *, 500.0 + sum(pnl) OVER (PARTITION BY strategy ORDER BY match_date) AS raw_equity FROM fd),
flat AS (SELECT *, CASE WHEN min(raw_equity) OVER (PARTITION BY strategy ORDER BY match_date) <= 0 THEN 0.0 ELSE raw_equity END AS equity FROM fe)"""


def coin():
    return (F.col("tourney_id") * 7 + F.col("match_num") * 3) % 2 == 0


def flat_curve(spark, folder):
    bets = equity.flat_bets(views.scored(spark, folder), "p1_wins", coin())
    return equity.equity_flat(bets, ["strategy"], "match_date", 500.0)


@query("e18_max_drawdown", twin(["scored"], FLAT_SQL + f""", pk AS (SELECT strategy, equity, greatest(max(equity) OVER (PARTITION BY strategy ORDER BY match_date), 500.0) AS peak FROM flat)
SELECT strategy, {r6('max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0.0 END)')} AS max_drawdown FROM pk GROUP BY 1"""))
def max_drawdown(spark, folder):
    return rounded(equity.max_drawdown(flat_curve(spark, folder), ["strategy"], "match_date", "equity", 500.0), "max_drawdown")


@query("e19a_equity_flat", twin(["scored"], FLAT_SQL + f""" SELECT strategy, match_date, bets, CAST(wins AS BIGINT) AS wins, {r6('pnl')} AS pnl, {r6('equity')} AS equity FROM flat"""))
def equity_flat(spark, folder):
    return rounded(flat_curve(spark, folder), "pnl", "equity").select("strategy", "match_date", "bets", "wins", "pnl", "equity")


COMPOUND_SQL = ALLOCATE_SQL + """
, cd AS (SELECT match_date, count(*) AS bets, count_if((bet_side = 'P1') = (p1_wins = 1)) AS wins, sum(share) AS share,
  sum(share * CASE WHEN (bet_side = 'P1') = (p1_wins = 1) THEN selected_odds - 1.0 ELSE -1.0 END) AS day_return FROM k3 GROUP BY 1),
comp AS (SELECT *, ln(100.0) + sum(ln(1 + day_return)) OVER (ORDER BY match_date) AS log_equity FROM cd)"""


@query("e19b_equity_compound", twin(["scored"], COMPOUND_SQL + f""" SELECT match_date, bets, CAST(wins AS BIGINT) AS wins, {r6('share')} AS share, {r6('day_return')} AS day_return, {r6('log_equity')} AS log_equity FROM comp"""))
def equity_compound(spark, folder):
    curve = equity.equity_compound(edges(spark, folder), [], "match_date", "p1_wins", ["match_key"], 100.0)
    return curve.select("match_date", "bets", "wins", real("share").alias("share"), real("day_return").alias("day_return"),
                        real("log_equity").alias("log_equity"))


@query("e20_allocate_daily", twin(["scored"], ALLOCATE_SQL + f" SELECT match_date, match_key, pick, {r6('kelly_share')} AS kelly_share, {r6('share')} AS share, {r6('stake')} AS stake FROM alloc"))
def allocate_daily(spark, folder):
    picks = marketplace.recommend(edges(spark, folder), ["match_date"], ["match_key"], 100.0)
    return rounded(picks, "kelly_share", "share", "stake").select(
        "match_date", "match_key", F.col("pick").cast("bigint").alias("pick"), "kelly_share", "share", "stake")


@query("e21_odds_movement", twin(["odds"], f""", p AS (SELECT *, lag(captured_at) OVER w AS pc, lag(odds_p1) OVER w AS p1, lag(odds_p2) OVER w AS p2 FROM odds WINDOW w AS (PARTITION BY match_id ORDER BY captured_at))
SELECT snapshot_id, match_id, captured_at, pc AS prev_captured_at, {r6('(epoch_us(captured_at) - epoch_us(pc)) / 3.6e9')} AS hours_since_previous,
 {r6('odds_p1 - p1')} AS odds_p1_delta, {r6('odds_p2 - p2')} AS odds_p2_delta, {r6('(odds_p1 - p1) / p1')} AS odds_p1_pct, {r6('(odds_p2 - p2) / p2')} AS odds_p2_pct,
 CASE WHEN pc IS NULL THEN 'no_prior_snapshot' WHEN abs(odds_p1 - p1) < 1e-9 AND abs(odds_p2 - p2) < 1e-9 THEN 'flat' WHEN odds_p1 < p1 AND odds_p2 > p2 THEN 'steam_p1'
  WHEN odds_p2 < p2 AND odds_p1 > p1 THEN 'steam_p2' ELSE 'mixed' END AS market_move FROM p"""))
def odds_movement(spark, folder):
    rows = marketplace.odds_movement(views.odds(spark, folder), ["match_id"], "captured_at")
    names = ["hours_since_previous", "odds_p1_delta", "odds_p2_delta", "odds_p1_pct", "odds_p2_pct"]
    return rounded(rows, *names).select("snapshot_id", "match_id", "captured_at", "prev_captured_at", *names, "market_move")


@query("e22_split_temporal", twin(["scored"], "SELECT match_key, CASE WHEN match_date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split, 'strict_cutoff' AS split_mode FROM scored"))
def split_temporal(spark, folder):
    return splits.split_temporal(views.scored(spark, folder), ["match_date", *ORDER], "1999-01-01").select("match_key", "split", "split_mode")


@query("e22_split_by_position", twin(["scored"], """SELECT match_key, CASE WHEN row_number() OVER (ORDER BY match_date, tourney_id, match_num) - 1 <
 greatest(1, least(CAST(trunc(count(*) OVER () * 0.8) AS BIGINT), count(*) OVER () - 1)) THEN 'train' ELSE 'test' END AS split, 'fallback_80_20_temporal' AS split_mode FROM scored"""))
def split_by_position(spark, folder):
    return splits.split_temporal(views.scored(spark, folder), ["match_date", *ORDER], "2100-01-01", months=0).select("match_key", "split", "split_mode")


@query("e23_temporal_folds", twin(["scored"], """, r AS (SELECT match_date, row_number() OVER (ORDER BY match_date, tourney_id, match_num) - 1 AS i, count(*) OVER () AS n FROM scored),
p AS (SELECT *, greatest(75, n // 7) AS te FROM r), q AS (SELECT *, greatest(300, te * 4) AS tr FROM p), s AS (SELECT *, least(3, (n - tr) // te) AS k FROM q),
f AS (SELECT s.*, j, greatest(0, n - (tr + k * te)) + (j - 1) * te AS a FROM s, range(1, 4) t(j) WHERE j <= k),
g AS (SELECT match_date, j, CASE WHEN i >= a AND i < a + tr THEN 'train' WHEN i >= a + tr AND i < a + tr + te THEN 'test' END AS role FROM f)
SELECT CAST(j AS INT) AS fold, role, count(*) AS n, min(match_date) AS date_min, max(match_date) AS date_max FROM g WHERE role IS NOT NULL GROUP BY 1, 2"""))
def temporal_folds(spark, folder):
    rows = splits.temporal_folds(views.scored(spark, folder), ["match_date", *ORDER], 3, 300, 75)
    return splits.fold_summary(rows, "match_date")


@query("e24_walk_forward_folds", twin(["scored"], """, d AS (SELECT match_date, count(*) AS c FROM scored GROUP BY 1)
SELECT * FROM (SELECT match_date, c AS test_rows, CAST(sum(c) OVER w AS BIGINT) AS train_rows, min(match_date) OVER w AS train_date_min, max(match_date) OVER w AS train_date_max FROM d
 WINDOW w AS (ORDER BY match_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE train_rows > 0"""))
def walk_forward_folds(spark, folder):
    return splits.walk_forward_folds(views.scored(spark, folder), "match_date")


def _sequential_sql() -> str:
    """Match by match: a recursive step per match over two lists, the ratings of all players and of all players on all surfaces."""
    return twin(["master"], f""", em AS MATERIALIZED (SELECT tour, match_key, match_date, tourney_id, match_num, CAST(winner_id AS VARCHAR) AS w, CAST(loser_id AS VARCHAR) AS l, surface, CAST({K_SQL} AS DOUBLE) AS k
  FROM master WHERE is_training_eligible AND winner_id <> loser_id),
who AS MATERIALIZED (SELECT tour, id, row_number() OVER (ORDER BY tour, id) AS p FROM (SELECT tour, w AS id FROM em UNION SELECT tour, l FROM em)),
sf AS MATERIALIZED (SELECT surface, row_number() OVER (ORDER BY surface) AS s FROM (SELECT DISTINCT surface FROM em)),
mt AS MATERIALIZED (SELECT em.*, a.p AS wi, b.p AS li, (a.p - 1) * (SELECT count(*) FROM sf) + s AS ws, (b.p - 1) * (SELECT count(*) FROM sf) + s AS ls,
  row_number() OVER (ORDER BY match_date, tourney_id, match_num, em.tour) AS rn
  FROM em JOIN who a ON a.tour = em.tour AND a.id = w JOIN who b ON b.tour = em.tour AND b.id = l JOIN sf ON sf.surface IS NOT DISTINCT FROM em.surface),
rec(rn, wo, wx, lo, lx, ch, elo, sur) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
    [CAST(1500.0 AS DOUBLE) FOR x IN range(0, (SELECT count(*) FROM who))], [CAST(NULL AS DOUBLE) FOR x IN range(0, (SELECT count(*) FROM who) * (SELECT count(*) FROM sf))]
  UNION ALL SELECT rn, wo, wx, lo, lx, ch, e1[:li - 1] || [lo - ch] || e1[li + 1:], s1[:ls - 1] || [lx - ch] || s1[ls + 1:] FROM (
    SELECT *, elo[:wi - 1] || [wo + ch] || elo[wi + 1:] AS e1, sur[:ws - 1] || [wx + ch] || sur[ws + 1:] AS s1 FROM (
      SELECT *, k * (1.0 - 1.0 / (1.0 + pow(10.0, ((0.7 * lo + 0.3 * lx) - (0.7 * wo + 0.3 * wx)) / 400.0))) AS ch FROM (
        SELECT mt.rn, k, wi, li, ws, ls, elo, sur, elo[wi] AS wo, coalesce(sur[ws], elo[wi]) AS wx, elo[li] AS lo, coalesce(sur[ls], elo[li]) AS lx
        FROM rec JOIN mt ON mt.rn = rec.rn + 1))))
SELECT tour, match_key, w AS player_id, 1 AS result, round(wo + 1e-9, 3) AS elo_pre, round(wx + 1e-9, 3) AS surface_elo_pre, round(ch + 1e-9, 3) AS change FROM rec JOIN mt ON mt.rn = rec.rn
UNION ALL SELECT tour, match_key, l, 0, round(lo + 1e-9, 3), round(lx + 1e-9, 3), round(-ch + 1e-9, 3) FROM rec JOIN mt ON mt.rn = rec.rn""", recursive=True)


@query("e25_elo_exact", _sequential_sql())
def elo_exact(spark, folder):
    """Match-by-match ratings, solved a year at a time; ties on a day follow the match order."""
    events, _ = ratings.sequential_ratings(rating_matches(spark, folder, "match_date", *ORDER), tolerance=1e-9)
    return events.select("tour", "match_key", "player_id", "result", *[F.round(F.col(c) + 1e-9, 3).alias(c) for c in ("elo_pre", "surface_elo_pre", "change")])


def rating_matches(spark, folder, *order):
    """Eligible master matches with their K and the year as rating period."""
    from boutwise.plans.master import build_master

    master = build_master(views.raw(spark, folder)).filter("is_training_eligible AND winner_id <> loser_id")
    return master.select(
        "tour", "match_key", F.year("match_date").alias("period"), "winner_id", "loser_id", "surface",
        contest.k_factor(F.col("tourney_level"), F.col("round"), F.col("best_of")).alias("k"),
        *[F.col(c).alias(n) for c, n in zip(order, ("day", "a", "b"))])


def _period_sql(first: int, last: int) -> str:
    parts = [f""", em AS MATERIALIZED (SELECT tour, match_key, year(match_date) AS yr, CAST(winner_id AS VARCHAR) AS w, CAST(loser_id AS VARCHAR) AS l, surface, CAST({K_SQL} AS DOUBLE) AS k
  FROM master WHERE is_training_eligible AND winner_id <> loser_id),
r{first - 1} AS (SELECT '' AS tour, '' AS id, '' AS surf, CAST(0 AS DOUBLE) AS elo WHERE false)"""]
    for y in range(first, last + 1):
        parts.append(f"""m{y} AS MATERIALIZED (SELECT *, k * (1.0 - 1.0 / (1.0 + pow(10.0, ((0.7 * lp + 0.3 * ls) - (0.7 * wp + 0.3 * ws)) / 400.0))) AS ch FROM (
  SELECT em.*, coalesce(a.elo, 1500.0) AS wp, coalesce(b.elo, a.elo, 1500.0) AS ws, coalesce(c.elo, 1500.0) AS lp, coalesce(d.elo, c.elo, 1500.0) AS ls
  FROM em LEFT JOIN r{y - 1} a ON a.tour = em.tour AND a.id = w AND a.surf = 'ALL' LEFT JOIN r{y - 1} b ON b.tour = em.tour AND b.id = w AND b.surf = surface
    LEFT JOIN r{y - 1} c ON c.tour = em.tour AND c.id = l AND c.surf = 'ALL' LEFT JOIN r{y - 1} d ON d.tour = em.tour AND d.id = l AND d.surf = surface WHERE yr = {y})),
u{y} AS MATERIALIZED (SELECT tour, id, surf, max(pre) + sum(ch) AS elo FROM (SELECT tour, w AS id, 'ALL' AS surf, wp AS pre, ch FROM m{y} UNION ALL SELECT tour, w, surface, ws, ch FROM m{y}
   UNION ALL SELECT tour, l, 'ALL', lp, -ch FROM m{y} UNION ALL SELECT tour, l, surface, ls, -ch FROM m{y}) GROUP BY 1, 2, 3),
r{y} AS MATERIALIZED (SELECT * FROM u{y} UNION ALL SELECT o.* FROM r{y - 1} o LEFT JOIN u{y} u ON u.tour = o.tour AND u.id = o.id AND u.surf = o.surf WHERE u.id IS NULL)""")
    return ",\n".join(parts)


YEARS = (1993, 2003)


@query("e26_elo_period", twin(["master"], _period_sql(*YEARS) + f" SELECT tour, id AS player_id, surf AS surface, {r6('elo')} AS elo FROM r{YEARS[1]}"))
def elo_period(spark, folder):
    _, state = ratings.period_ratings(rating_matches(spark, folder))
    return rounded(ratings.rating_snapshot(state), "elo")


@query("e27_bankroll_ledger", twin(["scored"], f""", s AS (SELECT *, 40.0 + coalesce(sum(dq) OVER (PARTITION BY p1_id ORDER BY match_date, tourney_id, match_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, dq AS pnl FROM scored),
t AS (SELECT *, b + pnl AS a, min(b) OVER (PARTITION BY p1_id ORDER BY match_date, tourney_id, match_num) AS mb, min(b + pnl) OVER (PARTITION BY p1_id ORDER BY match_date, tourney_id, match_num) AS ma FROM s)
SELECT match_key, {r6('b - least(0.0, mb)')} AS capital_before, {r6('a - least(0.0, ma)')} AS capital_after FROM t"""))
def bankroll_ledger(spark, folder):
    rows = equity.bankroll_ledger(views.scored(spark, folder), ["p1_id"], "match_date", ORDER, "dq", 40.0)
    return rounded(rows, "capital_before", "capital_after").select("match_key", "capital_before", "capital_after")
