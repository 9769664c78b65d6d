"""Contest-shaped views of the given tables: DataFrames, and the same views as SQL text.

Players are suppliers, a tournament is an order, the host country is the customer's nation. The
SQL form is inlined as leading CTEs of the twins; the DataFrame form is written separately so that
the two check each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutwise.operators.keyed import dealt, small

# Line items that a task should pair at most, however many tasks that takes; orders stay whole.
LINE_ROWS = 500_000

# ---------------------------------------------------------------------------------------------
# SQL text
# ---------------------------------------------------------------------------------------------

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["bouts"] = ((), """
bouts_l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate, l_extendedprice,
             l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem),
bouts_p AS (
  SELECT a.l_orderkey AS tourney_id, CAST((a.rn + 1) / 2 AS INT) AS match_num,
         CAST(o.o_orderdate AS DATE) AS match_date, o.o_custkey AS host_key,
         a.l_returnflag AS surface, o.o_orderpriority AS level_code,
         a.l_extendedprice >= b.l_extendedprice AS a_wins,
         a.l_suppkey AS a_id, b.l_suppkey AS b_id,
         a.l_quantity AS a_qty, b.l_quantity AS b_qty,
         a.l_discount AS a_disc, b.l_discount AS b_disc, a.l_tax AS a_tax, b.l_tax AS b_tax
  FROM bouts_l a JOIN bouts_l b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1
                 JOIN orders o ON o.o_orderkey = a.l_orderkey
  WHERE a.rn % 2 = 1 AND a.l_suppkey <> b.l_suppkey),
bouts AS (
  SELECT CAST(tourney_id AS VARCHAR) || '-' || CAST(match_num AS VARCHAR) AS match_key,
         tourney_id, match_num, match_date, host_key, surface, level_code,
         CASE WHEN a_wins THEN a_id ELSE b_id END AS winner_id,
         CASE WHEN a_wins THEN b_id ELSE a_id END AS loser_id,
         CASE WHEN a_wins THEN a_qty ELSE b_qty END AS w_svpt,
         CASE WHEN a_wins THEN b_qty ELSE a_qty END AS l_svpt,
         CASE WHEN a_wins THEN nullif(a_disc, 0.0) ELSE nullif(b_disc, 0.0) END AS w_stat,
         CASE WHEN a_wins THEN nullif(b_disc, 0.0) ELSE nullif(a_disc, 0.0) END AS l_stat,
         CASE WHEN a_wins THEN a_tax ELSE b_tax END AS w_stat2,
         CASE WHEN a_wins THEN b_tax ELSE a_tax END AS l_stat2
  FROM bouts_p)""")

VIEWS["pm"] = (("bouts",), """
pm AS (
  SELECT match_key, match_date, tourney_id, match_num, surface, level_code, host_key,
         winner_id AS player_id, loser_id AS opponent_id, 1 AS result,
         w_svpt AS svpt, w_stat AS stat, w_stat2 AS stat2 FROM bouts
  UNION ALL
  SELECT match_key, match_date, tourney_id, match_num, surface, level_code, host_key,
         loser_id, winner_id, 0, l_svpt, l_stat, l_stat2 FROM bouts)""")

VIEWS["scored"] = (("bouts",), """
scored_w AS (
  SELECT match_key, match_date, tourney_id, match_num, surface,
         least(winner_id, loser_id) AS p1_id, greatest(winner_id, loser_id) AS p2_id,
         CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END AS p1_wins,
         CASE WHEN winner_id < loser_id THEN w_svpt - l_svpt ELSE l_svpt - w_svpt END AS dq
  FROM bouts),
scored_m AS (
  SELECT w.*, 1.0 / (1.0 + pow(10.0, (s2.s_acctbal - s1.s_acctbal) / 8000.0)) AS prob_a,
         1.0 / (1.0 + pow(10.0, -dq / 40.0)) AS prob_b
  FROM scored_w w JOIN supplier s1 ON s1.s_suppkey = p1_id JOIN supplier s2 ON s2.s_suppkey = p2_id),
scored AS (
  SELECT m.*, 0.6 * prob_b + 0.4 * prob_a AS prob,
         round(1.0 / (1.05 * (0.5 * prob_a + 0.25)), 3) AS odds_p1,
         round(1.0 / (1.05 * (0.75 - 0.5 * prob_a)), 3) AS odds_p2
  FROM scored_m m)""")

VIEWS["odds"] = ((), """
odds AS (
  SELECT event_id AS snapshot_id, user_id AS match_id, ts AS captured_at,
         CAST(ts AS DATE) AS match_date, event_type AS bookmaker, props,
         1.05 + value / 100.0 AS odds_p1,
         1.0 / (1.05 - 1.0 / (1.05 + value / 100.0)) AS odds_p2
  FROM events)""")

# A raw result table as an ingest would see it: one column expression per field, in SQL both
# engines read. `b` is bouts, `h` the host customer, `w` and `l` the two suppliers.
RAW_FIELDS: dict[str, str] = {
    "tour": "CASE WHEN b.tourney_id % 2 = 0 THEN 'atp' ELSE 'wta' END",
    "tourney_id": "b.tourney_id",
    "tourney_name": "h.c_name",
    "surface": "CASE b.surface WHEN 'A' THEN 'Hard' WHEN 'N' THEN 'Clay' ELSE 'Grass' END",
    "draw_size": "CAST(16 + b.tourney_id % 90 AS INT)",
    "tourney_level": "CASE substr(b.level_code, 1, 1) WHEN '1' THEN 'G' WHEN '2' THEN 'M' "
                     "WHEN '3' THEN 'A' WHEN '4' THEN 'C' ELSE 'X' END",
    "tourney_date": "CASE WHEN b.tourney_id % 50 = 7 THEN '19991399' ELSE "
                    "CAST(year(b.match_date) * 10000 + month(b.match_date) * 100 "
                    "+ day(b.match_date) AS VARCHAR(8)) END",
    "match_num": "b.match_num",
    "winner_id": "b.winner_id",
    "winner_name": "CASE WHEN b.tourney_id % 61 = 5 THEN NULL ELSE w.s_name END",
    "winner_ioc": "CASE WHEN b.tourney_id % 3 = 0 THEN 'n' || lpad(CAST(w.s_nationkey AS VARCHAR(4)), 2, '0') END",
    "winner_rank": "CASE WHEN b.tourney_id % 5 <> 0 THEN CAST(abs(floor(w.s_acctbal / 100)) AS INT) END",
    "loser_id": "b.loser_id",
    "loser_name": "l.s_name",
    "loser_ioc": "CASE WHEN b.tourney_id % 3 = 1 THEN 'n' || lpad(CAST(l.s_nationkey AS VARCHAR(4)), 2, '0') END",
    "loser_rank": "CASE WHEN b.tourney_id % 5 <> 0 THEN CAST(abs(floor(l.s_acctbal / 100)) AS INT) END",
    "score": "CASE (b.tourney_id * 3 + b.match_num) % 20 WHEN 0 THEN 'W/O' WHEN 1 THEN '6-3 ret.' "
             "WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '6-4 3-1 DEF' WHEN 5 THEN '1-6 5-7' "
             "WHEN 6 THEN '7-6(' || CAST(CAST(b.l_svpt AS INT) % 9 AS VARCHAR(4)) || ') 3-6 6-4' "
             "WHEN 7 THEN ' 6-2  x-6 6-1-1 7-5 ' "
             "ELSE '6-' || CAST(CAST(b.w_svpt AS INT) % 5 AS VARCHAR(4)) || ' 6-' || "
             "CAST(CAST(b.l_svpt AS INT) % 5 AS VARCHAR(4)) END",
    "best_of": "CASE WHEN substr(b.level_code, 1, 1) = '1' THEN 5 ELSE 3 END",
    "round": "CASE b.match_num WHEN 1 THEN 'F' WHEN 2 THEN 'SF' WHEN 3 THEN 'QF' ELSE 'R16' END",
    "w_ace": "CAST(floor(b.w_stat * 100 + 0.5) AS INT)",
    "w_svpt": "CAST(b.w_svpt AS INT) + 10",
    "w_1stIn": "CAST(floor((b.w_svpt + 10) * 0.6) AS INT)",
    "w_1stWon": "CAST(floor((b.w_svpt + 10) * 0.6 * (0.5 + b.w_stat2)) AS INT)",
    "w_2ndWon": "CAST(floor((b.w_svpt + 10) * 0.4 * (0.4 + b.w_stat)) AS INT)",
    "w_bpSaved": "CAST(floor((CAST(b.w_svpt AS INT) % 7) * b.w_stat2 * 10) AS INT)",
    "w_bpFaced": "CAST(b.w_svpt AS INT) % 7",
    "l_ace": "CAST(floor(b.l_stat * 100 + 0.5) AS INT)",
    "l_svpt": "CAST(b.l_svpt AS INT) + 10",
    "l_1stIn": "CAST(floor((b.l_svpt + 10) * 0.6) AS INT)",
    "l_1stWon": "CAST(floor((b.l_svpt + 10) * 0.6 * (0.5 + b.l_stat2)) AS INT)",
    "l_2ndWon": "CAST(floor((b.l_svpt + 10) * 0.4 * (0.4 + b.l_stat)) AS INT)",
    "l_bpSaved": "CAST(floor((CAST(b.l_svpt AS INT) % 7) * b.l_stat2 * 10) AS INT)",
    "l_bpFaced": "CAST(b.l_svpt AS INT) % 7",
}

_RAW_SELECT = ", ".join(f'{sql} AS {name}' for name, sql in RAW_FIELDS.items())

VIEWS["raw"] = (("bouts",), f"""
raw AS (
  SELECT {_RAW_SELECT}
  FROM bouts b JOIN customer h ON h.c_custkey = b.host_key
               JOIN supplier w ON w.s_suppkey = b.winner_id
               JOIN supplier l ON l.s_suppkey = b.loser_id)""")

# The master table the raw rows must turn into.
VIEWS["master"] = (("raw",), r"""
master_d AS (
  SELECT *, CAST(try_strptime(tourney_date, '%Y%m%d') AS DATE) AS match_date FROM raw
  WHERE winner_id IS NOT NULL AND loser_id IS NOT NULL AND score IS NOT NULL
    AND winner_name IS NOT NULL AND loser_name IS NOT NULL),
master_t AS (
  SELECT *, list_transform(list_filter(string_split_regex(trim(score), '\s+'),
              lambda t: regexp_full_match(string_split(t, '(')[1], '\d+-\d+')),
              lambda t: string_split(t, '(')[1]) AS sets
  FROM master_d WHERE match_date IS NOT NULL),
master_s AS (
  SELECT * EXCLUDE (sets),
    len(list_filter(sets, lambda t: CAST(string_split(t, '-')[1] AS INT) > CAST(string_split(t, '-')[2] AS INT))) AS ws,
    len(list_filter(sets, lambda t: CAST(string_split(t, '-')[1] AS INT) < CAST(string_split(t, '-')[2] AS INT))) AS ls,
    coalesce(list_sum(list_transform(sets, lambda t: CAST(string_split(t, '-')[1] AS INT) + CAST(string_split(t, '-')[2] AS INT))), 0) AS games
  FROM master_t),
master_all AS (
  SELECT * EXCLUDE (ws, ls, games),
    CAST(CASE WHEN ws + ls > 0 THEN ws END AS INT) AS winner_sets_won,
    CAST(CASE WHEN ws + ls > 0 THEN ls END AS INT) AS loser_sets_won,
    CAST(nullif(games, 0) AS INT) AS total_games,
    regexp_matches(lower(score), 'ret|w/o|def|abn|unfinished|walkover') AS is_retirement,
    contains(lower(score), 'w/o') AS is_walkover,
    year(match_date) AS year, CAST(date_diff('day', DATE '1970-01-01', match_date) AS INT) AS days_since_epoch,
    CASE tourney_level WHEN 'G' THEN 'grand_slam' WHEN 'M' THEN 'masters' WHEN 'A' THEN 'tour'
      WHEN 'C' THEN 'challenger' WHEN 'D' THEN 'davis_or_equivalent' WHEN 'F' THEN 'finals'
      WHEN 'I' THEN 'team_event' ELSE 'other' END AS tournament_level,
    CAST(tourney_id AS VARCHAR) || '|' || tourney_date || '|' || CAST(winner_id AS VARCHAR) || '|'
      || CAST(loser_id AS VARCHAR) || '|' || score AS match_key
  FROM master_s),
master AS (
  SELECT * EXCLUDE (keep), NOT (is_retirement OR is_walkover) AS is_training_eligible FROM (
    SELECT *, row_number() OVER (PARTITION BY tour, match_key ORDER BY match_num DESC) AS keep FROM master_all)
  WHERE keep = 1)""")


def twin(views: list[str], body: str, recursive: bool = False) -> str:
    """SQL text: the named views (with what they need) as CTEs, then `body`.

    A body that brings CTEs of its own starts with a comma.
    """
    done: list[str] = []

    def need(name: str) -> None:
        for parent in VIEWS[name][0]:
            need(parent)
        if name not in done:
            done.append(name)

    for view in views:
        need(view)
    if not done:
        body = body.strip()
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + body.lstrip(", ") if body.startswith(",") else body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(VIEWS[v][1] for v in done) + "\n" + body


def real(c):
    """Six decimals for comparison. The tiny shift keeps exact halves, which sums in another order
    may miss by one bit, away from the rounding edge; the twins do the same."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def r6(sql: str) -> str:
    return f"round({sql} + 1e-9, 6)"


# ---------------------------------------------------------------------------------------------
# DataFrames
# ---------------------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bouts(spark: SparkSession, folder: str, hosts: DataFrame | None = None) -> DataFrame:
    """Consecutive line items of an order meet in pairs; the dearer one wins. The columns of `hosts` (by `host_key`) join the orders, which are fewer."""
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    side = F.struct(
        F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("qty"),
        F.nullif("l_discount", F.lit(0.0)).alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"))
    items = table(spark, folder, "lineitem")
    pairs = (
        dealt(items, ["l_orderkey"], items.count(), LINE_ROWS)
        .select("l_orderkey", "l_returnflag", side.alias("a"), F.lead(side).over(line).alias("b"),
                F.row_number().over(line).alias("rn"))
        .filter((F.col("rn") % 2 == 1) & F.col("b").isNotNull() & (F.col("a.id") != F.col("b.id")))
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("host_key"), F.col("o_orderpriority").alias("level_code"),
        F.col("o_orderdate").cast("date").alias("match_date"))
    more = [] if hosts is None else [c for c in hosts.columns if c != "host_key"]
    orders = orders if hosts is None else orders.join(hosts, "host_key")
    a_wins = F.col("a.price") >= F.col("b.price")
    w, l = F.when(a_wins, F.col("a")).otherwise(F.col("b")), F.when(a_wins, F.col("b")).otherwise(F.col("a"))
    return pairs.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", F.col("l_orderkey"), ((F.col("rn") + 1) / 2).cast("int")).alias("match_key"),
        F.col("l_orderkey").alias("tourney_id"), ((F.col("rn") + 1) / 2).cast("int").alias("match_num"),
        "match_date", "host_key", F.col("l_returnflag").alias("surface"), "level_code",
        w["id"].alias("winner_id"), l["id"].alias("loser_id"), w["qty"].alias("w_svpt"), l["qty"].alias("l_svpt"),
        w["disc"].alias("w_stat"), l["disc"].alias("l_stat"), w["tax"].alias("w_stat2"), l["tax"].alias("l_stat2"), *more)


def pm(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows per bout, one for each player."""
    b = bouts(spark, folder)
    sides = F.array(*[
        F.struct(F.col(f"{me}_id").alias("player_id"), F.col(f"{other}_id").alias("opponent_id"),
                 F.lit(result).alias("result"), F.col(f"{me[0]}_svpt").alias("svpt"),
                 F.col(f"{me[0]}_stat").alias("stat"), F.col(f"{me[0]}_stat2").alias("stat2"))
        for me, other, result in (("winner", "loser", 1), ("loser", "winner", 0))])
    shared = ["match_key", "match_date", "tourney_id", "match_num", "surface", "level_code", "host_key"]
    return b.select(*shared, F.explode(sides).alias("s")).select(*shared, "s.*")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Bouts with two model probabilities, a blend and market odds."""
    b = bouts(spark, folder)
    lower_wins = F.col("winner_id") < F.col("loser_id")
    dq = F.when(lower_wins, F.col("w_svpt") - F.col("l_svpt")).otherwise(F.col("l_svpt") - F.col("w_svpt"))
    s = table(spark, folder, "supplier")
    bal = [s.select(F.col("s_suppkey").alias(f"k{i}"), F.col("s_acctbal").alias(f"bal{i}")) for i in (1, 2)]
    m = (
        b.select("match_key", "match_date", "tourney_id", "match_num", "surface",
                 F.least("winner_id", "loser_id").alias("p1_id"), F.greatest("winner_id", "loser_id").alias("p2_id"),
                 F.when(lower_wins, 1).otherwise(0).alias("p1_wins"), dq.alias("dq"))
        .join(bal[0], F.col("p1_id") == F.col("k1")).join(bal[1], F.col("p2_id") == F.col("k2"))
        .withColumn("prob_a", 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("bal2") - F.col("bal1")) / 8000.0)))
        .withColumn("prob_b", 1.0 / (1.0 + F.pow(F.lit(10.0), -F.col("dq") / 40.0)))
        .drop("k1", "k2", "bal1", "bal2")
    )
    return m.withColumns({
        "prob": 0.6 * F.col("prob_b") + 0.4 * F.col("prob_a"),
        "odds_p1": F.round(1.0 / (1.05 * (0.5 * F.col("prob_a") + 0.25)), 3),
        "odds_p2": F.round(1.0 / (1.05 * (0.75 - 0.5 * F.col("prob_a"))), 3),
    })


def odds(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a time series of odds snapshots."""
    p1 = 1.05 + F.col("value") / 100.0
    return table(spark, folder, "events").select(
        F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("match_id"), F.col("ts").alias("captured_at"),
        F.col("ts").cast("date").alias("match_date"), F.col("event_type").alias("bookmaker"), "props",
        p1.alias("odds_p1"), (1.0 / (1.05 - 1.0 / p1)).alias("odds_p2"))


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw results with the dirt an ingest meets: bad dates, missing names, odd scores."""
    s = small(table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
    hosts = small(table(spark, folder, "customer").select(F.col("c_custkey").alias("host_key"), "c_name"))
    fields = {**RAW_FIELDS, "tourney_name": "b.c_name"}
    return (
        bouts(spark, folder, hosts).alias("b")
        .join(s.alias("w"), F.expr("w.s_suppkey = b.winner_id"))
        .join(s.alias("l"), F.expr("l.s_suppkey = b.loser_id"))
        .selectExpr(*[f"{sql} AS `{name}`" for name, sql in fields.items()])
    )
