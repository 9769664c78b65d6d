"""Sorts, limits and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.expressions import EDGE_SQL, edges
from boutwise.catalog.registry import query
from boutwise.catalog.views import r6, real, twin
from boutwise.operators import keyed, marketplace


@query("f01_sort_nulls_last", twin(["raw"], """SELECT tour, tourney_id, match_num, winner_rank FROM raw
ORDER BY winner_rank ASC NULLS LAST, tourney_id, match_num"""))
def sort_nulls_last(spark, folder):
    return views.raw(spark, folder).select("tour", "tourney_id", "match_num", "winner_rank").orderBy(
        F.col("winner_rank").asc_nulls_last(), "tourney_id", "match_num")


@query("f02_tail_n", twin(["bouts"], "SELECT match_key, match_date FROM bouts ORDER BY match_date DESC, tourney_id DESC, match_num DESC LIMIT 2000"))
def tail_n(spark, folder):
    return keyed.last_rows(views.bouts(spark, folder), ["match_date", "tourney_id", "match_num"], 2000).select("match_key", "match_date")


@query("f03_closest_miss", twin(["scored"], EDGE_SQL + f""" SELECT match_key, {r6('selected_edge')} AS selected_edge FROM edges
WHERE (SELECT max(selected_edge) FROM edges) < 0.9 ORDER BY edges.selected_edge DESC, match_key LIMIT 1"""))
def closest_miss(spark, folder):
    rows = marketplace.closest_miss(edges(spark, folder), "match_key", least=0.9)
    return rows.select("match_key", real("selected_edge").alias("selected_edge"))


ALLOCATE_SQL = EDGE_SQL + """, k0 AS (SELECT *, 0.25 * greatest(0.0, CASE WHEN selected_odds - 1.0 > 0 THEN ((selected_odds - 1.0) * selected_prob - (1.0 - selected_prob)) / (selected_odds - 1.0) ELSE 0.0 END) AS kelly_share
  FROM edges WHERE selected_edge >= 0.05),
k1 AS (SELECT *, row_number() OVER (PARTITION BY match_date ORDER BY kelly_share DESC, selected_edge DESC, match_key) AS pick, least(greatest(kelly_share, 0.0), 0.5) AS raw_share FROM k0),
k2 AS (SELECT *, sum(raw_share) OVER (PARTITION BY match_date) AS total FROM k1 WHERE pick <= 3),
k3 AS (SELECT *, CASE WHEN total > 0.5 THEN raw_share * (0.5 / total) ELSE raw_share END AS share FROM k2),
k4 AS (SELECT *, CASE WHEN share > 0 THEN greatest(round_even(100.0 * share * 100.0, 0) / 100.0, 0.5) ELSE 0.0 END AS stake0 FROM k3),
k5 AS (SELECT *, sum(stake0) OVER (PARTITION BY match_date) AS staked FROM k4),
k6 AS (SELECT *, round_even(stake0 * (50.0 / staked) * 100.0, 0) / 100.0 AS shrunk FROM k5),
alloc AS (SELECT *, CASE WHEN staked > 50.0 AND staked > 0 THEN CASE WHEN shrunk > 0 THEN greatest(shrunk, 0.5) ELSE shrunk END ELSE stake0 END AS stake FROM k6)"""


@query("f04_recommend", twin(["scored"], ALLOCATE_SQL + f""", st AS (SELECT match_date, count(*) AS analysed, count_if(selected_edge >= 0.05) AS value_bets FROM edges GROUP BY 1)
SELECT st.match_date, analysed, CASE WHEN value_bets > 0 THEN 'value' ELSE 'skip' END AS status, alloc.match_key, pick, {r6('share')} AS share, {r6('stake')} AS stake
FROM st LEFT JOIN alloc ON alloc.match_date = st.match_date"""))
def recommend(spark, folder):
    scored = edges(spark, folder)
    status = marketplace.recommendation_status(scored, ["match_date"], "match_key").select("match_date", "analysed", "status")
    picks = marketplace.recommend(scored, ["match_date"], ["match_key"], 100.0).select(
        "match_date", "match_key", F.col("pick").cast("bigint").alias("pick"), real("share").alias("share"), real("stake").alias("stake"))
    return status.join(picks, "match_date", "left")


@query("g01_union_aligned", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, CAST(NULL AS BIGINT), o_totalprice FROM orders WHERE o_orderkey % 2 = 1""")
def union_aligned(spark, folder):
    o = views.table(spark, folder, "orders")
    first = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_totalprice")
    other = o.filter("o_orderkey % 2 = 1").select("o_totalprice", "o_orderkey", "o_orderstatus")
    return keyed.union_aligned(first, other)


@query("g02_union_tours", twin(["raw"], "SELECT tour, tourney_id, match_num, winner_id, loser_id FROM raw ORDER BY tour, tourney_id, match_num"))
def union_tours(spark, folder):
    rows = views.raw(spark, folder).select("tour", "tourney_id", "match_num", "winner_id", "loser_id")
    return keyed.union_aligned(rows.filter("tour = 'wta'"), rows.filter("tour = 'atp'")).orderBy("tour", "tourney_id", "match_num")
