"""Scans, merges and extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.registry import query
from boutwise.catalog.views import r6, real, twin
from boutwise.operators import keyed
from boutwise.session import shared_folder
from boutwise.sources import ledger, merge, pages, tables

EXPECTED = {"o_orderkey": "bigint", "o_custkey": "bigint", "winner_entry": "string", "o_totalprice": "double", "source": "string"}


@query("a01_scan_year_files", twin(["bouts"], """SELECT 'atp' AS tour, year(match_date) AS year, CAST(tourney_id AS VARCHAR) AS tourney_id, match_num, CAST(winner_id AS VARCHAR) AS winner_id, CAST(loser_id AS VARCHAR) AS loser_id,
 CAST(w_svpt AS INT) AS w_svpt, CASE surface WHEN 'A' THEN NULL ELSE surface END AS surface, 'files' AS source FROM bouts"""))
def scan_year_files(spark, folder):
    """Matches written as one set of files a year and read back, beside files that are none of this tour's years."""
    path = f"{shared_folder(spark)}/years-{uuid.uuid4().hex}"
    b = views.bouts(spark, folder)
    raw = b.withColumns({"w_svpt": F.col("w_svpt").cast("int"), "surface": F.when(F.col("surface") != "A", F.col("surface"))}).drop("l_svpt")
    tables.write_year_files(raw, path, "atp", F.year("match_date"))
    tables.write_year_files(raw.filter("match_num = 1"), path, "wta", F.year("match_date"))
    raw.select("tourney_id").write.option("header", True).csv(f"{path}/atp_matches_quali.csv")
    rows = tables.scan_year_files(spark, path, "atp")
    return rows.select(
        F.regexp_extract("source_file", r"^([a-z]+)_", 1).alias("tour"), F.regexp_extract("source_file", r"_(\d{4})", 1).cast("bigint").alias("year"),
        "tourney_id", "match_num", "winner_id", "loser_id", "w_svpt", "surface", "source")


@query("a02_scan_aligned", "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS winner_entry, o_totalprice, 'custom' AS source FROM orders")
def scan_aligned(spark, folder):
    return tables.align(views.table(spark, folder, "orders"), EXPECTED, source="custom")


PEOPLE = ("SELECT CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR(20)) || '.0' ELSE CAST(c_custkey - c_custkey % 2 AS VARCHAR(20)) END AS player_id, "
          "CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_mktsegment END AS name_first, CASE WHEN c_custkey % 35 = 0 THEN NULL ELSE c_name END AS name_last, "
          "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' n' || CAST(c_nationkey AS VARCHAR(9)) END AS ioc, c_custkey FROM {customer}")


@query("a03_scan_players", f"""WITH p AS ({PEOPLE.format(customer='customer')}),
n AS (SELECT CAST(CAST(CAST(player_id AS DOUBLE) AS BIGINT) AS VARCHAR) AS player_id, c_custkey, nullif(upper(trim(ioc)), '') AS ioc,
  concat_ws(' ', nullif(trim(name_first), ''), nullif(trim(name_last), '')) AS canonical_name FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY c_custkey) AS rn FROM n WHERE canonical_name <> '')
SELECT player_id, canonical_name, trim(regexp_replace(translate(lower(canonical_name), '.-', '  '), '\\s+', ' ', 'g')) AS normalized_name, ioc FROM f WHERE rn = 1""")
def scan_players(spark, folder):
    people = spark.sql(PEOPLE, customer=views.table(spark, folder, "customer"))
    return tables.scan_players(people, ["c_custkey"])


@query("a04_scan_json_map", """SELECT event_id, 'k' AS key, upper(lpad(json_extract_string(props, '$.k'), 3, 'x')) AS value FROM events""")
def scan_json_map(spark, folder):
    """The JSON object of each event as (key, value) rows, byte order marks tolerated."""
    e = views.table(spark, folder, "events").withColumn("text", F.concat(F.lit("﻿"), "props"))
    return tables.explode_json_map(e, F.col("text"), "event_id").select(
        "event_id", "key", F.upper(F.lpad("value", 3, "x")).alias("value"))


@query("a06_write_snapshot", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0")
def write_snapshot(spark, folder):
    """A table written whole twice; the second writing replaces the first."""
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    o = views.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    tables.write_snapshot(o, path, ["o_orderpriority"])
    tables.write_snapshot(o.filter("o_orderkey % 2 = 0"), path, ["o_orderpriority"])
    return spark.read.schema(o.schema).parquet(path).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("a07_append_history", """SELECT snapshot_day, count(*) AS n, CAST(count(tour) AS BIGINT) AS with_tour FROM (SELECT CAST(ts AS DATE) AS snapshot_day, event_type AS tour FROM events
UNION ALL SELECT CAST(ts AS DATE), NULL FROM events) GROUP BY 1""")
def append_history(spark, folder):
    """Two snapshots in one archive; the second lacks a column."""
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    expected = {"event_id": "bigint", "snapshot_day": "date", "tour": "string", "source_url": "string"}
    e = views.table(spark, folder, "events").withColumn("snapshot_day", F.col("ts").cast("date"))
    tables.append_history(e.withColumnRenamed("event_type", "tour"), path, expected)
    tables.append_history(e, path, expected)
    return spark.read.parquet(path).groupBy("snapshot_day").agg(F.count("*").alias("n"), F.count("tour").alias("with_tour"))


# Two versions of the orders: the old one lacks late orders, the new one has changed prices and gaps.
OLD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 4"
NEW = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lower(o_orderstatus) END AS o_orderstatus,
 o_totalprice + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 5 IN (2, 3, 4)"""


def versions(spark, folder):
    o = views.table(spark, folder, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    k = F.col("o_orderkey")
    new = o.filter(k % 5 >= 2).withColumns({
        "o_orderstatus": F.when(k % 4 != 0, F.lower("o_orderstatus")),
        "o_totalprice": F.col("o_totalprice") + F.when(k % 6 == 0, 1.0).otherwise(0.0)})
    return o.filter(k % 5 != 4).select(*cols), new.select(*cols)


@query("a08_upsert", f"""WITH o AS ({OLD}), n AS ({NEW})
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
 CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
 CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert(spark, folder):
    old, new = versions(spark, folder)
    return merge.upsert(old, new, ["o_orderkey"], ["o_orderstatus"])


@query("a09_mark_current", f"""WITH n AS ({NEW}) SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM n) AS is_current FROM orders""")
def mark_current(spark, folder):
    _, new = versions(spark, folder)
    stored = views.table(spark, folder, "orders").select("o_orderkey", F.lit(True).alias("is_current"))
    return merge.mark_current(stored, new, ["o_orderkey"])


@query("a10_scan_matches", twin(["master"], """SELECT match_key, tournament_level AS tourney_level, CAST(NULL AS VARCHAR) AS indoor, match_date, tourney_id, match_num
FROM master WHERE lower(tour) = 'atp' AND is_training_eligible"""))
def scan_matches(spark, folder):
    from boutwise.plans.master import build_master

    return tables.scan_matches(
        build_master(views.raw(spark, folder)), "ATP", ["match_key", "tourney_level", "indoor", "match_date", "tourney_id", "match_num"],
        eligible_only=True, aliases={"tourney_level": "tournament_level"})


@query("a10_scan_payload", """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events WHERE lower(event_type) = 'click'""")
def scan_payload(spark, folder):
    e = views.table(spark, folder, "events").withColumnRenamed("event_type", "tour")
    return tables.scan_matches(e, "Click", ["event_id", "k", "missing"], payload="props")


@query("a11_scan_odds", twin(["odds"], """, l AS (SELECT match_id, max(captured_at) AS m FROM odds GROUP BY 1)
SELECT snapshot_id, odds.match_id, captured_at FROM odds JOIN l ON l.match_id = odds.match_id AND captured_at = m"""))
def scan_odds(spark, folder):
    from boutwise.operators.marketplace import latest_capture

    stored = views.odds(spark, folder)
    flagged = merge.mark_current(stored, latest_capture(stored, ["match_id"], "captured_at"), ["match_id", "captured_at"])
    return tables.scan_odds(flagged, True).select("snapshot_id", "match_id", "captured_at")


@query("a12_scan_bet_log", """SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS created_at,
 CAST(o_orderkey AS VARCHAR) AS prediction_id, o_orderstatus AS status FROM orders ORDER BY coalesce(created_at, ''), prediction_id""")
def scan_bet_log(spark, folder):
    k = F.col("o_orderkey")
    log = views.table(spark, folder, "orders").select(
        F.when(k % 9 != 0, F.col("o_orderdate").cast("date").cast("string")).alias("created_at"),
        k.cast("string").alias("prediction_id"), F.col("o_orderstatus").alias("status"))
    return tables.scan_bet_log(log)


@query("a13_row_payload", """SELECT event_id, CAST(to_json(struct_pack(event_id := event_id, ts := strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), user_id := user_id, event_type := event_type,
 value := CASE WHEN event_id % 10 <> 0 THEN value END, props := props)) AS VARCHAR) AS payload FROM events""")
def row_payload(spark, folder):
    rows = views.table(spark, folder, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")).otherwise(float("nan")))
    return tables.row_payload(rows).select("event_id", "payload")


@query("a14_ingest_run_log", f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT 'orders_old' AS source_name, '2024-01-01T00:00:00Z' AS last_synced_at, count(*) AS rows_synced, '{{}}' AS detail FROM o
UNION ALL SELECT 'orders_new', '2024-01-01T00:00:00Z', count(*), '{{}}' FROM n""")
def ingest_run_log(spark, folder):
    old, new = versions(spark, folder)
    return merge.ingest_runs({"orders_old": old, "orders_new": new}, "2024-01-01T00:00:00Z")


def ledger_documents(spark, folder):
    """One nested ledger document per conversation, turns as history entries."""
    entry = F.struct(
        F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("timestamp"), F.col("role").alias("prediction_id"),
        F.md5("text").alias("note"), (F.length("text") % 50).cast("double").alias("pnl"),
        F.lit(100.0).alias("capital_before"), (100.0 + F.length("text") % 50).cast("double").alias("capital_after"))
    docs = views.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", entry.alias("e")))).alias("h"))
    return docs.select("conv_id", F.to_json(F.struct(
        (F.size("h") * 1.5).alias("capital"), F.lit("now").alias("updated_at"), F.col("h.e").alias("history"))).alias("doc"))


@query("a15_explode_ledger", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos,
 't' || lpad(CAST(turn AS VARCHAR), 4, '0') || '|' || role || '|' || md5(text) || '|' || CAST(CAST(100 + length(text) % 50 AS DOUBLE) AS VARCHAR) AS event_id,
 CAST(length(text) % 50 AS DOUBLE) AS pnl, CAST(count(*) OVER (PARTITION BY conv_id) * 1.5 AS DOUBLE) AS capital, CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS history_count
FROM conversations""")
def explode_ledger(spark, folder):
    docs = ledger_documents(spark, folder)
    state = ledger.ledger_state(docs, "conv_id", "doc").select("conv_id", "capital", "history_count")
    return ledger.ledger_events(docs, "conv_id", "doc").join(state, "conv_id").select(
        "conv_id", "pos", "event_id", "pnl", "capital", "history_count")


# A page per bout in the form the extractor reads: headings, blank lines, two rows per match, noise.
PAGE_TEXT = (
    "'# Draw' || chr(10) || CASE tourney_id % 4 WHEN 0 THEN 'Semifinals' WHEN 1 THEN '1. round' WHEN 2 THEN 'Round of 16' ELSE 'nothing' END || chr(10) "
    "|| '| Start | Round | S |' || chr(10) "
    "|| '| 01.03. | ' || CASE WHEN match_num = 1 THEN 'QF' ELSE 'x' END || ' | [W' || CAST(winner_id AS VARCHAR(9)) || '](/p) (' || CAST(match_num AS VARCHAR(9)) || ') | 2 | 6 | 3 | 6 |' || chr(10) "
    "|| '| 02.03. | | [L' || CAST(loser_id AS VARCHAR(9)) || '](/p) | ' || CASE WHEN tourney_id % 3 = 0 THEN '2' ELSE '1' END || ' | ' || CAST(tourney_id % 5 AS VARCHAR(9)) || ' | 6 | 4 |' || chr(10) || chr(10) "
    "|| CASE WHEN match_num = 2 THEN 'Final' ELSE 'text' END || chr(10) "
    "|| '| 03.03. | | [L' || CAST(loser_id AS VARCHAR(9)) || '](/p) | 0 | 6' || CAST(tourney_id % 6 AS VARCHAR(9)) || ' | 2 |' || chr(10) "
    "|| '| 04.03. | | [W' || CAST(winner_id AS VARCHAR(9)) || '](/p) (12) | 2 | 7 | 6 |' || chr(10) || '| 05.03. | | [Alone](/p) | 1 | 6 |' || chr(10) || 'and one of five sets' || chr(10) "
    "|| '| 06.03. | | [W' || CAST(winner_id AS VARCHAR(9)) || '](/p) | 3 | 6 | 3 | 6 | 4 | 7 |' || chr(10) "
    "|| '| 07.03. | | [L' || CAST(loser_id AS VARCHAR(9)) || '](/p) | 2 | 4 | 6 | 3 | 6 | 5 |'")

# The same bouts in tree form: rows with their own text, rows of cells, a winner without a loser, a row without sets.
TREE_LINES = [
    "'Draw'", "'[row] 02.03. 14:05 F W' || w || ' (' || CAST(match_num AS VARCHAR(9)) || ') [img] 2 6 3 7 1.44 2.75 info more'",
    "'  [row]  L' || l || '   1 4 6 6 ' || t || ' Click for match highlights now'", "'[note] 1 2 3'",
    "'[row]'", "'[cell] 03.03.'", "'[cell] 09:30'", "'[cell] qf'", "'[cell] W' || w", "'[cell] 2'", "'[cell] 7'", "'[cell] 6'", "'[cell] ' || t",
    "'[row]'", "'[cell] L' || l", "'[cell] 0'", "'[cell] 6'", "'[cell] 3'",
    "'[row] 04.03. 10:00 SF Alone 2 6 6'", "'[row] 05.03. 11:00 R16 W' || w || ' 2 6 6'", "'[row] L' || l || ' (3) 0 2 ' || t",
    "'[row] 06.03. 11:00 2R Noscore x y'", "'[row] L 1 2'"]
TREE_TEXT = " || chr(10) || ".join(TREE_LINES).replace("|| w", "|| CAST(winner_id AS VARCHAR(9))").replace(
    "|| l", "|| CAST(loser_id AS VARCHAR(9))").replace("|| t", "|| CAST(tourney_id % 6 AS VARCHAR(9))")
TREE_SQL = """
UNION ALL SELECT match_key || '-tree', 1, 'F', '6-4 3-6 7-6(' || (tourney_id % 6) || ')', 'W' || winner_id, 'L' || loser_id, CAST(match_num AS VARCHAR), '' FROM d
UNION ALL SELECT match_key || '-tree', 4, 'QF', '7-6(' || (tourney_id % 6) || ') 6-3', 'W' || winner_id, 'L' || loser_id, '', '' FROM d
UNION ALL SELECT match_key || '-tree', 19, CASE WHEN f / 8 >= 16 THEN 'R16' WHEN f / 8 >= 8 THEN 'QF' WHEN f / 8 >= 4 THEN 'SF' ELSE 'F' END, '6-2 6-' || (tourney_id % 6), 'W' || winner_id, 'L' || loser_id, '', '3' FROM r"""


@query("a16_extract_page_rows", twin(["bouts"], """, d AS (SELECT match_key, CAST(16 + tourney_id % 90 AS INT) AS dr, tourney_id, match_num, winner_id, loser_id FROM bouts),
r AS (SELECT *, CASE WHEN dr > 64 THEN 128 WHEN dr > 32 THEN 64 WHEN dr > 16 THEN 32 ELSE 16 END AS f FROM d),
hd AS (SELECT *, CASE tourney_id % 4 WHEN 0 THEN 'SF' WHEN 1 THEN CASE WHEN f >= 128 THEN 'R128' WHEN f >= 64 THEN 'R64' WHEN f >= 32 THEN 'R32' ELSE 'R16' END
   WHEN 2 THEN CASE WHEN f / 8 >= 16 THEN 'R16' WHEN f / 8 >= 8 THEN 'QF' WHEN f / 8 >= 4 THEN 'SF' ELSE 'F' END ELSE 'R32' END AS h1,
   tourney_id % 3 = 0 AS tie FROM r)
SELECT match_key, 3 AS line_no, CASE WHEN match_num = 1 THEN 'QF' ELSE h1 END AS round, '6-' || (tourney_id % 5) || ' 3-6 6-4' AS score,
 'W' || winner_id AS winner_name, 'L' || loser_id AS loser_name, CAST(match_num AS VARCHAR) AS winner_seed, '' AS loser_seed FROM hd
UNION ALL SELECT match_key, 7, CASE WHEN match_num = 2 THEN 'F' WHEN match_num = 1 THEN 'QF' ELSE h1 END,
 '7-6(' || (tourney_id % 6) || ') 6-2', 'W' || winner_id, 'L' || loser_id, '12', '' FROM hd
UNION ALL SELECT match_key, 11, CASE WHEN match_num = 2 THEN 'F' WHEN match_num = 1 THEN 'QF' ELSE h1 END, '6-4 3-6 6-3 4-6 7-5', 'W' || winner_id, 'L' || loser_id, '', '' FROM hd""" + TREE_SQL))
def extract_page_rows(spark, folder):
    forms = F.array(*[F.struct(F.concat("match_key", F.lit(end)).alias("match_key"), F.expr(text).alias("text")) for end, text in (("", PAGE_TEXT), ("-tree", TREE_TEXT))])
    rows = views.bouts(spark, folder).select(F.expr("CAST(16 + tourney_id % 90 AS INT)").alias("draw"), F.explode(forms).alias("page"))
    return pages.page_records(rows.select("draw", "page.*"), "match_key", "text", F.col("draw"))
